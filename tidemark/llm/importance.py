"""Target-distribution importance resampling: documents drawn by how much more likely their word pairs are in the target texts.

Features are runs of one and two words (A-Z folded), hashed to BUCKETS buckets by crc32. Bucket counts of the documents and of the target
come as one vector a task, summed on the executors; only 2 * BUCKETS numbers reach the driver. A document's weight is the
floored mean gain of its features, read from the array of gains; its score adds seeded Gumbel noise, so the greatest scores are a
draw without replacement in proportion to exp(weight / 1000).

Scores are integers: a gain is at most 1000 * ln(2 ** 126) and the noise lies between -3,200 and 22,900, so that a histogram of scores
has less than 210,000 rows whatever the number of documents. Its sums from above give each score's rank offset and the score
at which the draw ends; row_number by doc_id ranks the documents of each surviving score by itself. Noise spreads even equal texts over
thousands of scores, so no score holds more than about a 2,000th part of the documents with distinct ids.

Null and empty texts have no features, weight 0, and fewer than LEAST_WORDS words, so they are scored and never drawn. A null doc_id is
hashed like an empty one and comes after the others of its score. Repeated rows are scored and ranked each (rows that are equal in
all results get different ranks). Empty tables: without documents the result is empty, without target texts all t and T are 0. Other
columns of docs are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_TABLE, crc32_sql, kept, pieces, texts

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each feature: words, then neighbouring pairs."""
    own = _WORD.findall(text.encode().lower())  # of bytes, lower() folds A-Z only
    one = list(map(crc32, own))
    two = map(crc32, own[1:], map(crc32, repeat(b" "), one))
    return len(own), np.array([*one, *two], np.int64) % BUCKETS


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in texts(b):
                total += np.bincount(features(t)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds, in thousandths of a natural logarithm."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(iter([b])):
                words, n, weight = [], [], []
                for t in texts(p):
                    count, at = features(t)
                    words.append(count)
                    n.append(len(at))
                    weight.append(int(shared.value[at].sum()) // len(at) if len(at) else 0)
                yield pa.RecordBatch.from_arrays([p.column(0), *(pa.array(x, pa.int64()) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """The weighed documents with their score."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return weighed(docs, gain).withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log(u))))


def drawn(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """rows (scored, read several times) with rank: 1, 2, 3... down from the greatest score for the share drawn of those with `least` words, else null."""
    able = F.col("n_words") >= least
    counts = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))
    down = W.orderBy(F.desc("score"))
    above = F.coalesce(F.sum("n").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    draw = F.floor(F.sum("n").over(W.partitionBy()) * percent / 100)
    ends = counts.select(F.col("score").alias("_score"), above.alias("_above"), draw.cast("long").alias("_draw")).where("_above < _draw")
    # The histogram's size is bounded by the range of scores, see above.
    both = rows.join(F.broadcast(ends), able & (F.col("score") == F.col("_score")), "left")
    place = F.col("_above") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    names = [c for c in rows.columns if c != "rank"]
    near = both.where("_above is not null").withColumn("rank", place).select(*names, F.when(F.col("rank") <= F.col("_draw"), F.col("rank")).cast("long").alias("rank"))
    return near.union(both.where("_above is null").select(*names, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; target has a column text."""
    rows = kept(scored(docs, gains(bucket_counts(docs), bucket_counts(target)), seed))
    return drawn(rows, percent).select("doc_id", "n_features", "weight", "score", "rank")


#: The same in DuckDB's SQL.
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
own AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS r FROM documents),
tw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM own),
tf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM tw),
names AS (SELECT f, {crc32_sql('f')} % {BUCKETS} AS b FROM (SELECT f FROM f UNION SELECT f FROM tf), crc_table),
s AS (SELECT b, count(*) AS n FROM f JOIN names USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM tf JOIN names USING (f) GROUP BY b),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS tt),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (ss + {BUCKETS}) / ((s.n + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (b), tot),
wt AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN names USING (f) JOIN gain USING (b) GROUP BY r),
sc AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM own LEFT JOIN wt USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (words >= {LEAST_WORDS}) OVER () AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {LEAST_WORDS} AND k <= {PERCENT} * n // 100 THEN k END AS rank FROM o
"""
