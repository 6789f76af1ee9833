"""Toxicity scores by non-negative positive-unlabelled learning, in numpy.

Only confirmed toxic examples count as labels; all else is unlabelled. With the class prior p of toxic text,
the risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): where the second part falls below
zero, the step goes the other way, so that the classifier cannot overfit the positives. The model is linear
in hashed words and word beginnings of 4, 6 and 8 bytes, each counted once a text, with a proximal L1 step
that leaves weights only on what tells toxic text; long texts therefore collect no noise.

Training: at most POSITIVES toxic documents, and UNLABELLED of all that may be learned from, toxic ones among them as
the risk asks, those of smallest doc_id hash, each taken whole; the prior is the share of toxic rows among all labelled training rows. Scoring reads whole texts in one
pass without a shuffle. Null and empty texts have no features and get the score of the intercept; without
positives that score is near 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Hasher, bucket_of, pieces, sampled, texts_of, utf8, words

BITS = 20
BEGINNINGS = (4, 6, 8)
POSITIVES, UNLABELLED = 1500, 4500
#: Steps with the L1 part, which choose the features, then steps on those alone.
CHOOSING, FITTING, L1 = 120, 240, 1e-3


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text of each, every feature once a text."""
    start, end, row = words(data, off)
    h = Hasher(data)
    kinds = [h(start, end)]
    rows = [row]
    for n in BEGINNINGS:
        long = end - start >= n
        kinds.append(h(start[long], start[long] + n) + np.uint64(n))
        rows.append(row[long])
    key = np.unique(np.concatenate(rows).astype(np.uint64) << np.uint64(BITS) | np.concatenate(kinds) >> np.uint64(64 - BITS))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)


def scores(weight: np.ndarray, shift: float, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    f, row = features(data, off)
    z = np.bincount(row, weight[f], len(off) - 1) + shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positives: list[bytes], unlabelled: list[bytes], prior: float) -> tuple[np.ndarray, float]:
    """Weights by feature number, and the intercept."""
    if not positives or not unlabelled:
        return np.zeros(1 << BITS, np.float32), -4.0
    both = positives + unlabelled
    off = np.concatenate([[0], np.cumsum([len(x) for x in both])])
    parts = []
    for a in range(0, len(both), 200):  # in parts, for memory
        part = off[a : a + 201]
        f, row = features(np.frombuffer(b"".join(both[a : a + 200]), np.uint8), part - part[0])
        parts.append((f, row + a))
    f, row = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    often = np.bincount(f, minlength=1 << BITS) >= 3
    use = often[f]
    number = np.cumsum(often) - 1
    f, row = number[f[use]], row[use]
    n, p = int(often.sum()), len(positives)
    positive = np.arange(len(both)) < p
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, CHOOSING + FITTING + 1):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[f], len(both)) + b, -30, 30)))
        loss = -np.log(np.maximum(1 - q, 1e-12))
        rest = loss[~positive].mean() - prior * loss[positive].mean()
        # Derivatives by each text's logit, of the positives' risk and of the rest's.
        up = np.where(positive, prior * (q - 1) / p, 0)
        down = np.where(positive, -prior * q / p, q / (len(both) - p))
        g = up + down if rest >= 0 else -down
        grad = np.append(np.bincount(f, g[row], n), g.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        step = 0.08 / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= step[:-1] * m[:-1] / (1 - 0.9**t)
        b -= float(step[-1] * m[-1] / (1 - 0.9**t))
        if t <= CHOOSING:
            w = np.sign(w) * np.maximum(0, np.abs(w) - L1 * step[:-1])
        if t == CHOOSING:
            use = (w != 0)[f]
            f, row, chosen = f[use], row[use], w != 0
        if t >= CHOOSING:
            w *= chosen
    out = np.zeros(1 << BITS, np.float32)
    out[often] = w
    return out, b


def fit(docs: DataFrame, labels: DataFrame, learnable: Column) -> tuple[np.ndarray, float]:
    """From labels.toxic of rows for which `learnable` (of doc_id) holds; POSITIVES + UNLABELLED texts at most, one of each doc_id in either."""
    known = labels.where(learnable & F.col("toxic").isNotNull())
    share = known.agg(F.avg("toxic")).first()[0]
    prior = min(0.5, max(1e-3, share or 0.0))
    toxic = sampled(known.where("toxic = 1"), POSITIVES).withColumn("toxic", F.lit(True))
    rest = sampled(docs.where(learnable), UNLABELLED).withColumn("toxic", F.lit(False))
    rows = texts_of(docs, toxic.union(rest)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([(r.text or "").encode() for r in rows if r.toxic], [(r.text or "").encode() for r in rows if not r.toxic], prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and score double."""
    shift, at = model[1], np.flatnonzero(model[0])
    values = model[0][at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS, np.float32)
        weight[at] = values
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(scores(weight, shift, *utf8(b)), pa.float64())], [*keep, "score"])

    source = docs.select(*dict.fromkeys((*keep, "text")))
    return source.mapInArrow(run, ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep) + ", score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; rows of crc32 remainder 0 of 5 are never learned from."""
    out = score(docs, fit(docs, labels, bucket_of(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
