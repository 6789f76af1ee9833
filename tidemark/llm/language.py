"""Language of web pages by Bayesian evidence fusion.

Text likelihoods come from a naive Bayes model of hashed byte trigrams, tempered by the square root of
the text's length. They are fused with the declared markup language, the address suffix and a prior for the
host. What declarations and suffixes say about languages, and the priors, are estimated from the pages by
grouped aggregation of the text posteriors: a host's prior is smoothed towards that of its suffix, and that
towards the prior of all pages, each with KAPPA pseudo-counts, and all of them leave out the page that they are used
for. Sums are taken before the shuffle, so a host with a third of all pages costs no more than others.

The trigram model has all languages of the documents, however rare, and learns each from at most LANG_ROWS of
its documents, those of smallest doc_id hash; the number of languages must be small (they are columns of the
model). Null or empty pages rest on the
other evidence; pages without any get the overall prior; an empty table of
pages gives an empty result, and one of documents null languages and probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import host
from tidemark.llm.common import kept, pieces, texts

BITS, LANG_ROWS, KAPPA = 15, 1000, 5.0
_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>")


def visible(html: str) -> str:
    return _TAGS.sub(" ", html)


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the UTF-8 bytes."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)) if len(b) > 2 else np.zeros(0, np.uint32)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each hashed trigram in each, from LANG_ROWS texts of each at most; of a repeated doc_id the least text."""
    known = docs.where("lang is not null")
    # Up to 1,000 rows a group, Spark drops the others in each partition before the shuffle.
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= LANG_ROWS).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    same = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")), "left_semi")
    rows = same.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    langs = sorted({r.lang for r in rows})
    counts = np.full((len(langs), 1 << BITS), 0.1)
    for r in rows:
        counts[langs.index(r.lang)] += np.bincount(grams(r.text or ""), minlength=1 << BITS)
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """page_id, host, declared, suffix, language and probability."""
    langs, table = model
    lost = table.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            out = []
            for h in texts(b, "html"):
                g = grams(visible(h))
                z = lost[:, g].sum(1, dtype=np.float64) / max(1.0, np.sqrt(len(g)))
                out.append((z - z.max()).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.list_(pa.float64()))], ["page_id", "host", "suffix", "declared", "loglik"])

    name = host(F.coalesce("url", F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    source = pages.select("page_id", F.coalesce(name, F.lit("")).alias("host"), F.regexp_extract(F.coalesce(name, F.lit("")), r"([^.]*)$", 1).alias("suffix"), declared.alias("declared"), F.coalesce("html", F.lit("")).alias("html"))
    if not langs:
        return source.select("page_id", "host", "declared", "suffix", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"))
    scored = kept(source.mapInArrow(run, "page_id long, host string, suffix string, declared string, loglik array<double>"))
    n = range(len(langs))
    weights = F.transform("loglik", lambda x: F.exp(x))
    scored = scored.withColumn("p", F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y)))

    def sums(name: str, *by: str) -> DataFrame:
        """The sum of the posteriors, an array called name, and the number of pages, by these columns."""
        return scored.groupBy(*by).agg(F.array(*(F.sum(F.col("p")[i]) for i in n)).alias(name), F.count("*").alias(f"{name}_n"))

    # A page's own posterior is taken out of all sums that it meets: it has its say by its likelihood. Hot hosts are a skewed
    # join of a table with one row for each host, which Spark splits.
    joined = scored.join(sums("h", "host"), "host").join(sums("s", "suffix"), "suffix").join(sums("d", "declared"), "declared").crossJoin(F.broadcast(sums("w")))

    def prior(name: str, parent: str) -> Column:
        return F.transform(parent, lambda x, i: (F.greatest(F.get(name, i) - F.get("p", i), F.lit(0.0)) + KAPPA * x) / (F.col(f"{name}_n") - 1 + KAPPA))

    joined = joined.withColumn("base", F.transform("w", lambda x, i: (F.greatest(x - F.get("p", i), F.lit(0.0)) + 1) / (F.col("w_n") - 1 + len(langs))))
    joined = joined.withColumn("of_suffix", prior("s", "base")).withColumn("of_host", prior("h", "of_suffix")).withColumn("mark", prior("d", "base"))
    # P(declared | language), up to a factor that is the same for all languages. The suffix speaks through the host's prior, which is smoothed towards it.
    said = lambda i: F.when(F.col("declared") == "", 0.0).otherwise(F.log(F.get("mark", i)) - F.log(F.get("base", i)))
    fused = joined.withColumn("z", F.transform("loglik", lambda x, i: x + F.log(F.get("of_host", i)) + said(i)))
    top = F.array_max("z")
    chance = 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return fused.select("page_id", "host", "declared", "suffix", F.element_at(F.array(*map(F.lit, langs)), F.array_position("z", top).cast("int")).alias("language"), chance.alias("probability"))
