"""A corpus pipeline: quality filter, near-duplicate removal, redaction, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, mixing, pii, quality
from tidemark.llm.common import Scratch, bucket_of, documents, kept, table
from tidemark.llm.queries import PATTERN, RANKS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality probability is 0.5 or more; the network learns as in op9."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"), bucket_of(F.col("doc_id"), 3) != 1)
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, net, tuple(docs.columns), name).where(F.col(name) >= 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at Jaccard 0.8 or more, the one of least doc_id."""
    return jaccard.one_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars is that of the new text."""
    return pii.redacted(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the number of ids and the ids of each document."""
    ids = bpe.encode(docs, RANKS, PATTERN, keep=("doc_id", "source"))
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("pii", redact_pii), ("mixing", mix_sources), ("byte_bpe", encode_bytes)]

#: The network and the random field have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written as Parquet to the shared folder and read again, and dropped when the next one's are there."""
    docs = documents(spark, sf_dir)
    with ExitStack() as before:
        for _, stage in STAGES[:-1]:
            with ExitStack() as own:
                docs = own.enter_context(Scratch(spark)).keep(stage(spark, docs, sf_dir))
                before.close()
                before.push(own.pop_all())
        return kept(STAGES[-1][1](spark, docs, sf_dir))
