"""Structured Streaming forms: new events, daily counts, latest ratings, and sinks that may be run again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_only(stream: DataFrame, key: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each event once, though it may be delivered again: an event is known by `key`, kept for `late` of event time. A rating given anew has another time, so it passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([*key])


def daily_counts(stream: DataFrame, at: str, group: str, late: str | None = None, every: str = "1 day", length: str = "1 day") -> DataFrame:
    """group, day and n by windows of event time; longer windows slide. With `late` state older than that is dropped, late rows too."""
    rows = stream.withWatermark(at, late) if late else stream
    span = F.window(at, length) if every == length else F.window(at, length, every)
    counts = rows.groupBy(group, span.alias("w")).agg(F.count("*").alias("n"))
    return counts.select(group, F.to_date("w.start").alias("day"), "n")


def latest(stream: DataFrame, subject: str, at: str, line: str) -> DataFrame:
    """The last event of each subject, of those at one time the first in the log; state grows with the subjects, not with the events."""
    order = F.struct(F.col(at), -F.col(line))
    rest = [c for c in stream.columns if c != subject]
    return stream.groupBy(subject).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(subject, "_e.*")


def own_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one, for a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="stream-")


def completed(result: DataFrame, folder: str, keep: Callable[[DataFrame, int], None] | None = None, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and give its result as a table in `folder`.

    In the mode "complete" every batch writes the whole result to a folder of its own and the last one counts, so a batch that is run again does no harm.
    """
    if mode != "complete" and keep is None:
        raise ValueError("a batch holds the whole result in the mode complete only; give keep for another")
    spark = result.sparkSession
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        last[:] = [number]

    run = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).foreachBatch(keep or write).start()
    run.awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{folder}/batch={last[0]}")
