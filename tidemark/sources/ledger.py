"""Ledgers of JSON lines, and tables kept by date."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, seq and value of the lines that aren't blank; within a file (at, seq) follows its order."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), "value")
    return rows.where(F.trim("value") != "")


def parsed(rows: DataFrame, types: Iterable[str]) -> DataFrame:
    """rows with event (variant), event_type and reason: invalid_json, unknown_event_type:x, or null for a good line."""
    own = rows.withColumn("event", F.try_parse_json("value"))
    own = own.withColumn("event_type", F.try_variant_get("event", "$.event_type", "string"))
    known = F.coalesce(F.col("event_type").isin(*types), F.lit(False))
    unknown = F.concat(F.lit("unknown_event_type:"), F.coalesce("event_type", F.lit("undefined")))
    return own.withColumn("reason", F.when(F.col("event").isNull(), "invalid_json").when(~known, unknown))


def events(rows: DataFrame, types: Iterable[str]) -> DataFrame:
    """The good lines; one bad line does not cost the others."""
    return parsed(rows, tuple(types)).where("reason is null").drop("reason")


def skipped(rows: DataFrame, types: Iterable[str]) -> DataFrame:
    """The bad lines and why."""
    return parsed(rows, tuple(types)).where("reason is not null").select("file", "at", "seq", "reason")


def checked(rows: DataFrame, types: Iterable[str], kind: str = "event_type") -> DataFrame:
    """rows as they are; an unknown type fails the job before anything is committed."""
    fine = F.coalesce(F.col(kind).isin(*types), F.lit(False))
    return rows.withColumn(kind, F.when(fine, F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("null"))))))


def append(rows: DataFrame, path: str, types: Iterable[str]) -> None:
    """Add events to a ledger of JSON lines."""
    checked(rows, tuple(types)).write.mode("append").json(path)


def replace_dates(rows: DataFrame, path: str, date: str = "date") -> None:
    """Write rows by date: the dates among them are written anew, all others stay."""
    rows.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def last_of_each(rows: DataFrame, key: list[str], order: list[str], fill: dict[str, object]) -> DataFrame:
    """The last row by `order` of each key, with the given values for nulls: a later line corrects an earlier one."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*key, "_last.*").fillna(fill)


def sums_between(rows: DataFrame, group: str, date: str, since: str, until: str, values: list[str]) -> DataFrame:
    """Sums by group over the dates (texts) from since to until, both included; repeated rows count."""
    return rows.where(F.col(date).between(since, until)).groupBy(group).agg(*(F.sum(v).alias(v) for v in values))


def upserted(index: DataFrame, today: DataFrame, date: str, keep: int = 7) -> DataFrame:
    """index with the rows of today's dates replaced, of the `keep` calendar days up to the latest, the newest first."""
    every = index.join(F.broadcast(today.select(date).distinct()), date, "left_anti").unionByName(today)
    last = today.agg(F.max(date).alias("_last"))
    return every.crossJoin(F.broadcast(last)).where(F.col(date) > F.date_sub("_last", keep)).drop("_last").orderBy(F.desc(date))


def folded(events: DataFrame, group: Column, kinds: dict[str, tuple[str, ...]], kind: str = "event_type") -> DataFrame:
    """Counts by group (an array is taken apart, each element counting once) of the events of each set of types."""
    own = events.select(F.explode(F.array_distinct(group)).alias("group"), kind)
    return own.groupBy("group").agg(*(F.count_if(F.col(kind).isin(*types)).alias(name) for name, types in kinds.items()))
