"""What is pulled once, rewritten by day, and moved from the hot tables to the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pulled(events: DataFrame, cursor: DataFrame, seen: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New events, the next cursor and the next seen keys.

    cursor: one row or none with last_ts; seen: key and at of events taken before. Events from the cursor's time on are looked at, those of that
    very time too, so that none of one time is lost, and seen ones are left out. Of repeated keys one is taken. Seen keys from before the next cursor are never met again, so they
    go. Run again with its own results and the same events it takes nothing.
    """
    last = F.broadcast(cursor.agg(F.max("last_ts").alias("_last")))
    near = events.where(F.col(at).isNotNull()).crossJoin(last).where(F.col("_last").isNull() | (F.col(at) >= F.col("_last"))).drop("_last")
    names = events.columns
    new = near.join(seen.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*names), F.col(at)).alias("_e")).select("_e.*")
    after = new.agg(F.max(at).alias("_new")).crossJoin(cursor.agg(F.max("last_ts").alias("_old"))).select(F.greatest("_new", "_old").alias("last_ts")).where("last_ts is not null")
    keep = seen.select(key, at).union(new.select(key, at)).distinct().crossJoin(F.broadcast(after)).where(F.col(at) >= F.col("last_ts")).select(key, at)
    return new, after, keep


def rewrite_days(rows: DataFrame, path: str, day: str) -> None:
    """Writes rows by day; days that are written again are replaced, others, older ones too, stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retired(hot: DataFrame, archive: DataFrame, key: str, day: str, today: str, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """The hot table without rows of more than `days` days before today, and the archive with them: what it has of a key stays, so moving again changes nothing. Rows without a day stay hot."""
    old = F.coalesce(F.col(day) < F.date_sub(F.lit(today).cast("date"), days), F.lit(False))
    moved = hot.where(old).join(archive.select(key), key, "left_anti")
    return hot.where(~old), archive.unionByName(moved.select(archive.columns))


def missing_days(listed: DataFrame, mirrored: DataFrame, day: str, since: str) -> DataFrame:
    """Days of the cold list from `since` on that the mirror hasn't got, in order."""
    return listed.where(F.col(day) >= F.lit(since).cast("date")).select(day).distinct().join(mirrored.select(day).distinct(), day, "left_anti").orderBy(day)


def silent(signals: DataFrame, counts: DataFrame, group: str, day: str, value: str, today: str, nights: int) -> DataFrame:
    """signals (one row a group) with last_day, the last day with a positive value, and silent: none in the last `nights` nights up to today."""
    last = counts.where(F.col(value) > 0).groupBy(F.col(group).alias("_g")).agg(F.max(day).alias("last_day"))
    own = signals.join(last, F.col(group) == F.col("_g"), "left").drop("_g")
    return own.withColumn("silent", F.coalesce(F.col("last_day") <= F.date_sub(F.lit(today).cast("date"), nights), F.lit(True)))
