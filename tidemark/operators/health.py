"""Health of series and artifacts: baselines, sustained falls, isolation, streaks, groups, quotas. All but the windows are groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import half_up


def last_of_date(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row of greatest order, whole."""
    whole = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return whole.select("_row.*")


def nightly_baseline(nights: DataFrame, group: str, night: str, metric: str, n: int = 7) -> DataFrame:
    """The median, to 4 places, of each group's last n nights that have the metric."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(night)))
    last = nights.where(F.col(metric).isNotNull()).withColumn("_r", rank).where(f"_r <= {int(n)}")
    return last.groupBy(group).agg(half_up(F.median(metric), 4).alias("baseline"), F.count("*").alias("nights"))


def sustained_low(nights: DataFrame, group: str, night: str, metric: str, items: str, drop: float = 0.15) -> DataFrame:
    """Of each group whether both of its last two nights with items lie by `drop` or more below the median of all those nights; false with fewer than two nights or two values."""
    ran = nights.where(F.col(items) > 0)
    middle = ran.groupBy(group).agg(F.median(metric).alias("_median"), F.count(metric).alias("_known"), F.count("*").alias("_nights"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(night)))
    last = ran.withColumn("_r", rank).where("_r <= 2").groupBy(group).agg(F.max(metric).alias("_high"), F.count(metric).alias("_two"))
    low = (F.col("_nights") >= 2) & (F.col("_known") >= 2) & (F.col("_two") == 2) & (F.col("_high") <= F.col("_median") - drop)
    return middle.join(last, group).select(group, F.coalesce(low, F.lit(False)).alias("low"))


def isolated(groups: DataFrame, bad: str, least: int = 6) -> DataFrame:
    """groups with `isolated`: bad, while at least so many others are not. One row of counts goes to all."""
    calm = groups.agg(F.count_if(~F.col(bad)).alias("_calm"))
    return groups.crossJoin(F.broadcast(calm)).withColumn("isolated", F.col(bad) & (F.col("_calm") >= least)).drop("_calm")


def failure_streak(runs: DataFrame, group: str, order: str, ok: str) -> DataFrame:
    """Failures of each group since its last success."""
    last = runs.groupBy(group).agg(F.max(F.when(F.col(ok), F.col(order))).alias("_last"))
    since = F.col("_last").isNull() | (F.col(order) > F.col("_last"))
    return runs.join(last, group).groupBy(group).agg(F.count_if(since & ~F.col(ok)).alias("failures"))


def group_health(artifacts: DataFrame, group: str, status: str) -> DataFrame:
    """missing if all are, invalid if any is neither available nor missing, degraded if any is missing, else available."""
    s = F.col(status)
    state = F.when(F.bool_and(s == "missing"), "missing").when(F.bool_or(~s.isin("available", "missing")), "invalid").when(F.bool_or(s == "missing"), "degraded").otherwise("available")
    return artifacts.groupBy(group).agg(state.alias("health"))


def status_counts(rows: DataFrame, status: str, known: tuple[str, ...]) -> DataFrame:
    """A count for each of the known statuses, 0 where there is none."""
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, known))).alias(status))
    return every.join(rows.groupBy(status).agg(F.count("*").alias("_n")), status, "left").select(status, F.coalesce("_n", F.lit(0)).alias("n"))


def in_flight(changes: DataFrame, category: str, applied_at: str, now, days: int = 7) -> DataFrame:
    """Applied changes of the last days by category, and all together where the category is null."""
    recent = changes.where((F.col(applied_at) <= now) & (F.col(applied_at) > F.timestamp_add("DAY", F.lit(-days), now)))
    return recent.rollup(category).agg(F.count("*").alias("n"), F.grouping(category).alias("is_total"))


def evidence_grade(rows: DataFrame, group: str, grade: str, least: int = 2) -> DataFrame:
    """The first of E1, E2, E3 that so many members (or all, if fewer) reach or better; else E4."""
    n = [F.count_if(F.col(grade).isin(*(f"E{j}" for j in range(1, i + 1)))) for i in (1, 2, 3)]
    need = F.least(F.lit(least), F.count("*"))
    return rows.groupBy(group).agg(F.when(n[0] >= need, "E1").when(n[1] >= need, "E2").when(n[2] >= need, "E3").otherwise("E4").alias("grade"))
