"""Series on a calendar: a day without rows is 0 if anything was observed that day, else unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import half_up


def calendar(days: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last, and whether it was observed."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    axis = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return axis.join(days.select(F.col(day).alias("day"), F.lit(True).alias("seen")).distinct(), "day", "left").select("day", F.coalesce("seen", F.lit(False)).alias("observed"))


def on_axis(counts: DataFrame, group: str, value: str, axis: DataFrame) -> DataFrame:
    """A row for each group and day of the axis; value is 0 on observed days without rows and null on others."""
    grid = counts.select(group).distinct().crossJoin(F.broadcast(axis))
    both = grid.join(counts.select(group, "day", value), [group, "day"], "left")
    return both.select(group, "day", "observed", F.when(F.col("observed"), F.coalesce(value, F.lit(0))).alias(value))


def moving_average(counts: DataFrame, group: str, value: str, days: int, least: float = 0.6) -> DataFrame:
    """Mean over the days with rows in the window of `days` calendar days that ends at each, its coverage and whether that suffices."""
    w = W.partitionBy(group).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    n = F.count("*").over(w)
    own = counts.select(group, "day", half_up(F.sum(value).over(w).cast("double") / n).alias("average"), n.alias("active_days"))
    coverage = F.col("active_days").cast("double") / days
    return own.select(group, "day", "average", "active_days", half_up(coverage).alias("coverage"), (coverage >= least).alias("sufficient"))


def slope(counts: DataFrame, group: str, value: str, days: int, last: DataFrame) -> DataFrame:
    """Least squares over the last `days` calendar days (last: one row with last_day); null under three points; a flat line has r2 1."""
    near = counts.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("last_day", days))
    x, y = F.datediff("day", F.date_sub("last_day", days - 1)).cast("double"), F.col(value).cast("double")
    own = near.groupBy(group).agg(F.regr_slope(y, x).alias("s"), F.regr_r2(y, x).alias("r"), F.count("*").alias("points"))
    return own.select(group, "points", F.when(F.col("points") >= 3, half_up(F.col("s"))).alias("slope"), F.when(F.col("points") >= 3, half_up(F.col("r"))).alias("r2"))


def change(counts: DataFrame, group: str, value: str, days: int = 7) -> DataFrame:
    """The last `days` observed days against those before; null rate if those sum to 0, insufficient if there are fewer."""
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("day"))))
    now, before = (F.coalesce(F.sum(F.when(F.col("r").between(a, b), F.col(value))), F.lit(0)) for a, b in ((1, days), (days + 1, 2 * days)))
    own = ranked.groupBy(group).agg(now.alias("recent"), before.alias("previous"), F.count("*").alias("n"))
    rate = F.when((F.col("n") >= 2 * days) & (F.col("previous") > 0), half_up((F.col("recent") - F.col("previous")).cast("double") / F.col("previous")))
    return own.select(group, "recent", "previous", (F.col("n") >= 2 * days).alias("sufficient"), rate.alias("rate"))


def monthly_rank(rows: DataFrame, group: str, day: str, value: str) -> DataFrame:
    """Each month's sum by group, its rank in the month and the change since the group's previous month."""
    sums = rows.groupBy(group, F.date_trunc("month", day).cast("date").alias("month")).agg(F.sum(value).alias("total"))
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy("month").orderBy(F.desc("total"), group)))
    return ranked.withColumn("moved", F.lag("rank").over(W.partitionBy(group).orderBy("month")) - F.col("rank"))


def relative(counts: DataFrame, group: str, value: str, short: int = 30, long: int = 90) -> DataFrame:
    """A group's short mean over its long one (over days with rows, up to the last day of all), against the same of all groups together, less 1; null where a mean is 0 or missing."""
    last = counts.agg(F.max("day").alias("_last"))
    daily = counts.groupBy("day").agg(F.sum(value).alias(value))

    def ratio(rows: DataFrame, *by: str) -> DataFrame:
        near = rows.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("_last", long))
        return near.groupBy(*by).agg((F.avg(F.when(F.col("day") > F.date_sub("_last", short), F.col(value))) / F.nullif(F.avg(value), F.lit(0.0))).alias("ratio"))

    whole = ratio(daily).select(F.nullif("ratio", F.lit(0.0)).alias("_all"))
    return ratio(counts, group).crossJoin(F.broadcast(whole)).select(group, half_up(F.col("ratio")).alias("ratio"), half_up(F.col("ratio") / F.col("_all") - 1).alias("relative"))


def month_change(ranked: DataFrame, group: str) -> DataFrame:
    """Rank in the first and the last month of each group (columns month and rank) and the places won between them."""
    own = ranked.groupBy(group).agg(F.min_by("rank", "month").alias("first_rank"), F.max_by("rank", "month").alias("last_rank"))
    return own.withColumn("won", F.col("first_rank") - F.col("last_rank"))
