"""Feedback logs: latest ratings, decayed scores, weights, quotas and canaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clamp, decay, half_up


def latest(events: DataFrame, subject: str, at: str, line: str) -> DataFrame:
    """The last event of each subject; of those at one time the first in the log."""
    w = W.partitionBy(subject).orderBy(F.desc(at), line)
    return events.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def decayed_score(ratings: DataFrame, group: str, score: Column, age_days: Column, half_life: float = 30.0) -> DataFrame:
    w = decay(age_days, half_life)
    return ratings.groupBy(group).agg(F.count("*").alias("ratings"), half_up(F.sum(w * score) / F.sum(w)).alias("score"))


def weights(events: DataFrame, group: str, accepted: Column, corrected: Column, step: float = 0.1) -> DataFrame:
    """1 + step (accepted - corrected) within 0.5 and 1.5, and its direction."""
    own = events.groupBy(group).agg(F.count_if(accepted).alias("accepted"), F.count_if(corrected).alias("corrected"))
    net = F.col("accepted") - F.col("corrected")
    way = F.when(net > 0, "up").when(net < 0, "down").otherwise("neutral")
    return own.select(group, "accepted", "corrected", half_up(clamp(1 + step * net, 0.5, 1.5)).alias("weight"), way.alias("direction"))


def capped(rows: DataFrame, group: str, order: list[Column], each: int, total: int) -> DataFrame:
    """At most `each` of a group and `total` altogether, by the order: with its last column unique, the greedy choice."""
    own = rows.withColumn("in_group", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("in_group") <= each)
    return own.orderBy(*order).limit(total)


def canary(nightly: DataFrame, group: str, night: str, value: str, nights: int = 3, baseline: int = 7, drop_pp: float = 10.0) -> DataFrame:
    """The mean of the last `nights` against the median of the `baseline` before: revert where it fell by more than drop_pp points."""
    r = nightly.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(night))))
    seen = F.avg(F.when(F.col("r") <= nights, F.col(value)))
    base = F.median(F.when((F.col("r") > nights) & (F.col("r") <= nights + baseline), F.col(value)))
    own = r.groupBy(group).agg(seen.alias("o"), base.alias("b"), F.count("*").alias("n"))
    drop = F.floor((F.col("b") - F.col("o")) * 1e6 + 0.5) / 1e4
    verdict = F.when(F.col("n") < nights + 1, "waiting").when(drop > drop_pp, "revert").otherwise("confirm")
    return own.select(group, half_up(F.col("b")).alias("baseline"), half_up(F.col("o")).alias("observed"), half_up(drop).alias("drop_pp"), verdict.alias("verdict"))


def allocated(proposals: DataFrame, key: str, group: str, eligible: Column, order: list[Column], each: int, total: int) -> DataFrame:
    """proposals with `outcome`: chosen, ineligible, group_cap or total_cap, as a loop in this order would give them.

    Spark keeps at most `each` rows of a group in every partition before the shuffle, so the window is small; a group's last
    chosen or refused row decides the outcome of the others. The order should end in something unique, the keys are.
    """
    fit = F.coalesce(eligible, F.lit(False))
    head = proposals.where(fit).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= each)
    ranked = head.orderBy(*order).limit(total).select(key, F.lit("chosen").alias("_o"))
    capped_out = head.select(key, F.lit("total_cap").alias("_t"))
    own = proposals.join(F.broadcast(ranked), key, "left").join(capped_out, key, "left")
    outcome = F.when(~fit, "ineligible").otherwise(F.coalesce("_o", "_t", F.lit("group_cap")))
    return own.withColumn("outcome", outcome).drop("_o", "_t")


def silence(today: str, nights: int, metrics: DataFrame, ledger: DataFrame, cursor: DataFrame) -> DataFrame:
    """One row: state (yellow if neither ratings nor ledger entries came in the last nights, else green) and reasons.

    metrics: date, ratings; ledger: date, of human ratings; cursor: one row or none with last_ts, the epoch where it never moved.
    """
    since = F.date_sub(F.lit(today).cast("date"), nights - 1)
    near = lambda t: t.where(F.col("date").cast("date").between(since, F.lit(today).cast("date")))
    own = near(metrics).agg(F.count("*").alias("_rows"), F.coalesce(F.sum("ratings"), F.lit(0)).alias("ratings"), F.count_distinct("date").alias("nights_observed"))
    own = own.crossJoin(near(ledger).agg(F.count("*").alias("ledger_rows"))).crossJoin(cursor.agg(F.max(F.struct("last_ts")).alias("_c")))
    epoch = F.lit("1970-01-01").cast("timestamp")
    reasons = F.array_compact(F.array(
        F.when(F.col("_rows") == 0, "metrics_missing").when(F.col("ratings") == 0, "metrics_zero"),
        F.when(F.col("ledger_rows") == 0, "ledger_zero"),
        F.when(F.col("_c").isNull(), "cursor_missing").when(~(F.coalesce(F.col("_c.last_ts").cast("timestamp"), epoch) > epoch), "cursor_epoch"),
    ))
    state = F.when((F.col("ratings") == 0) & (F.col("ledger_rows") == 0), "yellow").otherwise("green")
    return own.select(state.alias("state"), reasons.alias("reasons"), "ratings", "ledger_rows", "nights_observed")
