"""Mixing sources to target weights by fitting budgets with subset sums over document lengths.

Targets: sources in order of code point (null last) get the weights in turn, share RATE of all words by
weight, and stop at CAP times their own words; what is above goes to the others by weight.

Each source's target is filled in whole passes over the source and a part of one more. That part is fitted on
the source's histogram of exact lengths: of each length the same share of its documents, rounded down, then
greedily more from long to short until about the longest length not yet taken (or KNAPSACK words, if that is
more) is left, and all of what is left by bounded-knapsack dynamic programming over the documents not yet
taken, whatever their length; sums are in units of the lengths' greatest common divisor, at most twice the
longest length or KNAPSACK words. Only counts decide; which documents of a length are meant is
the order of a seeded hash. A histogram has as many rows as lengths occur in the source, so one task holds
one at a time; documents never meet in one task: those of a length are ranked in slices of about SLICE rows.

Null texts and texts without words have 0 words and are never taken; null sources are a source of their own; an empty table
gives an empty result; repeated rows count each by itself (equal ones in any order, which gives equal rows).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD

WEIGHTS, RATE, CAP, SLICE = (3, 1, 2), 1.5, 2.0, 1000
#: Words that greedy steps leave to the knapsack, or the longest untaken length where that is more.
KNAPSACK = 20_000


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source (s and its name, x for null: so nulls are equal and come last), size: the number of words, and more columns."""
    return docs.select("doc_id", *more, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("x")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, rate: float = RATE, cap: float = CAP) -> DataFrame:
    """source, source_size and target, from a row for each source with its source_size."""
    named = W.orderBy("source")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    by_limit = W.orderBy("limit", "source")
    before, after = by_limit.rowsBetween(W.unboundedPreceding, -1), by_limit.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    # The level is the words for each unit of weight: the first at which all sources not yet at their cap stay below it.
    full = per_source.withColumn("weight", turn).withColumn("limit", F.col("source_size") * cap / F.col("weight"))
    full = full.withColumn("level", (F.sum("source_size").over(everything) * rate - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.first(F.when(F.col("level") <= F.col("limit"), F.col("level")), True).over(by_limit.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return full.select("source", "source_size", F.least(F.col("source_size") * cap, F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def fit(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to the budget as this finds, not above."""
    total = int((size * count).sum())
    if budget <= 0 or not total:
        return np.zeros(len(size), np.int64)
    if budget >= total:
        return count.astype(np.int64)
    take = np.array([int(c) * budget // total for c in count], np.int64)
    left = budget - int((size * take).sum())
    spare = count - take
    room = max(KNAPSACK, int(size[spare > 0].max()))
    for i in np.argsort(-size, kind="stable"):
        if left <= room:
            break
        more = int(min(spare[i], (left - room) // max(1, size[i])))
        take[i] += more
        spare[i] -= more
        left -= more * int(size[i])
    # Bounded knapsack: a length with many spare documents is entered as groups of 1, 2, 4, ... documents.
    usable = size[(spare > 0) & (size > 0) & (size <= left)]
    unit = int(np.gcd.reduce(usable)) if len(usable) else 1
    scaled, top = size // unit, left // unit if len(usable) else 0
    reach = np.full(top + 1, -1, np.int32)  # the group by which a sum is first reached
    have = np.zeros(top + 1, bool)
    have[0] = True
    groups = []
    for i in np.argsort(-size, kind="stable"):
        n, k = int(min(spare[i], left // max(1, size[i]))), 1
        while n > 0 and size[i] and not have[top]:
            part = min(k, n)
            groups.append((i, part))
            step = int(scaled[i]) * part
            new = have[: top + 1 - step] & ~have[step:]
            reach[step:][new] = len(groups) - 1
            have[step:] |= new
            n, k = n - part, k * 2
    at = int(np.flatnonzero(have)[-1])
    while at:  # a sum's groups have falling numbers, as each was reached by a group later than the rest of it
        i, part = groups[reach[at]]
        take[i] += part
        at -= int(scaled[i]) * part
    return take


def plan(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, size, count, passes and extra: whole passes over the source and how many documents of each length once more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        size, count = pdf["size"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64)
        own = int((size * count).sum())
        passes = int(pdf["target"].iloc[0] // own) if own else 0
        pdf["passes"], pdf["extra"] = passes, fit(size, count, round(pdf["target"].iloc[0] - passes * own))
        return pdf[["source", "size", "count", "passes", "extra"]]

    return histogram.join(budgets, "source").groupBy("source").applyInPandas(run, "source string, size long, count long, passes long, extra long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rate: float = RATE, cap: float = CAP, seed: int = 11, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (the words taken of each document, repeats counted) and times; row too, if given."""
    more = [] if row is None else [row.alias("row")]
    own, more = sizes(docs, *more), ["row"] * len(more)
    histogram = own.groupBy("source", "size").agg(F.count("*").alias("count"))
    per_source = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), weights, rate, cap)
    lengths = plan(histogram, per_source)
    placed = own.join(lengths, ["source", "size"]).withColumn("hash", F.xxhash64(F.lit(seed), "doc_id"))
    placed = placed.withColumn("slice", F.pmod("hash", F.ceil(F.col("count") / SLICE)))
    in_slice = placed.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(in_slice.select("source", "size", "slice", before.alias("before")), ["source", "size", "slice"])
    rank = F.col("before") + F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("hash", "doc_id"))
    times = F.when(F.col("size") > 0, F.col("passes") + (rank <= F.col("extra")).cast("long")).otherwise(F.lit(0).cast("long"))
    taken = ranked.select("doc_id", *more, "source", "size", (F.col("size") * times).alias("taken"), times.alias("times"))
    return taken.join(per_source, "source").select("doc_id", *more, "source", "size", "source_size", "target", "taken", "times")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of docs."""
    row = F.xxhash64(*docs.columns)
    # Equal rows have one hash: together they stand as often as the mix takes any of them.
    chosen = mix(docs, row=row, **options).groupBy("row").agg(F.sum("times").alias("times")).where("times > 0")
    whole = docs.select(row.alias("row"), F.struct(*docs.columns).alias("whole")).join(chosen.hint("merge"), "row").groupBy("row", "times").agg(F.first("whole").alias("whole"))
    return whole.select("whole", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("whole.*")


def result(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
