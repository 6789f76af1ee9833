"""Places for what is new: a choice under a cap for each source, drawn again while it is too concentrated."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slots(base: int, quota: float) -> int:
    """So many places that they are the quota of all, halves up; none for a quota outside (0, 1) or without base."""
    return math.floor(base * quota / (1 - quota) + 0.5) if 0 < quota < 1 and base > 0 else 0


def hhi_of(sources: list[str]) -> float:
    """The Herfindahl index of a list of sources; 0 for an empty one."""
    return sum((n / len(sources)) ** 2 for n in Counter(sources).values())


def _picked(heads: list[tuple[str, int]], left: dict[str, int], k: int) -> list[tuple[str, int]]:
    return [h for h in heads if h[1] <= left[h[0]]][:k]


def redraw(heads: list[tuple[str, int]], sizes: dict[str, int], k: int, cap: float) -> tuple[list[int], list[str]]:
    """The places in heads (source, its place within the source; in order) that are chosen, and the sources that were demoted.

    Taking the last candidates of the most concentrated source one by one changes nothing until a chosen one is among them, so they go at once.
    """
    left, demoted = dict(sizes), []
    chosen = _picked(heads, left, k)
    while chosen and hhi_of([s for s, _ in chosen]) > cap:
        count = Counter(s for s, _ in chosen)
        top = min(count, key=lambda s: (-count[s], s))
        if count[top] <= 1:
            break
        fewer = left | {top: count[top] - 1}
        again = _picked(heads, fewer, k)
        # The candidates that weren't chosen have been taken before the one that empties a place.
        if left[top] > count[top] and top not in demoted:
            demoted.append(top)
        if len(again) < len(chosen):
            break
        left, chosen = fewer, again
        if top not in demoted:
            demoted.append(top)
    place = {h: i for i, h in enumerate(heads)}
    return [place[h] for h in chosen], demoted


def redrawn(candidates: DataFrame, group: str, source: str, order: list[Column], k: int, source_cap: float, hhi_cap: float) -> DataFrame:
    """The chosen candidates of each group with rank, hhi (3 places) and demoted_sources, as the loop over its whole sorted list gives them.

    order should end in something unique. A source's first candidate is never taken away, and so the first k of those that are left lie among the
    first floor(k * source_cap) (one at least) of the k sources whose first candidates lead: these, k * k at most, are what a group
    sends to its task, with the number of all of the source's candidates. Spark's limits hold before the shuffle. A null source is one of its own.
    """
    allowed = max(1, math.floor(k * source_cap))
    c, name = F.col, F.coalesce(F.concat(F.lit("s"), source), F.lit("x"))
    own = candidates.withColumn("_s", name)
    heads = own.withColumn("_r", F.row_number().over(W.partitionBy(group, "_s").orderBy(*order))).where(c("_r") <= allowed)
    leads = heads.where("_r = 1").withColumn("_l", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(c("_l") <= k).select(c(group).alias("_g"), c("_s").alias("_t"))
    sizes = own.groupBy(c(group).alias("_h"), c("_s").alias("_u")).agg(F.count("*").alias("_n"))
    few = heads.join(leads, c(group).eqNullSafe(c("_g")) & (c("_s") == c("_t"))).join(sizes, c(group).eqNullSafe(c("_h")) & (c("_s") == c("_u"))).drop("_g", "_t", "_h", "_u")
    few = few.withColumn("_p", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    keys = few.select(c(group), "_p", "_s", "_r", "_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p", ignore_index=True)
        heads = list(zip(pdf["_s"], pdf["_r"].astype(int), strict=True))
        at, demoted = redraw(heads, dict(zip(pdf["_s"], pdf["_n"].astype(int), strict=True)), k, hhi_cap)
        hhi = math.floor(hhi_of([heads[i][0] for i in at]) * 1000 + 0.5) / 1000
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(at), "_p": pdf["_p"].iloc[at].to_list(), "rank": range(1, len(at) + 1), "hhi": hhi, "demoted_sources": [[s[1:] for s in demoted]] * len(at)})

    kind = dict(candidates.dtypes)[group]
    chosen = keys.groupBy(group).applyInPandas(run, f"`{group}` {kind}, _p int, rank int, hhi double, demoted_sources array<string>")
    chosen = chosen.withColumnRenamed(group, "_g").withColumnRenamed("_p", "_q")
    return few.join(chosen, c(group).eqNullSafe(c("_g")) & (c("_p") == c("_q"))).drop("_g", "_q", "_p", "_s", "_r", "_n")
