"""Topics found in the items themselves: pairs of terms over two windows of seven days, scored, and a varied choice of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rules import topic_score, window_status

#: Terms of an item that form pairs, by code point, as many as titles have: pairs grow with the square. None takes all.
TERMS = 36


def term_pairs(items: DataFrame, terms: str = "terms", most: int | None = TERMS) -> DataFrame:
    """items with columns a and b for each pair of their first `most` distinct terms (None: of all)."""
    own = F.array_sort(F.array_distinct(terms))
    own = own if most is None else F.slice(own, 1, most)
    pair = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return items.withColumn("_p", F.explode(pair)).select(*items.columns, "_p.a", "_p.b")


def candidates(items: DataFrame, coverage: DataFrame, end: str, most: int | None = TERMS) -> DataFrame:
    """Pairs of terms in two items or more of the 14 days up to `end`: a, b, recent, previous, sources, latest, status and score.

    items: item, day, host, terms, one row for each item. coverage: the days (column day) of which anything is known.
    """
    day, last = F.col("day"), F.lit(end).cast("date")
    near = items.where(day.between(F.date_sub(last, 13), last))
    now = day >= F.date_sub(last, 6)
    pairs = term_pairs(near, most=most).groupBy("a", "b").agg(
        F.count_if(now).alias("recent"), F.count_if(~now).alias("previous"), F.count_distinct(F.when(now, F.col("host"))).alias("sources"),
        F.max("day").alias("latest"), F.bool_or(day >= F.date_sub(last, 1)).alias("_fresh"),
    ).where("recent + previous >= 2")
    known = coverage.select("day").distinct()
    whole = known.agg((F.count_if(day.between(F.date_sub(last, 13), F.date_sub(last, 7))) == 7).alias("_before"), (F.count_if(day.between(F.date_sub(last, 6), last)) == 7).alias("_now"))
    c = F.col
    own = pairs.crossJoin(F.broadcast(whole))
    status, score = window_status(c("_before"), c("_now"), c("recent"), c("previous")), topic_score(c("recent"), c("sources"), c("_fresh"))
    return own.select("a", "b", "recent", "previous", "sources", "latest", status.alias("status"), score.cast("double").alias("score"))


def selected(found: DataFrame, items: DataFrame, end: str, limit: int = 6, overlap: float = 0.65, most: int | None = TERMS) -> DataFrame:
    """Up to `limit` candidates with two recent items or more, in the order of the choice (column rank).

    Each time the greatest score / (1 + 2 * terms chosen before) wins, ties by a and b; who shares `overlap` or more of
    the smaller one's items with one chosen before is out. One job for each choice; only the chosen terms come to the driver.
    """
    last = F.lit(end).cast("date")
    rest = found.where("recent >= 2").persist()
    kept = [rest]
    near = items.where(F.col("day").between(F.date_sub(last, 13), last)).select("item", "terms")
    members = term_pairs(near, most=most).select("a", "b", "item").join(rest.select("a", "b"), ["a", "b"], "left_semi").persist()
    kept.append(members)
    used: list[str] = []
    chosen: list[tuple[str, str]] = []
    while len(chosen) < limit:
        shared = sum((F.col(t).isin(*used).cast("int") for t in ("a", "b")), F.lit(0)) if used else F.lit(0)
        best = rest.orderBy(F.desc(F.col("score") / (1 + 2 * shared)), "a", "b").select("a", "b").first()
        if best is None:
            break
        chosen.append((best["a"], best["b"]))
        used += [t for t in chosen[-1] if t not in used]
        mine = members.where((F.col("a") == best["a"]) & (F.col("b") == best["b"])).select("item").withColumn("_in", F.lit(1))
        both = members.join(mine, "item", "left").groupBy("a", "b").agg(F.count("*").alias("_n"), F.count("_in").alias("_k"))
        both = both.crossJoin(F.broadcast(mine.agg(F.count("*").alias("_m"))))
        out = both.where(F.col("_k").cast("double") / F.least("_n", "_m") >= overlap).select("a", "b")
        rest = rest.join(out, ["a", "b"], "left_anti").persist()
        kept.append(rest)
    for t in kept:
        t.unpersist()
    ranks = found.sparkSession.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(chosen)], "a string, b string, rank int")
    return found.join(F.broadcast(ranks), ["a", "b"])
