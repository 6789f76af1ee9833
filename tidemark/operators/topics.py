"""Topics by lexicon, and what is counted of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import half_up
from tidemark.operators.rules import financial_relevance, weighted

#: topic -> terms
Lexicon = dict[str, tuple[str, ...]]


def pattern(terms: tuple[str, ...]) -> str:
    """One expression for all terms on lower-case text: ASCII terms between other than letters and digits, the rest anywhere."""
    plain = [re.escape(t.lower()) for t in terms if t.strip() and t.isascii()]
    rest = [re.escape(t.lower()) for t in terms if t.strip() and not t.isascii()]
    parts = ([f"(^|[^a-z0-9])({'|'.join(plain)})([^a-z0-9]|$)"] if plain else []) + rest
    return "|".join(parts) or r"[^\s\S]"


def matched(items: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """items with a row for each topic that it matches; a topic's pattern is a literal, so there is no join and no shuffle."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*(F.when(low.rlike(pattern(t)), F.lit(k)) for k, t in lexicon.items())))
    return items.withColumn("topic", F.explode(found))


def daily_counts(hits: DataFrame, day: str, item: str) -> DataFrame:
    return hits.groupBy("topic", F.col(day).alias("day")).agg(F.count("*").alias("occurrences"), F.count_distinct(item).alias("unique_items"))


def totals(hits: DataFrame, day: str, item: str, observed_days: DataFrame) -> DataFrame:
    """Occurrences, distinct items, active days and their share of the days with any item (one row: n_days); hits are summed by day and item before they meet."""
    pre = hits.groupBy("topic", F.col(day).alias("_d"), F.col(item).alias("_i")).agg(F.count("*").alias("_n"))
    own = pre.groupBy("topic").agg(F.sum("_n").alias("occurrences"), F.count_distinct("_i").alias("unique_items"), F.count_distinct("_d").alias("active_days"))
    return own.crossJoin(F.broadcast(observed_days)).select("topic", "occurrences", "unique_items", "active_days", half_up(F.col("active_days").cast("double") / F.col("n_days")).alias("active_day_rate"))


def concentration(rows: DataFrame, group: str, source: str) -> DataFrame:
    """Herfindahl index of the sources in each group, and the effective number of sources, from counts that are summed before they meet."""
    counts = rows.groupBy(group, source).agg(F.count("*").alias("n"))
    sums = counts.groupBy(group).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"), F.count("*").alias("sources"))
    hhi = F.col("s").cast("double") / (F.col("t") * F.col("t"))
    return sums.select(group, "sources", half_up(hhi).alias("hhi"), half_up(1 / hhi).alias("effective_sources"))


def top_sources(rows: DataFrame, group: str, source: str, n: int) -> DataFrame:
    counts = rows.groupBy(group, source).agg(F.count("*").alias("n"))
    order = W.partitionBy(group).orderBy(F.desc("n"), source)
    whole = F.sum("n").over(W.partitionBy(group))
    return counts.select(group, source, "n", half_up(F.col("n").cast("double") / whole).alias("share"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)


def repeats(rows: DataFrame, key: Column, source: str, day: str) -> DataFrame:
    """Keys (such as normalised titles) that occur more than once: count, sources, days and density; empty keys don't count."""
    # The key is worked out once: a condition on it would be moved below the grouping and work it out again, one on an aggregate isn't.
    pre = rows.groupBy(key.alias("key"), F.col(source).alias("_s"), F.col(day).alias("_d")).agg(F.count("*").alias("_n"))
    groups = pre.groupBy("key").agg(F.sum("_n").alias("n"), F.count_distinct("_s").alias("sources"), F.count_distinct("_d").alias("days"), F.max(F.length("key")).alias("_l")).where("_l > 0")
    density = half_up(F.col("n").cast("double") / F.col("days"))
    call = F.when((density >= 2) & (F.col("sources") >= 3), "syndicated").when(density >= 1.2, "mixed").otherwise("organic")
    return groups.where("n > 1").select("key", "n", "sources", "days", density.alias("density"), call.alias("call"))


def pairs(rows: DataFrame, item: str, terms: Column, least: int) -> DataFrame:
    """Unordered pairs of terms in one item, with the number of items (at least `least`)."""
    own = rows.select(item, terms.alias("t"))
    pair = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return own.select(item, F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count_distinct(item).alias("items")).where(F.col("items") >= least)


#: The weights of a topic's score, and what counts as full.
WEIGHTS = (("relevance", 0.20), ("recency", 0.20), ("novelty", 0.15), ("financial_relevance", 0.20), ("evidence_quality", 0.15), ("topic_weight", 0.10))


def scored(hits: DataFrame, item: str, day: str, fresh: Column, financial: Column, quality: Column, days: DataFrame, full: int, base: float = 0.3) -> DataFrame:
    """The parts of each topic's score (each rounded to 3 places) and their weighted sum.

    fresh, financial and quality are conditions on a hit; days: one row with n_days; full: hits from which relevance is 1.
    Distinct items are counted over a grouping by (topic, item), so that hot topics are summed before they meet.
    """
    own = hits.groupBy("topic", item).agg(F.count("*").alias("_n"), F.collect_set(day).alias("_days"), F.bool_or(fresh).alias("_fresh"), F.count_if(financial).alias("_f"), F.count_if(quality).alias("_q"))
    sums = own.groupBy("topic").agg(F.sum("_n").alias("total"), F.count("*").alias("items"), F.count_if("_fresh").alias("_fresh"), F.sum("_f").alias("_f"), F.sum("_q").alias("_q"))
    active = own.select("topic", F.explode("_days").alias("_d")).groupBy("topic").agg(F.count_distinct("_d").alias("_active"))
    rate = lambda a, b: F.col(a).cast("double") / F.col(b)
    parts = {
        "relevance": F.least(F.lit(1.0), F.col("total") / F.lit(float(full))),
        "recency": F.col("_active").cast("double") / F.greatest(F.lit(1), "n_days"),
        "novelty": rate("_fresh", "items"),
        "financial_relevance": financial_relevance(F.lit(base), rate("_f", "total")),
        "evidence_quality": rate("_q", "total"),
        "topic_weight": F.lit(1.0),
    }
    wide = sums.join(active, "topic").crossJoin(F.broadcast(days)).select("topic", "total", "items", *(half_up(c, 3).alias(k) for k, c in parts.items()))
    return wide.withColumn("score", weighted([(F.col(k), w) for k, w in WEIGHTS]))
