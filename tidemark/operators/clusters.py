"""Topics with their evidence: distinct items, why each belongs, the best few, and topics in order of their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVIDENCE, SOURCES, TERMS = 8, 10, 4


def high_quality(verified: Column, source: Column, url: Column, hints: tuple[str, ...]) -> Column:
    """Verified, or from a source or address that holds one of the hints."""
    low = [F.lower(F.coalesce(x, F.lit(""))) for x in (source, url)]
    named = [F.contains(x, F.lit(h.lower())) for x in low for h in hints]
    return F.coalesce(verified, F.lit(False)) | (F.greatest(*(n.cast("int") for n in named), F.lit(0)) > 0)


def evidence(hits: DataFrame, item: str, order: list[str], quality: Column, n: int = EVIDENCE) -> DataFrame:
    """The n best items of each topic: its columns as it first occurred (by the order, distinct within a topic), reason and rank.

    hits: topic, terms, day, title and others. Better ones are of quality, then of later days, then by title and item. Items are met once by (topic, item),
    with partial results before the shuffle, and under the limit Spark drops rows of a hot topic in each partition before it ranks them.
    """
    columns = [c for c in hits.columns if c not in ("topic", item)]
    first = hits.groupBy("topic", item).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_e")).select("topic", item, "_e.*")
    best = W.partitionBy("topic").orderBy(F.desc("_q"), F.desc("day"), "title", item)
    own = first.withColumn("_q", F.coalesce(quality, F.lit(False))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return own.withColumn("reason", F.concat(F.lit("Matched "), F.array_join(F.slice("terms", 1, TERMS), ", "))).drop("_q")


def clusters(scores: DataFrame, hits: DataFrame, found: DataFrame, item: str, category: str, source: str) -> DataFrame:
    """scores (topic, score and others) with categories and the first SOURCES sources by name, the evidence as a list, and rank: by score, then topic.

    Names are made distinct before they meet; sources are ranked in the limit's way, so a topic's list is never longer. A null name doesn't count.
    """
    names = hits.select("topic", F.col(category).alias("_c")).where("_c is not null").distinct().groupBy("topic").agg(F.sort_array(F.collect_list("_c")).alias("categories"))
    places = hits.select("topic", F.col(source).alias("_s")).where("_s <> ''").distinct().withColumn("_r", F.row_number().over(W.partitionBy("topic").orderBy("_s"))).where(F.col("_r") <= SOURCES)
    places = places.groupBy("topic").agg(F.sort_array(F.collect_list("_s")).alias("sources"))
    lists = found.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", item, "title", "day", "reason"))), lambda x: F.struct(x[item].alias(item), x["title"].alias("title"), x["day"].alias("day"), x["reason"].alias("reason"))).alias("evidence"))
    none = F.expr("CAST(array() AS array<string>)")
    own = scores.join(names, "topic", "left").join(places, "topic", "left").join(lists, "topic", "left").withColumns({"categories": F.coalesce("categories", none), "sources": F.coalesce("sources", none)})
    # A row for each topic of a lexicon, so one task ranks them.
    return own.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "topic")))
