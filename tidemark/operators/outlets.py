"""Names of sources that mean one outlet: components of names, of which one holds the other.

A name loses what stands in brackets, case and punctuation. Two names are one outlet if the words of one stand in a row in the other, at its
beginning whatever their number or anywhere up to RUN of them (so names in two languages side by side meet each alone), or if an address in
brackets spells the other (`AI News (artificialintelligence-news.com)`, `Artificial Intelligence News`). Preprint servers are one outlet. Blank
names and those that say that there is none are no outlet. Names meet by equal runs of words, never pair by pair; components are found by rounds of
joins over the distinct names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.tables import Steps

RUN = 8
# Names that name nobody, and what all preprint servers are called.
NOBODY = ("", "未標示", "未標示來源", "n a", "na", "none", "unknown")
PREPRINTS, PREPRINT = r"(?i)\b(arxiv|biorxiv|medrxiv|ssrn|preprint)\b", "preprint"


def plain_name(name: Column) -> Column:
    """Without brackets, lower case, words parted by one space; empty for nobody."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"[(（][^)）]*[)）]", " ")
    words = F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(name, F.lit("")).rlike(PREPRINTS), PREPRINT).when(words.isin(*NOBODY), "").otherwise(words)


def _spelled(name: Column) -> Column:
    """The letters of an address in brackets without its last part; empty if there is none."""
    inner = F.regexp_extract(F.lower(name), r"[(（]\s*(?:https?://)?(?:www\.)?([a-z0-9.-]+)\.[a-z]{2,}[^)）]*[)）]", 1)
    return F.regexp_replace(inner, "[^a-z0-9]", "")


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """id and least (the least id that links reach) of every id in the edges a, b."""
    c = F.col
    both = steps.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = steps.keep(both.groupBy(c("a").alias("id")).agg(F.least(c("a"), F.min("b")).alias("least")))
    while True:
        near = both.join(labels, c("b") == c("id")).groupBy(c("a").alias("id")).agg(F.min("least").alias("near"))
        new = labels.join(near, "id").select("id", "least", F.least("least", "near").alias("new"))
        # A label's own label may be less by now: following it halves the way.
        after = labels.select(c("id").alias("new"), c("least").alias("far"))
        new = steps.keep(new.join(after, "new", "left").select("id", "least", F.least("new", F.coalesce("far", "new")).alias("new")))
        labels = new.select("id", c("new").alias("least"))
        if new.where("new <> least").isEmpty():
            return steps.keep(labels)


def outlets(names: DataFrame, name: str) -> DataFrame:
    """name (distinct) and outlet: the least plain name of its component; null for nobody."""
    with Steps(names.sparkSession) as steps:
        own = steps.keep(names.select(F.col(name).alias("raw")).distinct().select("raw", plain_name(F.col("raw")).alias("plain"), _spelled(F.coalesce("raw", F.lit(""))).alias("spelled")))
        plain = own.where("plain <> ''").select("plain").distinct().withColumn("w", F.split("plain", " ")).withColumn("n", F.size("w"))
        starts = F.sequence(F.lit(1), F.col("n"))
        inner = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("n") - i + 1)), lambda k: F.array_join(F.slice("w", i, k), " "))))
        first = F.transform(starts, lambda k: F.array_join(F.slice("w", F.lit(1), k), " "))
        runs = plain.select("plain", F.explode(F.array_distinct(F.concat(inner, first))).alias("run")).where("run <> plain")
        holds = runs.join(plain.select(F.col("plain").alias("run")), "run").select(F.col("plain").alias("a"), F.col("run").alias("b"))
        letters = plain.select(F.col("plain").alias("b"), F.replace("plain", F.lit(" "), F.lit("")).alias("spelled"))
        spelled = own.where("spelled <> '' AND plain <> ''").select(F.col("plain").alias("a"), "spelled").join(letters, "spelled").select("a", "b")
        found = components(holds.union(spelled), steps)
        full = own.join(found, F.col("plain") == F.col("id"), "left")
        return steps.result(full.select(F.col("raw").alias(name), F.when(F.col("plain") != "", F.coalesce("least", "plain")).alias("outlet")))


def counted(rows: DataFrame, group: str, name: str, of: DataFrame) -> DataFrame:
    """group and outlets: how many different ones its rows come from, by the table `of` (from outlets)."""
    named = rows.select(group, F.col(name).alias("_n")).distinct()
    both = named.join(of.select(F.col(name).alias("_m"), "outlet"), F.col("_n").eqNullSafe(F.col("_m")), "left")
    return both.groupBy(group, "outlet").agg(F.lit(1).alias("_one")).groupBy(group).agg(F.count("outlet").alias("outlets"))
