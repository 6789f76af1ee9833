"""Dated JSON snapshots (one file a day, named yyyy-mm-dd.json) as a table, and their items as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lists of a snapshot that hold items, in their order.
CATEGORIES = ("papers", "topnews", "taiwan", "china", "usa", "techtrends", "governance", "tutorials", "courses", "official_info", "models")
#: Fixed value: the source of an item that names none.
NO_SOURCE = "未標示來源"


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """date and doc of each file named after a date; a file that isn't JSON fails the job when its doc is read."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.json$", 1)
    files = spark.read.text(folder, wholetext=True).select(name.alias("date"), "value").where("date != ''")
    return files.select("date", F.parse_json("value").alias("doc"))


def first_of_date(*tables: DataFrame) -> DataFrame:
    """One row for each date, from the first table that has it; the tables share their columns."""
    ranked = [t.withColumn("_from", F.lit(i)) for i, t in enumerate(tables)]
    every = ranked[0]
    for t in ranked[1:]:
        every = every.unionByName(t)
    # A variant can't be ordered or kept by max_by, but a join on (date, table) reads the winner's row whole.
    best = every.groupBy("date").agg(F.min("_from").alias("_from"))
    return every.join(best, ["date", "_from"]).drop("_from")


def last_dates(rows: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Rows of the last n dates that there are (not calendar days); all if n is 0 or less."""
    if n <= 0:
        return rows
    last = rows.select(date).where(F.col(date).isNotNull()).distinct().orderBy(F.desc(date)).limit(int(n))
    return rows.join(F.broadcast(last), date, "left_semi")


def as_list(value: Column) -> Column:
    """A variant's rows: those of a list, of its member `items`, or of an object's only member; else null."""
    only = F.try_variant_get(value, "$", "map<string,variant>")
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        F.try_variant_get(value, "$.items", "array<variant>"),
        F.when(F.size(only) == 1, F.try_variant_get(F.element_at(F.map_values(only), 1), "$", "array<variant>")),
    )


def raw_items(days: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """date, category, category_rank, position and raw (variant) of every element; what isn't a list is passed over."""
    lists = [F.struct(F.lit(c).alias("category"), F.lit(i).alias("category_rank"), F.try_variant_get("doc", f"$.data.{c}", "array<variant>").alias("own")) for i, c in enumerate(categories)]
    each = days.select("date", F.inline(F.array(*lists)))
    return each.select("date", "category", "category_rank", F.posexplode("own").alias("position", "raw"))


def _text(*names: str) -> Column:
    """The first member that isn't empty, trimmed; empty if there is none."""
    found = [F.nullif(F.try_variant_get("raw", f"$.{n}", "string"), F.lit("")) for n in names]
    return F.trim(F.coalesce(*found, F.lit("")))


def items(days: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """The elements as items with the same columns for all categories; elements without a title are left out."""
    raw = raw_items(days, categories)
    verified = (F.try_variant_get("raw", "$.verified", "boolean")) | (F.try_variant_get("raw", "$.url_status", "string") == "verified")
    rows = raw.select(
        F.col("date").alias("snapshot"), "category", "category_rank", "position",
        _text("title_zh", "title").alias("title"), _text("title").alias("title_en"), _text("url").alias("url"),
        F.coalesce(F.nullif(_text("source", "institution", "venue"), F.lit("")), F.lit(NO_SOURCE)).alias("source"),
        F.substring(F.coalesce(F.nullif(F.try_variant_get("raw", "$.date", "string"), F.lit("")), "date"), 1, 10).alias("date"),
        _text("summary", "impact").alias("summary"), F.coalesce(verified, F.lit(False)).alias("verified"),
    )
    return rows.where("title != ''")


def haystack() -> Column:
    """The text in which topics are looked for; a missing part counts as empty and keeps its place."""
    return F.array_join(F.array(*(F.coalesce(c, F.lit("")) for c in ("title", "title_en", "summary", "source"))), " \n ")


def feeds(registry: DataFrame) -> DataFrame:
    """category and feed (variant) of the http(s) feeds in a registry (column value: JSON text); none if it isn't JSON."""
    groups = registry.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.categories", "map<string,variant>")).alias("category", "own"))
    each = groups.select("category", F.explode(F.try_variant_get("own", "$", "array<variant>")).alias("feed"))
    return each.select("category", F.try_variant_get("feed", "$.url", "string").alias("url"), "feed").where(F.col("url").rlike("^(?i:https?)://"))
