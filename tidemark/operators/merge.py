"""Joins and set operations on keyed tables of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import ingest_url


def first_by_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first by the order (which should end in something unique)."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def novel(items: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """items with is_new: the key isn't among the older ones; an empty key is always new."""
    known = older.select(F.col(key).alias("_key")).where("_key != ''").distinct().withColumn("_old", F.lit(True))
    return items.join(known, F.col(key) == F.col("_key"), "left").withColumn("is_new", F.col("_old").isNull()).drop("_key", "_old")


def newest_wins(a: DataFrame, b: DataFrame, key: str, stamp: str, value: str) -> DataFrame:
    """Merge of two keyed tables: the later stamp wins, a's on a tie."""
    left, right = (t.select(F.col(key), F.col(stamp).alias(f"s{n}"), F.col(value).alias(f"v{n}")) for n, t in ((1, a), (2, b)))
    later = F.coalesce(F.col("s2") > F.col("s1"), F.col("s1").isNull())
    return left.join(right, key, "full_outer").select(key, F.greatest("s1", "s2").alias(stamp), F.when(later, F.col("v2")).otherwise(F.col("v1")).alias(value))


def without_deleted(records: DataFrame, tombs: DataFrame, key: str, stamp: str, deleted: str) -> DataFrame:
    """Records that no tombstone of the same or a later time covers."""
    return records.join(tombs.select(key, deleted), key, "left").where(F.col(deleted).isNull() | (F.col(deleted) < F.col(stamp))).drop(deleted)


def filled_up(current: DataFrame, older: DataFrame, group: str, key: str, order: list, least: int) -> DataFrame:
    """current, and for groups with fewer than `least` rows as many older ones, not yet there, as are missing; is_backfill marks them."""
    have = current.groupBy(group).agg(F.count("*").alias("_n"))
    rest = older.join(current.select(key), key, "left_anti").join(have, group, "left")
    # The literal limit lets Spark drop rows of a group in each partition before the shuffle.
    rest = rest.where(F.coalesce("_n", F.lit(0)) < least).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= least)
    rest = rest.where(F.col("_r") <= least - F.coalesce("_n", F.lit(0)))
    return current.withColumn("is_backfill", F.lit(False)).unionByName(rest.select(*current.columns).withColumn("is_backfill", F.lit(True)))


def band_pairs(numbers: DataFrame, metrics: DataFrame, width: float) -> DataFrame:
    """Rows of numbers (id, v) and metrics (metric, m) with |v - m| < width: an equality join on cells a little wider than that, so that rounding loses nothing, and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / (width * 1.001))
    near = metrics.select("metric", "m", F.explode(F.array(cell("m") - 1, cell("m"), cell("m") + 1)).alias("cell"))
    return numbers.withColumn("cell", cell("v")).join(near, "cell").where(F.abs(F.col("v") - F.col("m")) < width).drop("cell")


def item_key(url: Column, *fields: Column) -> Column:
    """The key of merged items: the ingest form of an address, else the fields in lower case (as JSON); null if all are blank."""
    own = F.array(*(F.lower(F.trim(F.coalesce(f.cast("string"), F.lit("")))) for f in fields))
    page = ingest_url(url)
    return F.when(page != "", F.concat(F.lit("url:"), page)).when(F.exists(own, lambda x: x != ""), F.to_json(own))


def with_history(current: DataFrame, history: DataFrame, key: Column, date: str, since: str, until: str, now: str, limit: int) -> DataFrame:
    """Fetched items and older ones of the days from since to until, one of each key, the newest `limit`.

    Both tables have the same columns, among them seq (their order), first_seen and last_seen (texts). Of rows with one key the
    first fetched one wins, else the first old one. A fetched item takes what it leaves null from the old one; it is new if there
    is none. Rows without key or date are left out. Items of a day keep their order, fetched before old. One shuffle, by key.
    """
    names = [c for c in current.columns if c != "seq"]
    both = current.withColumn("_fetched", F.lit(True)).unionByName(history.withColumn("_fetched", F.lit(False))).withColumn("_key", key)
    both = both.where(F.col("_key").isNotNull() & F.col(date).between(since, until))
    row, at = F.struct("seq", *names), F.col("seq")
    first = lambda cond, name: F.min_by(F.when(cond, row), F.when(cond, at)).alias(name)
    own = both.groupBy("_key").agg(first(F.col("_fetched"), "_new"), first(~F.col("_fetched"), "_old"))
    fetched, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    value = {c: F.coalesce(f"_new.{c}", f"_old.{c}") for c in names}
    mine = {c: value[c].alias(c) for c in names if c not in ("first_seen", "last_seen")}
    out = own.select(
        *mine.values(), (fetched & ~known).alias("is_new"),
        F.coalesce(F.nullif(F.when(known, F.col("_old.first_seen")), F.lit("")), F.nullif(value["first_seen"], F.lit("")), F.nullif(value["last_seen"], F.lit("")), F.lit(now)).alias("first_seen"),
        F.when(fetched, F.lit(now)).otherwise(F.coalesce(F.nullif(value["last_seen"], F.lit("")), F.lit(now))).alias("last_seen"),
        (~fetched).alias("_later"), F.coalesce("_new.seq", "_old.seq").alias("_seq"),
    )
    return out.orderBy(F.desc(date), "_later", "_seq").limit(int(limit)).drop("_later", "_seq")


def answered(inputs: DataFrame, answers: DataFrame, key: str, order: str, default: dict[str, object]) -> DataFrame:
    """Every input once, with the first answer (by `order`) to it or the defaults, and `answered`; answers to unknown keys fall away."""
    rest = [c for c in answers.columns if c not in (key, order)]
    first = answers.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_a"))
    own = inputs.join(first, key, "left").select(*inputs.columns, F.col("_a").isNotNull().alias("answered"), "_a.*")
    return own.fillna({k: v for k, v in default.items() if k in rest})


def discarded(inputs: DataFrame, answers: DataFrame, key: str, order: str) -> DataFrame:
    """The answers that no input takes, with a reason: unknown_id, or duplicate_id for all but the first."""
    known = inputs.select(key).distinct().withColumn("_known", F.lit(True))
    first = answers.groupBy(key).agg(F.min(order).alias("_first"))
    own = answers.join(first, key).join(known, key, "left")
    reason = F.when(F.col("_known").isNull(), "unknown_id").when(F.col(order) > F.col("_first"), "duplicate_id")
    return own.withColumn("reason", reason).where("reason is not null").drop("_known", "_first")


def all_known(rows: DataFrame, key: str, ids: str, known: DataFrame, name: str) -> DataFrame:
    """rows (distinct keys) with `ids_known`: every element of the array `ids` is in the column `name` of known; false for an empty or null array."""
    each = rows.select(key, F.explode(ids).alias("_id"))
    bad = each.join(known.select(F.col(name).alias("_id")).distinct(), "_id", "left_anti").select(key).distinct().withColumn("_bad", F.lit(True))
    return rows.join(bad, key, "left").withColumn("ids_known", F.col("_bad").isNull() & F.coalesce(F.size(ids) > 0, F.lit(False))).drop("_bad")
