"""Days in two tiers (hot files, cold archive), their mirror, and the inventory of what should be there and is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sizes of a page, the days of the dashboard's window, and the keys of a document that hold days or instants.
PAGE, WINDOW = (1, 90), 14
DAYS = ("date", "last_date", "source_latest_date")
INSTANTS = ("time", "generated_at", "source_latest_generated_at", "last_run", "last_success", "last_missed", "started_at", "finished_at")
_CLOCK, _DAY = "([01][0-9]|2[0-3]):[0-5][0-9]", "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_OFFSET = "(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"


def valid_day(x: Column) -> Column:
    """A text of the form yyyy-mm-dd that is a day of the calendar; false for null."""
    return F.coalesce(x.rlike(f"^{_DAY}$") & F.when(x.rlike(f"^{_DAY}$"), x).try_cast("date").isNotNull(), F.lit(False))


def valid_instant(x: Column) -> Column:
    """A time of day, or a day with a time and an offset; false for null."""
    clock = f"{_CLOCK}(:[0-5][0-9])?"
    whole = x.rlike(f"^{_DAY}T{_CLOCK}(:[0-5][0-9](\\.[0-9]+)?)?{_OFFSET}$") & valid_day(F.substring(x, 1, 10))
    return F.coalesce(x.rlike(f"^{clock}$") | whole, F.lit(False))


def _members(variant: Column, path: str) -> Column:
    """The members of an object as a map of variants; empty for anything else."""
    return F.coalesce(F.try_variant_get(variant, path, "map<string,variant>"), F.expr("CAST(map() AS map<string,variant>)"))


def archived(days: DataFrame) -> DataFrame:
    """Rows of the archive from (date, payload): generated_at, item_count (the numbers of `stats`), pass_rate (text), source and the payload as it is.

    A payload that is no JSON object has no items and a blank pass_rate. Members of stats that are no numbers count 0.
    """
    v = F.col("_v")
    number = lambda x: F.when(F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double")).otherwise(0.0)
    text = lambda *paths: F.coalesce(*(F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths))
    own = days.withColumn("_v", F.try_parse_json("payload")).select(
        "date", F.coalesce(text("$.time", "$.generated_at"), F.lit("")).alias("generated_at"), F.aggregate(F.transform(F.map_values(_members(v, "$.stats")), number), F.lit(0.0), lambda a, b: a + b).cast("long").alias("item_count"),
        F.coalesce(text("$.validation.pass_rate"), F.lit("")).alias("pass_rate"), F.coalesce(text("$.source"), F.lit("local")).alias("source"), "payload",
    )
    return own


def page(archive: DataFrame, cursor: str | None = None, limit: int = 31) -> DataFrame:
    """The newest days before the cursor without their payloads, at most `limit` (1 to 90), newest first; `next` is the cursor of the next page, null on the last."""
    limit = min(max(limit, PAGE[0]), PAGE[1])
    own = archive.where(valid_day(F.col("date"))).select("date", "item_count", "pass_rate", "source")
    top = (own if cursor is None else own.where(F.col("date") < cursor)).orderBy(F.desc("date")).limit(limit + 1)
    rows = top.limit(limit)
    end = top.agg((F.count("*") > limit).alias("_more")).crossJoin(rows.agg(F.min("date").alias("_last")))
    return rows.crossJoin(F.broadcast(end)).select(*rows.columns, F.when(F.col("_more"), F.col("_last")).alias("next")).orderBy(F.desc("date"))


def day(archive: DataFrame, date: str) -> DataFrame:
    """The payload of one day as a variant; no row if there is none, or if it is no JSON."""
    return archive.where(F.col("date") == date).select("date", F.try_parse_json("payload").alias("document")).where("document is not null")


def combined(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Days of both tiers (of equal columns), the hot one where a day is in both, with `cold`."""
    rest = cold.join(hot.select("date").distinct(), "date", "left_anti")
    return hot.withColumn("cold", F.lit(False)).unionByName(rest.withColumn("cold", F.lit(True)))


def backfilled(mirror: DataFrame, hot: DataFrame, cold: DataFrame, since: str, prune: bool = False) -> DataFrame:
    """What to do with each day, all tables being (date, payload): action, and the payload that is to be written where it is hot or cold.

    hot: written anew; cold: in neither the mirror nor the hot tier, so it comes from the archive; failed: its payload there is no JSON; skipped: the
    mirror has it already; pruned: the mirror's days before `since`, if asked for. Payloads aren't shuffled but for those of the archive's missing days.
    """
    recent, dates = F.col("date") >= since, lambda t: t.select("date").where("date is not null").distinct()
    new, held = hot.where(recent), dates(mirror)
    bad = F.try_parse_json("payload").isNull()
    asked = cold.where(recent).join(dates(new).union(held), "date", "left_anti").select("date", F.when(bad, F.lit(None)).otherwise(F.col("payload")).alias("payload"), F.when(bad, "failed").otherwise("cold").alias("action"))
    still = held.where(recent).join(dates(cold), "date", "left_semi").join(dates(new), "date", "left_anti").withColumn("action", F.lit("skipped"))
    if prune:
        still = still.unionByName(held.where(~recent).withColumn("action", F.lit("pruned")))
    return new.select("date", "payload", F.lit("hot").alias("action")).unionByName(asked).unionByName(still, allowMissingColumns=True)


def window(snapshots: DataFrame, latest: str, days: int = WINDOW) -> DataFrame:
    """Each calendar day up to the latest, newest first, with its payload: null, a gap, where there is no snapshot or its own date is another. snapshots: date, payload_date, payload."""
    axis = snapshots.sparkSession.range(days).select(F.date_sub(F.lit(latest).cast("date"), F.col("id").cast("int")).cast("string").alias("date"))
    fit = snapshots.where("payload_date = date").groupBy("date").agg(F.min("payload").alias("payload"))
    return axis.join(fit, "date", "left").withColumn("observed", F.col("payload").isNotNull()).orderBy(F.desc("date"))


def kpis(days: DataFrame) -> DataFrame:
    """One row over days (date, item_count, pass_rate, cold; one row a date): covered, first, last, span, coverage in percent, total, average, mean pass rate, its days, and the latest day's count and tier."""
    date, n = F.col("date").cast("date"), F.coalesce("item_count", F.lit(0))
    own = days.agg(F.count("*").alias("covered"), F.min(date).alias("first"), F.max(date).alias("last"), F.sum(n).alias("total"), F.avg("pass_rate").alias("pass_rate"), F.count("pass_rate").alias("rated_days"), F.max_by(n, date).alias("latest"), F.max_by("cold", date).alias("latest_cold")).where("covered > 0")
    span = F.date_diff("last", "first") + 1
    return own.select("covered", "first", "last", span.alias("span"), (F.floor(F.col("covered") / span * 1000 + 0.5) / 10).alias("coverage"), "total", F.floor(F.col("total") / F.col("covered") + 0.5).alias("average"), "pass_rate", "rated_days", "latest", "latest_cold")


def date_fields(document: Column) -> Column:
    """The days and instants that an object names, with those of its `_updated_at`: name, kind and valid, by name. A null instant is valid, a null day isn't."""
    string = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    instant = lambda x: F.is_variant_null(x) | valid_instant(string(x))
    field = lambda name, kind, ok: F.struct(name.alias("name"), F.lit(kind).alias("kind"), ok.alias("valid"))
    entries = lambda path, keys: F.map_entries(F.map_filter(_members(document, path), lambda k, _: k.isin(*keys)) if keys else _members(document, path))
    own = F.transform(entries("$", DAYS), lambda e: field(e["key"], "date", valid_day(string(e["value"]))))
    at = F.transform(entries("$", INSTANTS), lambda e: field(e["key"], "datetime", instant(e["value"])))
    updated = F.transform(entries("$._updated_at", ()), lambda e: field(F.concat(F.lit("_updated_at."), e["key"]), "datetime", instant(e["value"])))
    return F.sort_array(F.concat(own, at, updated))


def inventory(expected: DataFrame, found: DataFrame, excluded: DataFrame) -> DataFrame:
    """Each path that is expected or found and not excluded: group, expected, present, status, sha256, bytes, schema_version and errors.

    expected: group, path; found: group, path, content (text), is_file; excluded: path. status: missing, invalid_type (no file), invalid_json, invalid_date or
    available. Contents are judged where they are read; only digests and errors are shuffled. Of repeated rows one counts.
    """
    own = found.withColumn("_v", F.try_parse_json("content"))
    own = own.withColumn("_fields", F.coalesce(date_fields(F.col("_v")), F.expr("CAST(array() AS array<struct<name:string,kind:string,valid:boolean>>)")))
    wrong = F.transform(F.filter("_fields", lambda f: ~f["valid"]), lambda f: F.concat(F.lit("invalid_date:"), f["name"]))
    status = F.when(~F.col("is_file"), "invalid_type").when(F.col("_v").isNull(), "invalid_json").when(F.size(wrong) > 0, "invalid_date").otherwise("available")
    errors = F.when(~F.col("is_file"), F.array(F.lit("not_a_regular_file"))).when(F.col("_v").isNull(), F.array(F.lit("invalid_json"))).otherwise(wrong)
    bytes_ = F.col("content").cast("binary")
    version = F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get("_v", f"$.{k}", "string")), F.lit(""))) for k in ("schema_version", "schema", "version")))
    seen = own.select(F.col("group").alias("_group"), "path", status.alias("status"), F.when(F.col("is_file"), F.sha2(bytes_, 256)).alias("sha256"), F.when(F.col("is_file"), F.octet_length(bytes_)).alias("bytes"), version.alias("schema_version"), errors.alias("errors")).dropDuplicates(["path"])
    asked = expected.select("group", "path").dropDuplicates(["path"]).withColumn("expected", F.lit(True))
    both = asked.join(seen, "path", "full_outer").join(excluded.select("path").distinct(), "path", "left_anti")
    none = F.expr("CAST(array() AS array<string>)")
    return both.select(F.coalesce("group", "_group").alias("group"), "path", F.col("expected").isNotNull().alias("expected"), F.col("status").isNotNull().alias("present"), F.coalesce("status", F.lit("missing")).alias("status"), "sha256", "bytes", "schema_version", F.coalesce("errors", none).alias("errors"))


def inventory_groups(artifacts: DataFrame) -> DataFrame:
    """Counts of each group: total, expected, present, missing and invalid."""
    s = F.col("status")
    return artifacts.groupBy("group").agg(F.count("*").alias("total"), F.count_if("expected").alias("expected"), F.count_if("present").alias("present"), F.count_if(s == "missing").alias("missing"), F.count_if(~s.isin("available", "missing")).alias("invalid"))


def changed(preview: DataFrame, public: DataFrame) -> DataFrame:
    """What publishing each file of preview (path, sha256) would do to public ones of its base name: add, same or change."""
    name = F.substring_index("path", "/", -1)
    there = public.groupBy(name.alias("name")).agg(F.min("sha256").alias("_old"))
    return preview.withColumn("name", name).join(there.withColumn("_there", F.lit(True)), "name", "left").withColumn("change", F.when(F.col("_there").isNull(), "add").when(F.col("sha256").eqNullSafe(F.col("_old")), "same").otherwise("change")).drop("_old", "_there")
