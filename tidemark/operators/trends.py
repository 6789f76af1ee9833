"""All measures of topics over a calendar in one plan, and timelines that keep absent topics.

Rows are counted once by (topic, day, item, source, title). From there each becomes a row for its day, item, source and title, and all four
are counted in one grouping; whatever is distinct is then a number of groups. Hot topics are summed before every shuffle. The longest
lists, sources and repeated titles, are ranked in SLICES parts by hash first, of which only the first n go on, so that no task holds a topic's
titles whole. Days of a topic make one array, at most as long as the calendar, and windows, slopes and series are expressions over it.

A day without any row of any topic or item is unknown, not 0: means divide by the days that the topic has rows on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import half_up

WINDOWS, SLOPE, TOP, COVERAGE, SLICES = (7, 30, 90), 30, 5, 0.6, 256


def calendar_window(days: DataFrame) -> DataFrame:
    """One row: start, end, observed (array of days), observed_days, calendar_days, missing_dates and continuity; from rows with a day. Nulls and zeros without any."""
    own = days.where("day is not null").groupBy("day").agg(F.lit(1).alias("_one")).agg(F.sort_array(F.collect_list("day")).alias("observed"))
    own = own.select(F.get("observed", F.lit(0)).alias("start"), F.get("observed", F.size("observed") - 1).alias("end"), "observed", F.size("observed").cast("long").alias("observed_days"))
    axis = F.coalesce(F.sequence("start", "end"), F.expr("CAST(array() AS array<date>)"))
    own = own.withColumn("axis", axis).withColumn("calendar_days", F.size("axis").cast("long")).withColumn("missing_dates", F.array_except("axis", "observed"))
    return own.withColumn("continuity", half_up(F.col("observed_days").cast("double") / F.nullif("calendar_days", F.lit(0))))


def average(daily: Column, start: Column, end: Column, days: int, least: float = COVERAGE) -> Column:
    """A moving average at the window's end: value, observed_days, coverage, truncated (the window begins before the calendar) and sufficient."""
    first = F.date_sub(end, days - 1)
    near = F.filter(daily, lambda d: (d["day"] >= first) & (d["day"] <= end))
    n, total = F.size(near), F.aggregate(near, F.lit(0).cast("long"), lambda a, d: a + d["n"])
    coverage = half_up(n.cast("double") / days)
    return F.struct(half_up(total.cast("double") / F.nullif(n, F.lit(0))).alias("value"), n.cast("long").alias("observed_days"), coverage.alias("coverage"), (first < start).alias("truncated"), ((n > 0) & (coverage >= least)).alias("sufficient"))


def fitted(rows: DataFrame, days: int) -> DataFrame:
    """rows (daily, end) with slope and r2 of least squares over the topic's days in the last `days` (null under three points; r2 is 1 for a flat line) and points. x is the day on the calendar, so gaps keep their width."""
    first, n = F.date_sub("end", days - 1), F.size("_points")
    zero = lambda *names: F.struct(*(F.lit(0.0).alias(k) for k in names))
    points = F.transform(F.filter("daily", lambda d: d["day"] >= first), lambda d: F.struct(F.datediff(d["day"], first).cast("double").alias("x"), d["n"].cast("double").alias("y")))
    sums = F.aggregate("_points", zero("x", "y"), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    dx, dy = (lambda p: p["x"] - F.col("_sums.x") / n), (lambda p: p["y"] - F.col("_sums.y") / n)
    around = F.aggregate("_points", zero("xx", "xy", "yy"), lambda s, p: F.struct((s["xx"] + dx(p) * dx(p)).alias("xx"), (s["xy"] + dx(p) * dy(p)).alias("xy"), (s["yy"] + dy(p) * dy(p)).alias("yy")))
    rows = rows.withColumn("_points", points).withColumn("_sums", sums).withColumn("_c", F.when(n >= 3, around))
    xx, xy, yy = (F.col(f"_c.{k}") for k in ("xx", "xy", "yy"))
    r2 = F.when(yy == 0, 1.0).otherwise(xy * xy / (xx * F.nullif(yy, F.lit(0.0))))
    rows = rows.withColumns({"slope": half_up(xy / xx), "r2": half_up(r2), "points": n.cast("long")})
    return rows.withColumn("slope_sufficient", F.col("slope").isNotNull()).drop("_points", "_sums", "_c")


def measured(hits: DataFrame, days: DataFrame, windows: tuple[int, ...] = WINDOWS, slope_days: int = SLOPE, top: int = TOP) -> DataFrame:
    """A row for each topic with rows.

    hits: topic, day, item, source, title and key (the title in its normal form; an empty one counts as no title). days: rows with a
    day, of everything observed. Columns: totals, daily (day, n, unique_items), ma<w> for each window, slope, concentration with top_sources,
    and evidence of repeats with top_repeats, then the calendar's.
    """
    c = F.col
    base = hits.groupBy("topic", "day", "item", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("key", F.lit("")).alias("key")).agg(F.count("*").alias("n"), F.min("title").alias("title"))
    as_ = lambda kind, k, sub: F.struct(F.lit(kind).alias("kind"), k.cast("string").alias("k"), sub.alias("sub"))
    none = F.lit(None).cast("string")
    each = base.withColumn("_e", F.explode(F.array(as_("day", c("day"), c("item")), as_("item", c("item"), none), as_("source", c("source"), none), as_("title", c("key"), none)))).select("topic", "n", "title", "source", "day", "_e.*")
    title = c("kind") == "title"
    groups = each.where("kind <> 'title' OR k <> ''").groupBy("topic", "kind", "k", "sub").agg(
        F.sum("n").alias("n"), F.min(F.when(title, c("title"))).alias("title"), F.collect_set(F.when(title, c("source"))).alias("sources"), F.collect_set(F.when(title, c("day"))).alias("days"),
    )
    groups = groups.groupBy("topic", "kind", "k").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.any_value("title").alias("title"), F.any_value("sources").alias("sources"), F.any_value("days").alias("days"))
    # What may be among the first n of its topic is so in its slice.
    cross = title & (c("n") > 1) & (F.size("sources") > 1)
    listed = F.when(cross, F.struct((-c("n")).alias("n"), (-F.size("sources")).alias("m"), c("title").alias("name"), F.sort_array("sources").alias("sources"), F.sort_array("days").alias("days"))).when(
        c("kind") == "source", F.struct((-c("n")).alias("n"), F.lit(0).alias("m"), c("k").alias("name"), F.expr("CAST(null AS array<string>)").alias("sources"), F.expr("CAST(null AS array<date>)").alias("days")))
    slices = W.partitionBy("topic", "kind", F.pmod(F.xxhash64("k"), F.lit(SLICES))).orderBy(F.asc_nulls_last("_l"))
    ranked = groups.withColumn("_l", listed).withColumn("_r", F.row_number().over(slices))
    first = lambda kind: F.slice(F.sort_array(F.collect_list(F.when((c("kind") == kind) & (c("_r") <= top), c("_l")))), 1, top)
    source, repeat = c("kind") == "source", title & (c("n") > 1)
    own = ranked.groupBy("topic").agg(
        F.sum(F.when(source, c("n"))).alias("occurrences"), F.count_if(c("kind") == "item").alias("unique_items"), F.count_if(title).alias("unique_titles"), F.count_if(c("kind") == "day").alias("active_days"),
        F.count_if(source).alias("distinct_sources"), F.sum(F.when(source, c("n") * c("n"))).alias("_squares"),
        F.count_if(repeat).alias("repeated_title_groups"), F.count_if(cross).alias("cross_source_repeat_groups"), F.coalesce(F.max(F.when(repeat, c("n"))), F.lit(0)).alias("max_title_repeat"),
        F.sort_array(F.collect_list(F.when(c("kind") == "day", F.struct(c("k").cast("date").alias("day"), c("n").alias("n"), c("parts").alias("unique_items"))))).alias("daily"),
        first("source").alias("_sources"), first("title").alias("_repeats"),
    )
    rows = own.crossJoin(F.broadcast(calendar_window(days)))
    hhi = c("_squares").cast("double") / (c("occurrences") * c("occurrences"))
    rows = rows.withColumns({f"ma{w}": average(c("daily"), c("start"), c("end"), w) for w in windows})
    rows = fitted(rows, slope_days).withColumns({
        "active_day_rate": half_up(c("active_days").cast("double") / c("observed_days")),
        "hhi": half_up(hhi), "effective_sources": half_up(1 / hhi),
        "duplicate_title_ratio": half_up(1 - c("unique_titles").cast("double") / c("occurrences")),
        "top_sources": F.transform("_sources", lambda x: F.struct(x["name"].alias("source"), (-x["n"]).alias("count"), half_up((-x["n"]).cast("double") / c("occurrences")).alias("share"))),
        "top_repeats": F.transform("_repeats", lambda x: F.struct(x["name"].alias("title"), (-x["n"]).alias("count"), (-x["m"]).alias("distinct_sources"), x["sources"].alias("sources"), x["days"].alias("dates"))),
    })
    return rows.drop("_squares", "_sources", "_repeats")


def delta(series: Column, days: int = 7) -> Column:
    """The last `days` observed values of an array against as many before: recent_sum, previous_sum, change, change_rate, sufficient and observed_days; nulls where there are too few."""
    seen = F.filter(series, lambda x: x.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    enough = F.size(seen) >= 2 * days
    recent, before = (F.when(enough, total(F.slice(seen, -k * days, days))) for k in (1, 2))
    # slice() with a start before the array's gives nothing, so too short ones never count.
    return F.struct(recent.alias("recent_sum"), before.alias("previous_sum"), (recent - before).alias("change"), F.when(before > 0, half_up((recent - before).cast("double") / before)).alias("change_rate"), enough.alias("sufficient"), F.size(seen).cast("long").alias("observed_days"))


def timeline(metrics: DataFrame, topics: DataFrame, days: DataFrame) -> DataFrame:
    """Every topic of `topics` with a series over the whole calendar; topics without rows have zero totals, and null measures.

    A series is 0 on observed days without rows of the topic, null on days of which nothing is known.
    """
    calendar = calendar_window(days)
    kept = [c for c in metrics.columns if c not in calendar.columns]
    both = topics.select("topic").distinct().join(metrics.select(kept), "topic", "left").crossJoin(F.broadcast(calendar))
    both = both.withColumn("present", F.col("daily").isNotNull())
    by_day = lambda field: F.map_from_entries(F.transform(F.coalesce("daily", F.expr("CAST(array() AS array<struct<day:date,n:bigint,unique_items:bigint>>)")), lambda d: F.struct(d["day"], d[field])))
    known = F.map_from_entries(F.transform("observed", lambda d: F.struct(d, F.lit(True))))
    both = both.withColumns({"_n": by_day("n"), "_u": by_day("unique_items"), "_known": known})
    series = lambda m: F.transform("axis", lambda d: F.when(F.coalesce(F.try_element_at("_known", d), F.lit(False)), F.coalesce(F.try_element_at(m, d), F.lit(0).cast("long"))))
    both = both.withColumns({"occurrence_series": series("_n"), "unique_series": series("_u")}).drop("_n", "_u", "_known")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("occurrences", "unique_items", "unique_titles", "active_days")} | {"active_day_rate": F.coalesce("active_day_rate", F.lit(0.0))}
    return both.withColumns(zero).withColumn("delta", delta(F.col("occurrence_series")))


def totals(items: DataFrame) -> DataFrame:
    """day, observed and items of every day of the calendar, from rows with a day; items is null on days of which nothing is known."""
    counts = items.where("day is not null").groupBy("day").agg(F.count("*").alias("items"))
    axis = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return axis.join(counts, "day", "left").select("day", F.col("items").isNotNull().alias("observed"), "items")
