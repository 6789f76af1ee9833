"""Operators on small inline tables: gaps, ties, nulls and halves."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import half_up, host, ingest_url, page_titles, topic_url, valid_url, word_overlap
from tidemark.operators import feedback, health, merge, rules, series, topics, validation


def day(n):
    return dt.date(2026, 4, n)


def test_gap_is_unknown_and_not_zero(spark):
    counts = spark.createDataFrame([("a", day(1), 2), ("a", day(2), 1), ("b", day(5), 1)], "topic string, day date, n long")
    axis = series.calendar(counts, "day")
    got = {(r.topic, r.day.day): r.n for r in series.on_axis(counts, "topic", "n", axis).collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, ("a", 3): None, ("a", 4): None, ("a", 5): 0, ("b", 1): 0, ("b", 2): 0, ("b", 3): None, ("b", 4): None, ("b", 5): 1}


def test_calendar_of_nothing_is_empty(spark):
    assert series.calendar(spark.createDataFrame([], "day date"), "day").count() == 0


def test_slope_of_lines(spark):
    rows = [(k, day(i + 1), v) for k, vs in {"up": [1, 2, 3, 4], "flat": [2, 2, 2, 2], "short": [1, 2]}.items() for i, v in enumerate(vs)]
    counts = spark.createDataFrame(rows, "topic string, day date, n long")
    got = {r.topic: (r.slope, r.r2) for r in series.slope(counts, "topic", "n", 30, counts.agg(F.max("day").alias("last_day"))).collect()}
    assert got == {"up": (1.0, 1.0), "flat": (0.0, 1.0), "short": (None, None)}


def test_concentration(spark):
    rows = [("one", "a")] * 10 + [("four", s) for s in "abcd" * 5]
    got = {r.g: (r.hhi, r.effective_sources) for r in topics.concentration(spark.createDataFrame(rows, "g string, s string"), "g", "s").collect()}
    assert got == {"one": (1.0, 1.0), "four": (0.25, 4.0)}


def test_terms_need_word_bounds_only_if_ascii(spark):
    items = spark.createDataFrame([(1, "Said AI today"), (2, "said"), (3, "晶片產能"), (4, None), (5, "")], "id int, text string")
    got = {(r.id, r.topic) for r in topics.matched(items, "text", {"ai": ("ai",), "chips": ("晶片",), "none": (" ",)}).collect()}
    assert got == {(1, "ai"), (3, "chips")}


def test_latest_rating_keeps_the_first_of_a_tie(spark):
    events = spark.createDataFrame([("a", "1", 0, "good"), ("c", "1", 1, "bad"), ("c", "2", 2, "mid"), ("c", "2", 3, "bad")], "s string, ts string, line int, r string")
    assert {r.s: r.r for r in feedback.latest(events, "s", "ts", "line").collect()} == {"a": "good", "c": "mid"}


def test_canary_boundary(spark):
    nights = [(k, i, 0.725 if i <= 7 else 0.725 - d) for k, d in (("out", 0.101), ("in", 0.099)) for i in range(1, 11)]
    got = {r.k: r.verdict for r in feedback.canary(spark.createDataFrame(nights, "k string, night int, rate double"), "k", "night", "rate").collect()}
    assert got == {"out": "revert", "in": "confirm"}


def test_merge_and_tombstones(spark):
    a = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 1, "a")], "k int, s int, v string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 6, "b"), (4, 1, "b")], "k int, s int, v string")
    tombs = spark.createDataFrame([(3, 1), (4, 0)], "k int, d int")
    got = {r.k: r.v for r in merge.without_deleted(merge.newest_wins(a, b, "k", "s", "v"), tombs, "k", "s", "d").collect()}
    assert got == {1: "a", 2: "b", 4: "b"}


def test_halves_and_addresses(spark):
    r = spark.range(1).select(half_up(F.lit(-0.5), 0).alias("a"), half_up(F.lit(2.5), 0).alias("b"), topic_url(F.lit("HTTP://x")).alias("c"), topic_url(F.lit("https://www.X.org/a/?b=2&utm_source=f&a=1#t")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (0.0, 3.0, "http://x/", "https://x.org/a?a=1&b=2")


def test_fill_up_cuts_groups_before_the_shuffle(spark):
    current = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, k long")
    older = spark.createDataFrame([("a", i) for i in range(4, 20)] + [("b", i) for i in range(20, 40)] + [("c", 50)], "g string, k long")
    out = merge.filled_up(current, older, "g", "k", [F.col("k")], 2)
    assert sorted(map(tuple, out.collect())) == [("a", 1, False), ("a", 2, False), ("b", 3, False), ("b", 20, True), ("c", 50, True)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_addresses(spark):
    rows = {
        "https://u:p@x.org/a": (None, "https://u:p@x.org/a", "x.org", False),
        "HTTPS://WWW.X.org:8080/A/?UTM_Source=1&b&a=2&a=1#f": ("https://x.org:8080/A?a=2&a=1&b=", "https://www.x.org:8080/A?b=&a=2&a=1", "x.org", True),
        "http://x.org:80": ("http://x.org/", "http://x.org:80/", "x.org", True),
        "http://x.org/a//?ref=1&gclid=2": ("http://x.org/a/?ref=1", "http://x.org/a", "x.org", True),
        "ftp://x.org/": (None, "ftp://x.org/", "", False),
        "http://x.org/a b": (None, "http://x.org/a b", "x.org", False),
        "": (None, "", "", False),
        None: (None, "", None, False),
    }
    df = spark.createDataFrame([(k,) for k in rows], "u string")
    u = F.col("u")
    assert {r.u: (r.t, r.i, r.h, r.v) for r in df.select("u", topic_url(u).alias("t"), ingest_url(u).alias("i"), host(u).alias("h"), valid_url(u).alias("v")).collect()} == rows


def test_titles(spark):
    df = spark.createDataFrame([("<title>Sea <b>News</b> - The Paper</title><h1>Sea</h1>",), ("<title>a - b</title>",), (None,)], "h string")
    assert [r.t for r in df.select(page_titles(F.col("h")).alias("t")).collect()][:2] == [["Sea News - The Paper", "Sea News", "Sea"], ["a - b"]]
    pairs = spark.createDataFrame([("Open Models", "open models today", 0.7), ("a b c d", "a x y z", 0.25), ("", "a", 0.0)], "a string, b string, s double")
    assert all(r.s == r.o for r in pairs.select("s", word_overlap(F.col("a"), F.col("b")).alias("o")).collect())


def test_row_validation(spark):
    today = F.lit("2026-07-30").cast("date")
    dates = {"2026-07-30": None, "2026-07-31": "date_out_of_range", "2026-05-01": None, "2026-04-30": "date_out_of_range", "2026-7-3": "invalid_format", "2026-02-30": "invalid_format", "": "empty_or_invalid_type", None: "empty_or_invalid_type"}
    df = spark.createDataFrame([(k,) for k in dates], "d string")
    assert {r.d: r.p for r in df.select("d", validation.date_problem(F.col("d"), today).alias("p")).collect()} == dates
    old = spark.createDataFrame([("2024-07-29", "date_too_old"), ("2024-07-30", None), ("2027-01-01", None)], "d string, e string")
    assert all(r.p == r.e for r in old.select("e", validation.date_problem(F.col("d"), today, future=True).alias("p")).collect())
    items = spark.createDataFrame([(1, "t", ["a"], "api", ["docs.x.org"]), (2, " ", [" "], "gossip", ["xx.org"]), (3, None, None, None, None)], "id int, title string, tags array<string>, kind string, hosts array<string>")
    rules_ = [F.array_join(F.nullif(validation.missing({"title": validation.filled(F.col("title")), "tags": validation.filled_list(F.col("tags"))}), F.array().cast("array<string>")), ","), validation.enum_issue(F.col("kind"), ("api", "policy"), "event_type"), validation.evidence_issue(F.col("hosts"), F.array(F.lit("x.org")))]
    got = {r.id: r.issues for r in validation.issues(items, rules_).collect()}
    assert got == {1: [], 2: ["title,tags", "Invalid event_type", "Invalid or company-mismatched evidence_urls"], 3: ["title,tags", "Invalid event_type"]}
    hosts = spark.createDataFrame([("x.org",), ("a.x.org",), ("ax.org",), ("y.org",)], "h string")
    domains = spark.createDataFrame([("x.org",), ("x.org",)], "domain string")
    assert sorted(r.h for r in validation.at_or_below(hosts, "h", domains).collect()) == ["a.x.org", "x.org"]
    assert {r.h for r in validation.exactly_among(hosts, "h", domains, "t").where("t").collect()} == {"x.org"}
    empty = validation.summary(spark.createDataFrame([], "issues array<string>, status string")).first()
    assert (empty.total, empty.pass_rate) == (0, 0.0)


def test_health(spark):
    nights = spark.createDataFrame([(g, i, v, 1 if v is not None else 0) for g, vs in {"low": [0.9, 0.9, 0.9, 0.6, 0.7], "one": [0.9, 0.9, 0.9, 0.9, 0.6], "short": [0.1], "none": [0.9, 0.9, None, 0.5, 0.5]}.items() for i, v in enumerate(vs)], "g string, i int, v double, n int")
    low = health.sustained_low(nights, "g", "i", "v", "n")
    assert {r.g: r.low for r in low.collect()} == {"low": True, "one": False, "short": False, "none": True}
    assert {r.g: r.isolated for r in health.isolated(low, "low", 2).collect()} == {"low": True, "one": False, "short": False, "none": True}
    assert {r.g: r.baseline for r in health.nightly_baseline(nights, "g", "i", "v", 2).collect()} == {"low": 0.65, "one": 0.75, "short": 0.1, "none": 0.5}
    runs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 1, False), ("c", 2, True)], "g string, i int, ok boolean")
    assert {r.g: r.failures for r in health.failure_streak(runs, "g", "i", "ok").collect()} == {"a": 2, "b": 1, "c": 0}
    same = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("e", 1, "z")], "d string, line int, v string")
    assert {r.d: r.v for r in health.last_of_date(same, ["d"], "line").collect()} == {"d": "y", "e": "z"}
    grades = spark.createDataFrame([("a", "E1"), ("b", "E1"), ("b", "E3"), ("c", "E4"), ("c", "E1"), ("c", "E4")], "g string, e string")
    assert {r.g: r.grade for r in health.evidence_grade(grades, "g", "e").collect()} == {"a": "E1", "b": "E3", "c": "E4"}
    changes = spark.createDataFrame([("a", "2026-01-07 00:00:00"), ("a", "2026-01-01 00:00:00"), ("b", "2025-12-31 00:00:00"), ("b", "2026-01-09 00:00:00")], "c string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.c, r.is_total): r.n for r in health.in_flight(changes, "c", "t", F.lit("2026-01-07 12:00:00").cast("timestamp")).collect()}
    assert got == {("a", 0): 2, (None, 1): 2}


def test_rule_tables(spark):
    one = lambda **c: spark.range(1).select(*(v.alias(k) for k, v in c.items())).first()
    n = F.lit(None).cast("double")
    r = one(a=rules.syndication_call(F.lit(2.0), F.lit(3), F.lit(1), F.lit(100)), b=rules.syndication_call(F.lit(1.0), F.lit(1), F.lit(10), F.lit(100)), c=rules.syndication_call(F.lit(1.2), F.lit(2), F.lit(1), F.lit(100)), d=rules.syndication_call(F.lit(1.1), F.lit(9), F.lit(1), F.lit(100)))
    assert tuple(r) == ("syndicated", "syndicated", "mixed", "organic")
    r = one(a=rules.confidence_cap(F.lit(0.7), F.lit(0.9), F.lit(1.0)), b=rules.confidence_cap(F.lit(0.7), F.lit(0.1), n), c=rules.confidence_cap(F.lit(1.0), F.lit(0.5), F.lit(1.0)))
    assert tuple(r) == (0.85, 0.75, 1.0)
    t, f = F.lit(True), F.lit(False)
    r = one(a=rules.window_status(t, t, F.lit(2), F.lit(0)), b=rules.window_status(t, t, F.lit(1), F.lit(2)), c=rules.window_status(t, t, F.lit(2), F.lit(2)), d=rules.window_status(f, t, F.lit(2), F.lit(0)), e=rules.topic_score(F.lit(4), F.lit(2), t), g=rules.exploration_slots(F.lit(8), 0.2), h=rules.financial_relevance(F.lit(0.5), F.lit(0.5)), i=rules.weighted([(F.lit(0.33349), 0.5), (F.lit(1.0), 0.5)]))
    assert tuple(r)[:6] == ("new", "declining", "persistent", "focus", 9.0, 2) and abs(r.h - 0.65) < 1e-9 and r.i == 0.667
