"""Trend metrics and timelines on the cases that their rules are stated by."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import norm_title
from tidemark.operators import topics, trends

LEXICON = {"governance": ("governance",), "agents": ("agent",), "release": ("release", "inference")}


def run(spark, rows, windows=(7, 30, 90), slope=30):
    """rows: date, title, item, source."""
    items = spark.createDataFrame([(datetime.date.fromisoformat(d), *r) for d, *r in rows], "day date, title string, item string, source string").withColumn("key", norm_title(F.col("title")))
    metrics = trends.measured(topics.matched(items, "title", LEXICON), items, windows, slope)
    return {r.topic: r for r in metrics.collect()}, metrics, items


def test_missing_days_are_unknown_not_zero(spark):
    got, _, _ = run(spark, [("2026-07-01", "AI governance", "u1", "A"), ("2026-07-03", "AI governance update", "u2", "B")], (3, 4), 3)
    r = got["governance"]
    assert r.ma3.value == 1 and r.missing_dates == [datetime.date(2026, 7, 2)] and r.continuity == 0.6667
    assert (r.ma3.coverage, r.ma3.sufficient, r.ma3.truncated) == (0.6667, True, False)
    assert (r.ma4.coverage, r.ma4.sufficient, r.ma4.truncated) == (0.5, False, True)
    assert r.slope is None and r.points == 2 and not r.slope_sufficient
    assert (r.observed_days, r.calendar_days, r.active_day_rate) == (2, 3, 1.0)


@pytest.mark.parametrize(("counts", "slope", "r2"), [([1, 2, 3, 4], 1, 1), ([4, 3, 2, 1], -1, 1), ([2, 2, 2, 2], 0, 1), ([1, 2], None, None)])
def test_slopes(spark, counts, slope, r2):
    rows = [(f"2026-07-{i + 1:02d}", f"agent {i}-{k}", f"u{i}-{k}", "S") for i, n in enumerate(counts) for k in range(n)]
    r = run(spark, rows)[0]["agents"]
    assert (r.slope, r.r2) == (slope, r2)


def test_gaps_keep_their_width(spark):
    rows = [("2026-07-01", "agent a", "a", "S"), ("2026-07-02", "agent b", "b", "S"), ("2026-07-02", "agent c", "c", "S"), *(("2026-07-10", f"agent d{k}", f"d{k}", "S") for k in range(3))]
    r = run(spark, rows)[0]["agents"]
    assert 0 < r.slope < 1 and r.points == 3


def test_repeats_count_across_sources_only(spark):
    rows = [("2026-07-01", "GPT release lands today", f"x{s}", s) for s in "abc"] + [("2026-07-01", "Claude inference: update!", "y1", "a"), ("2026-07-01", "CLAUDE INFERENCE UPDATE", "y2", "a"), ("2026-07-02", "release?", "y2", None)]
    r = run(spark, rows)[0]["release"]
    assert (r.repeated_title_groups, r.cross_source_repeat_groups, r.max_title_repeat, r.unique_titles) == (2, 1, 3, 3)
    assert r.top_repeats[0].sources == ["a", "b", "c"] and r.top_repeats[0].title == "GPT release lands today" and len(r.top_repeats) == 1
    assert (r.occurrences, r.unique_items, r.distinct_sources) == (6, 5, 4) and [(x.source, x["count"]) for x in r.top_sources][:2] == [("a", 3), ("", 1)]
    assert r.hhi == round(12 / 36, 4) and r.duplicate_title_ratio == 0.5


def test_an_item_may_be_in_several_topics_and_a_topic_absent(spark):
    rows = [("2026-07-01", "AI governance for agent teams", "b1", "S"), ("2026-07-03", "nothing of note", "b2", "S")]
    got, metrics, items = run(spark, rows)
    assert set(got) == {"governance", "agents"}
    names = spark.createDataFrame([(k,) for k in LEXICON], "topic string")
    lines = {r.topic: r for r in trends.timeline(metrics, names, items).collect()}
    assert lines["agents"].occurrence_series == [1, None, 0] and lines["agents"].present
    assert lines["release"].occurrence_series == [0, None, 0] and not lines["release"].present
    assert (lines["release"].occurrences, lines["release"].active_day_rate, lines["release"].hhi, lines["release"].ma7, lines["release"].slope) == (0, 0.0, None, None, None)
    assert not lines["agents"].delta.sufficient and lines["agents"].delta.recent_sum is None
    assert [(r.observed, r["items"]) for r in trends.totals(items).orderBy("day").collect()] == [(True, 1), (False, None), (True, 1)]


def test_change_between_two_weeks_of_observed_days(spark):
    cases = [([1] * 7 + [2] * 7, (14, 7, 1.0)), ([0] * 7 + [2] * 7, (14, 0, None)), ([9, None] + [1] * 7 + [None] + [1] * 7, (7, 7, 0.0)), ([1] * 13, (None, None, None)), ([], (None, None, None))]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s array<long>").select("i", trends.delta(F.col("s")).alias("d")).collect()
    assert [(r.d.recent_sum, r.d.previous_sum, r.d.change_rate) for r in sorted(rows)] == [w for _, w in cases]


def test_tables_without_rows(spark):
    _, metrics, items = run(spark, [])
    assert metrics.count() == 0 and trends.totals(items).count() == 0
    r = trends.timeline(metrics, spark.createDataFrame([("agents",)], "topic string"), items).collect()
    assert len(r) == 1 and r[0].occurrence_series == [] and r[0].occurrences == 0
