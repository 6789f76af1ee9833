"""Days of two tiers, their mirror, the window with its gaps, and the inventory of files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import archive


def days(spark, rows):
    return spark.createDataFrame(rows, "date string, payload string")


def test_rows_of_the_archive(spark):
    rows = [("d1", '{"stats": {"a": 3, "b": 2.5, "c": "7", "d": null}, "validation": {"pass_rate": 0.93}, "time": "", "generated_at": "now", "source": "x"}'), ("d2", "{broken"), ("d3", None), ("d4", '{"stats": [1, 2], "validation": 5}'), ("d5", "[1]")]
    got = {r.date: r for r in archive.archived(days(spark, rows)).collect()}
    assert tuple(got["d1"])[1:5] == ("now", 5, "0.93", "x") and got["d1"].payload == rows[0][1]
    assert all(tuple(got[d])[1:5] == ("", 0, "", "local") for d in ("d2", "d3", "d4", "d5"))


def test_pages_follow_each_other(spark):
    own = spark.createDataFrame([(f"2026-01-0{i}", i, "1", "s") for i in range(1, 8)] + [("junk", 0, "", ""), (None, 0, "", ""), ("2026-02-30", 0, "", "")], "date string, item_count int, pass_rate string, source string")
    seen, cursor = [], None
    while True:
        rows = archive.page(own, cursor, 3).collect()
        seen.append([r.item_count for r in rows])
        cursor = rows[0].next
        if not cursor:
            break
    assert seen == [[7, 6, 5], [4, 3, 2], [1]] and len(archive.page(own, None, 0).collect()) == 1 and archive.page(own, "2026-01-01").collect() == []
    assert archive.page(own, None, 7).first().next is None


def test_one_day(spark):
    own = days(spark, [("a", '{"x": 1}'), ("b", "{"), ("c", None)])
    assert [archive.day(own, d).count() for d in "abcz"] == [1, 0, 0, 0]


def test_what_the_mirror_needs(spark):
    mirror, hot, cold = days(spark, [("d1", "m"), ("d3", "m"), ("d4", "m"), (None, "m")]), days(spark, [("d1", "h"), ("d4", "h"), ("d9", "h")]), days(spark, [("d1", "{}"), ("d3", "{}"), ("d5", "{}"), ("d6", "{"), ("d7", None), ("d9", "{}"), ("d2", "{}")])
    got = {(r.date, r.action): r.payload for r in archive.backfilled(mirror, hot, cold, "d3").collect()}
    want = {("d4", "hot"): "h", ("d9", "hot"): "h", ("d3", "skipped"): None, ("d5", "cold"): "{}", ("d6", "failed"): None, ("d7", "failed"): None}
    assert got == want
    assert {(r.date, r.action): r.payload for r in archive.backfilled(mirror, hot, cold, "d3", prune=True).collect()} == want | {("d1", "pruned"): None}


def test_a_wrong_day_stays_a_gap(spark):
    rows = [("2026-03-02", "2026-03-02", "a"), ("2026-03-01", "2026-02-27", "b"), ("2026-02-28", "2026-02-28", "c"), ("2026-02-27", None, "d"), ("2026-02-10", "2026-02-10", "old"), ("2026-03-05", "2026-03-05", "new")]
    got = archive.window(spark.createDataFrame(rows, "date string, payload_date string, payload string"), "2026-03-02").collect()
    assert len(got) == 14 and [(r.date, r.payload) for r in got[:4]] == [("2026-03-02", "a"), ("2026-03-01", None), ("2026-02-28", "c"), ("2026-02-27", None)]
    assert sum(r.observed for r in got) == 2


def test_figures_of_days(spark):
    schema = "date string, item_count int, pass_rate double"
    hot, cold = spark.createDataFrame([("2026-03-03", 10, None), ("2026-03-04", 5, 0.5)], schema), spark.createDataFrame([("2026-03-03", 99, 1.0), ("2026-03-01", None, 0.25), (None, 1, 1.0)], schema)
    r = archive.kpis(archive.combined(hot, cold).where("date is not null")).first()
    assert (r.covered, r.span, r.coverage, r.total, r.average, r.pass_rate, r.rated_days, r.latest, r.latest_cold) == (3, 4, 75.0, 15, 5, 0.375, 2, 5, False)
    assert archive.kpis(archive.combined(hot, cold).where("false")).collect() == []


DAYS = [("2026-02-28", True), ("2026-02-30", False), ("2026-2-01", False), ("", False), (None, False), ("2024-02-29", True)]
INSTANTS = [("09:30", True), ("23:59:59", True), ("24:00", False), ("2026-02-28T09:30Z", True), ("2026-02-28T09:30:01.25+08:00", True), ("2026-02-28T09:30", False), ("2026-02-30T09:30Z", False), ("2026-02-28T09:60Z", False), ("2026-02-28T09:30:00+24:00", False), (" ", False), (None, False), ("2026-02-28", False)]


@pytest.mark.parametrize(("check", "cases"), [(archive.valid_day, DAYS), (archive.valid_instant, INSTANTS)])
def test_days_and_instants(spark, check, cases):
    got = spark.createDataFrame(cases, "x string, want boolean").withColumn("got", check(F.col("x"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_inventory(spark):
    good = '{"date": "2026-02-28", "last_run": null, "version": " ", "schema": "s-1", "other": "x", "_updated_at": {"b": "09:30", "a": "soon"}}'
    found = [("ok", '{"date": "2026-02-28", "last_run": null}', True), ("at", good, True), ("bad", '{"date": 5, "time": ["x"], "last_date": null}', True), ("cut", "{", True), ("dir", None, False), ("list", "[1]", True), ("null", "null", True), ("empty", "", True), ("none", None, True), ("gone", "{}", True), ("ok", '{"date": "2026-02-28", "last_run": null}', True)]
    own = archive.inventory(
        spark.createDataFrame([("g", "ok"), ("g", "absent"), ("g", "absent"), ("g", "gone")], "`group` string, path string"),
        spark.createDataFrame([("f", *r) for r in found], "`group` string, path string, content string, is_file boolean"), spark.createDataFrame([("gone",)], "path string"),
    )
    got = {r.path: r for r in own.collect()}
    assert {p: r.status for p, r in got.items()} == {"ok": "available", "absent": "missing", "at": "invalid_date", "bad": "invalid_date", "cut": "invalid_json", "dir": "invalid_type", "list": "available", "null": "available", "empty": "invalid_json", "none": "invalid_json"}
    assert got["at"].errors == ["invalid_date:_updated_at.a"] and got["bad"].errors == ["invalid_date:date", "invalid_date:last_date", "invalid_date:time"]
    assert (got["at"].sha256, got["at"].bytes, got["at"].schema_version, got["ok"].group, got["dir"].sha256) == (hashlib.sha256(good.encode()).hexdigest(), len(good), "s-1", "g", None)
    assert {tuple(r) for r in archive.inventory_groups(own).collect()} == {("g", 2, 2, 1, 1, 0), ("f", 8, 0, 8, 0, 6)}


def test_what_publishing_changes(spark):
    own = archive.changed(spark.createDataFrame([("p/a", "1"), ("p/b", "2"), ("p/c", "3"), ("p/d", None)], "path string, sha256 string"), spark.createDataFrame([("q/a", "1"), ("q/b", "9"), ("d", None)], "path string, sha256 string"))
    assert {r.name: r.change for r in own.collect()} == {"a": "same", "b": "change", "c": "add", "d": "same"}
