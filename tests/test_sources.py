"""Snapshots, ledgers and streams on small files with bad lines, reruns and late rows."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dynamic, feedback, merge, series
from tidemark.sources import ledger, snapshots
from tidemark.streaming import feedback as streams

TYPES = ("item_rated", "item_seen")


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("_", "-").removeprefix("d")).with_suffix(".json").write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(folder)


def test_items_of_snapshots(spark, tmp_path):
    day = {"data": {"papers": [{"title": " A ", "institution": "uni", "verified": True}, None, 7, {"title": ""}], "models": {"items": []}, "usa": [{"title_zh": "乙", "title": "B", "url": "u", "source": "s", "date": "2026-04-02T08:00", "url_status": "verified", "impact": "i"}]}}
    folder = put(tmp_path / "hot", d2026_04_03=day, dindex="not json")
    got = sorted(map(tuple, snapshots.items(snapshots.daily(spark, folder)).select("category", "position", "title", "title_en", "url", "source", "date", "summary", "verified").collect()))
    assert got == [("papers", 0, "A", "A", "", "uni", "2026-04-03", "", True), ("usa", 0, "乙", "B", "u", "s", "2026-04-02", "i", True)]


def test_bad_snapshot_fails(spark, tmp_path):
    with pytest.raises(Exception):
        snapshots.daily(spark, put(tmp_path / "bad", d2026_04_03="{")).collect()


def test_hot_day_wins_and_last_days_that_exist(spark, tmp_path):
    one = lambda t: {"data": {"papers": [{"title": t}]}}
    hot = snapshots.daily(spark, put(tmp_path / "h", d2026_04_03=one("hot"), d2026_04_09=one("new")))
    mirror = snapshots.daily(spark, put(tmp_path / "m", d2026_04_03=one("cold"), d2026_03_01=one("old")))
    days = snapshots.first_of_date(hot, mirror)
    assert sorted(r.title for r in snapshots.items(days).collect()) == ["hot", "new", "old"]
    assert sorted(r.title for r in snapshots.items(snapshots.last_dates(days, 2)).collect()) == ["hot", "new"]
    assert snapshots.last_dates(days, 0).count() == 3


def test_shapes_of_lists(spark):
    texts = ['[1, 2]', '{"items": [1]}', '{"any": [1, 2, 3]}', '{"a": [1], "b": [2]}', '"x"', '{"a": 1}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", F.size(snapshots.as_list(F.parse_json("t"))).alias("n")).orderBy("i").collect()
    assert [r.n if r.n != -1 else None for r in got] == [2, 1, 3, None, None, None]


def test_haystack_keeps_places_and_registry(spark):
    rows = spark.createDataFrame([("t", None, "s", "x")], "title string, title_en string, summary string, source string")
    assert rows.select(snapshots.haystack().alias("h")).first().h == "t \n  \n s \n x"
    registry = spark.createDataFrame([('{"categories": {"a": [{"url": "https://x"}, {"url": "ftp://y"}], "b": 3}}',), ("{",)], "value string")
    assert [(r.category, r.url) for r in snapshots.feeds(registry).collect()] == [("a", "https://x")]


def test_ledger_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"event_type": "item_rated", "n": 1}\n\n{bad\n{"event_type": "odd"}\n{"n": 2}\n{"event_type": "item_seen"}\n')
    rows = ledger.lines(spark, str(tmp_path / "l.jsonl"))
    assert [r.event_type for r in ledger.events(rows, TYPES).orderBy("at", "seq").collect()] == ["item_rated", "item_seen"]
    assert [r.reason for r in ledger.skipped(rows, TYPES).orderBy("at", "seq").collect()] == ["invalid_json", "unknown_event_type:odd", "unknown_event_type:undefined"]


def test_append_refuses_unknown_types(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(spark.createDataFrame([("item_seen", 1)], "event_type string, n int"), path, TYPES)
    with pytest.raises(Exception):
        ledger.append(spark.createDataFrame([("other", 1)], "event_type string, n int"), path, TYPES)
    assert spark.read.json(path).count() == 1


def test_rerun_of_a_date_replaces_it(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "date string, n int"
    ledger.replace_dates(spark.createDataFrame([("2026-04-01", 1), ("2026-04-02", 2)], schema), path)
    for _ in range(2):
        ledger.replace_dates(spark.createDataFrame([("2026-04-02", 3), ("2026-04-02", 4)], schema), path)
    assert sorted((str(r.date), r.n) for r in spark.read.parquet(path).collect()) == [("2026-04-01", 1), ("2026-04-02", 3), ("2026-04-02", 4)]


def test_last_line_wins_sums_and_index(spark):
    rows = spark.createDataFrame([("d1", "a", 1, 5), ("d1", "a", 2, None), ("d1", "b", 3, 7)], "date string, cat string, line int, n int")
    assert sorted((r.cat, r.line, r.n) for r in ledger.last_of_each(rows, ["date", "cat"], ["line"], {"n": 0}).collect()) == [("a", 2, 0), ("b", 3, 7)]
    assert {r.cat: r.n for r in ledger.sums_between(rows, "cat", "date", "d1", "d1", ["n"]).collect()} == {"a": 5, "b": 7}
    index = spark.sql("SELECT date'2026-04-01' + i AS date, 'old' AS v FROM (SELECT explode(sequence(0, 9)) AS i)")
    today = spark.sql("SELECT date'2026-04-10' AS date, 'new' AS v")
    got = [(r.date.day, r.v) for r in ledger.upserted(index, today, "date").collect()]
    assert got == [(10, "new")] + [(d, "old") for d in range(9, 3, -1)]


def test_fold_by_topic(spark):
    rows = spark.createDataFrame([(["a", "b", "a"], "item_seen"), (["a"], "item_rated"), (None, "item_seen")], "topics array<string>, event_type string")
    got = {r.group: (r.seen, r.rated) for r in ledger.folded(rows, F.col("topics"), {"seen": ("item_seen",), "rated": ("item_rated",)}).collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", 1, "2026-04-01 10:00:00"), ("a", 2, "2026-04-01 10:00:00"), ("b", 3, "2026-04-02 23:59:59"), ("a", 4, "2026-03-30 00:00:00"), ("a", 1, "2026-04-01 10:00:00")]
    e = spark.createDataFrame(rows, "k string, id int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    latest = streams.completed(streams.latest(read(), "k", "ts", "id"), str(tmp_path / "o1"))
    assert sorted((r.k, r.id) for r in latest.collect()) == [("a", 1), ("b", 3)]
    counts = streams.completed(streams.daily_counts(read(), "ts", "k"), str(tmp_path / "o2"))
    assert sorted((r.k, str(r.day), r.n) for r in counts.collect()) == [("a", "2026-03-30", 1), ("a", "2026-04-01", 3), ("b", "2026-04-02", 1)]
    seen = []
    once = streams.new_only(read(), ["id", "ts"], "ts", "30 days")
    streams.completed(once, str(tmp_path / "o3"), lambda batch, _: seen.extend(r.id for r in batch.collect()), "append")
    assert sorted(seen) == [1, 2, 3, 4]


def test_merge_with_history(spark):
    schema = "seq int, url string, name string, date string, note string, first_seen string, last_seen string"
    now = spark.createDataFrame([(0, "https://X.org/a/?utm_source=1", "n", "2026-04-05", None, None, None), (1, "https://x.org/a", "dup", "2026-04-06", "d", None, None), (2, None, " Z ", "2026-04-05", "c", None, None), (3, "", " ", "2026-04-05", "no key", None, None)], schema)
    old = spark.createDataFrame([(0, "https://x.org/a", "o", "2026-04-01", "kept", "f", "l"), (1, None, "gone", "2025-01-01", "x", "f", "l"), (2, None, "q", "2026-04-05", "y", None, "l2")], schema)
    got = merge.with_history(now, old, merge.item_key(F.col("url"), F.col("name")), "date", "2026-01-01", "2026-04-30", "NOW", 20).collect()
    assert [(r.name, r.note, r.is_new, r.first_seen, r.last_seen) for r in got] == [("n", "kept", False, "f", "NOW"), (" Z ", "c", True, "NOW", "NOW"), ("q", "y", False, "l2", "l2")]


def test_answers(spark):
    ins = spark.createDataFrame([("a",), ("b",)], "id string")
    out = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("z", 3, "x")], "id string, at int, v string")
    assert sorted(map(tuple, merge.answered(ins, out, "id", "at", {"v": "none"}).collect())) == [("a", True, "x"), ("b", False, "none")]
    assert sorted((r.id, r.reason) for r in merge.discarded(ins, out, "id", "at").collect()) == [("a", "duplicate_id"), ("z", "unknown_id")]
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "q"]), (3, []), (4, None)], "k int, ids array<string>")
    assert {r.k: r.ids_known for r in merge.all_known(rows, "k", "ids", ins, "id").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_quota_like_a_loop(spark):
    rows = [(i, "ab"[i % 3 == 0], (i * 7) % 10, i % 5 > 0) for i in range(30)]
    want, used, total = {}, {}, 0
    for i, g, v, ok in sorted(rows, key=lambda r: (-r[2], r[0])):
        if not ok:
            want[i] = "ineligible"
        elif used.get(g, 0) >= 4:
            want[i] = "group_cap"
        else:
            used[g] = used.get(g, 0) + 1
            want[i] = "chosen" if total < 6 else "total_cap"
            total += 1
    df = spark.createDataFrame(rows, "i int, g string, v int, ok boolean")
    assert {r.i: r.outcome for r in feedback.allocated(df, "i", "g", F.col("ok"), [F.desc("v"), F.col("i")], 4, 6).collect()} == want


def test_silence(spark):
    cursor, none = spark.sql("SELECT '1970-01-01T00:00:00Z' AS last_ts"), spark.sql("SELECT '' AS last_ts WHERE false")
    metrics = spark.createDataFrame([("2026-04-10", 0), ("2026-03-01", 5)], "date string, ratings int")
    ratings = spark.createDataFrame([("2026-04-09",)], "date string")
    r = feedback.silence("2026-04-10", 3, metrics, ratings.limit(0), cursor).first()
    assert (r.state, r.reasons) == ("yellow", ["metrics_zero", "ledger_zero", "cursor_epoch"])
    r = feedback.silence("2026-04-10", 3, metrics.limit(0), ratings, none).first()
    assert (r.state, r.reasons, r.ledger_rows) == ("green", ["metrics_missing", "cursor_missing"], 1)


def test_relative(spark):
    rows = [("up", d, 1 if d < 4 else 3) for d in range(1, 7)] + [("flat", d, 2) for d in range(1, 7)]
    df = spark.createDataFrame(rows, "g string, d int, n int").withColumn("day", F.date_add(F.lit("2026-04-01").cast("date"), "d")).drop("d")
    got = {r.g: (r.ratio, r.relative) for r in series.relative(df, "g", "n", 3, 6).collect()}
    assert got == {"up": (1.5, 0.2), "flat": (1.0, -0.2)}


def test_choice_of_topics_like_a_loop(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, 14 - i * 5 % 14, f"h{i % 4}", [w for j, w in enumerate(words) if (i * (j + 3) + j) % 4 < 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "item int, d int, host string, terms array<string>").withColumn("day", F.date_add(F.lit("2026-03-31").cast("date"), "d")).drop("d")
    pairs = {}
    for r in rows:
        for p in itertools.combinations(sorted(r[3]), 2):
            pairs.setdefault(p, []).append(r)
    scores = {}
    for p, own in pairs.items():
        recent = [r for r in own if r[1] >= 8]
        if len(own) >= 2 and len(recent) >= 2:
            scores[p] = len(recent) + 1.5 * len({r[2] for r in recent}) + (2 if any(r[1] >= 13 for r in recent) else 0)
    want, rest = [], dict(scores)
    while rest and len(want) < 3:
        used = {t for p in want for t in p}
        best = min(rest, key=lambda p: (-rest[p] / (1 + 2 * len(used & set(p))), p))
        del rest[best]
        ids = {r[0] for r in pairs[best]}
        if all(len(ids & {r[0] for r in pairs[q]}) / min(len(ids), len(pairs[q])) < 0.65 for q in want):
            want.append(best)
    found = dynamic.candidates(df, df, "2026-04-14")
    got = dynamic.selected(found, df, "2026-04-14", limit=3).orderBy("rank").collect()
    assert want and [(r.a, r.b) for r in got] == want and all(r.score == scores[r.a, r.b] for r in got)


def test_no_topics_in_an_empty_table(spark):
    none = spark.createDataFrame([], "item int, day date, host string, terms array<string>")
    assert dynamic.selected(dynamic.candidates(none, none, "2026-04-14"), none, "2026-04-14").count() == 0
