"""Cursors, days that are rewritten, retention and silence."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dynamic
from tidemark.sources import retention as r
from tidemark.streaming import feedback as streams

D = datetime.date


def test_events_are_pulled_once_in_any_order(spark):
    rng = random.Random(1)
    every = [(f"e{i}", i // 3) for i in range(40)]
    cursor, seen, got = spark.createDataFrame([], "last_ts long"), spark.createDataFrame([], "id string, ts long"), []
    for upto in (5, 5, 6, 13, 13):
        there = [e for e in every if e[1] <= upto] * 2
        rng.shuffle(there)
        new, cursor, seen = r.pulled(spark.createDataFrame(there, "id string, ts long"), cursor, seen, "id", "ts")
        rows, c, s = new.collect(), cursor.collect(), seen.collect()
        got += [x.id for x in rows]
        cursor, seen = spark.createDataFrame(c, "last_ts long"), spark.createDataFrame(s, "id string, ts long")
        assert c[0].last_ts == upto and {x.ts for x in s} == {upto}  # keys below the cursor are gone
    assert sorted(got) == sorted(i for i, _ in every)
    late = r.pulled(spark.createDataFrame([("late", 13), ("lost", 12), ("none", None)], "id string, ts long"), cursor, seen, "id", "ts")[0]
    assert [x.id for x in late.collect()] == ["late"]


def test_days_are_rewritten_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "days")
    make = lambda rows: spark.createDataFrame(rows, "day date, n int")
    for rows in ([(D(2026, 7, 1), 1), (D(2026, 7, 2), 2)], [(D(2026, 7, 2), 5)], [(D(2026, 6, 1), 9)], [(D(2026, 7, 2), 5)]):
        r.rewrite_days(make(rows), path, "day")
    assert sorted((x.day, x.n) for x in spark.read.parquet(path).collect()) == [(D(2026, 6, 1), 9), (D(2026, 7, 1), 1), (D(2026, 7, 2), 5)]


def test_retention_moves_old_days_once(spark):
    hot = spark.createDataFrame([(i, D(2026, 7, i)) for i in range(1, 21)] + [(99, None)], "id int, day date")
    one, archive = r.retired(hot, spark.createDataFrame([(3, D(2026, 7, 3))], "id int, day date"), "id", "day", "2026-07-20")
    assert sorted(x.id for x in one.collect()) == [*range(13, 21), 99] and sorted(x.id for x in archive.collect()) == list(range(1, 13))
    two, again = r.retired(one, archive, "id", "day", "2026-07-20")
    assert two.count() == 9 and again.count() == 12
    days = lambda *n: spark.createDataFrame([(D(2026, 7, i),) for i in n], "day date")
    assert [x.day.day for x in r.missing_days(days(1, 4, 5, 6, 6), days(5), "day", "2026-07-02").collect()] == [4, 6]


def test_silent_signals(spark):
    signals = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    counts = spark.createDataFrame([("a", D(2026, 7, 8), 1), ("a", D(2026, 7, 10), 0), ("b", D(2026, 7, 7), 4)], "g string, day date, n int")
    got = {x.g: (x.last_day, x.silent) for x in r.silent(signals, counts, "g", "day", "n", "2026-07-10", 3).collect()}
    assert got == {"a": (D(2026, 7, 8), False), "b": (D(2026, 7, 7), True), "c": (None, True)}


def test_other_modes_need_a_sink(spark, tmp_path):
    with pytest.raises(ValueError, match="keep"):
        streams.completed(spark.range(1), str(tmp_path / "x"), mode="append")


def test_all_terms_may_form_pairs(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(10), F.lit(49)), lambda x: x.cast("string")).alias("terms"))
    assert dynamic.term_pairs(df).count() == 36 * 35 // 2 and dynamic.term_pairs(df, most=None).count() == 40 * 39 // 2
