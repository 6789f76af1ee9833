"""Status ladder, release gate, technology of topics, trajectories and confidence, by the cases of their rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import roadmap, status

T = datetime.datetime
GOOD = {"duplicate": False, "ingestion": "available", "preview": "available", "public": "available", "source_date": "2026-09-20", "ingestion_at": T(2026, 9, 20, 8), "preview_date": "2026-09-20", "preview_at": T(2026, 9, 20, 9), "public_date": "2026-09-20", "public_at": T(2026, 9, 20, 9, 30), "as_of": T(2026, 9, 20, 12)}
SYSTEM = "id int, duplicate boolean, ingestion string, preview string, public string, source_date string, ingestion_at timestamp, preview_date string, preview_at timestamp, public_date string, public_at timestamp, as_of timestamp"
CASES = [
    ({}, "fresh", None), ({"duplicate": True, "ingestion": "invalid"}, "blocked", "manifest_duplicate_path"), ({"public": "invalid", "ingestion": "missing"}, "blocked", "public_artifact_invalid"), ({"ingestion": "degraded"}, "blocked", "ingestion_artifact_missing"), ({"preview": None}, "blocked", "preview_artifact_missing"),
    ({"source_date": None}, "blocked", "source_latest_date_missing"), ({"ingestion_at": None}, "blocked", "ingestion_timestamp_missing"), ({"preview_date": None}, "blocked", "preview_source_date_missing"), ({"preview_at": None}, "blocked", "preview_timestamp_missing"),
    ({"ingestion_at": T(2026, 9, 20, 13)}, "blocked", "ingestion_timestamp_in_future"), ({"preview_at": T(2026, 9, 20, 13)}, "blocked", "preview_timestamp_in_future"), ({"public_at": T(2026, 9, 20, 13)}, "blocked", "public_timestamp_in_future"),
    ({"preview_date": "2026-09-21"}, "blocked", "preview_date_ahead_of_source"), ({"public_date": "2026-09-21"}, "blocked", "public_date_ahead_of_source"), ({"ingestion_at": T(2026, 9, 19, 9, 59)}, "stale", "ingestion_stale"), ({"ingestion_at": T(2026, 9, 19, 10)}, "fresh", None),
    ({"preview_date": "2026-09-19"}, "stale", "preview_stale"), ({"public": "missing"}, "pending", None), ({"public_date": None}, "pending", None), ({"public_at": None}, "pending", None), ({"public_date": "2026-09-19"}, "pending", None), ({"public_at": T(2026, 9, 19, 8, 59)}, "pending", None), ({"public_at": T(2026, 9, 19, 9)}, "fresh", None),
]


def systems(spark):
    return spark.createDataFrame([(i, *(GOOD | c).values()) for i, (c, _, _) in enumerate(CASES)], SYSTEM)


def test_the_first_rung_that_holds_decides(spark):
    got = {r.id: r for r in status.status(systems(spark)).collect()}
    for i, (_, state, reason) in enumerate(CASES):
        assert (got[i].freshness_state, got[i].blocked_reason) == (state, reason), CASES[i]
        assert got[i].publish_state == {"fresh": "published", "pending": "pending_owner_review"}.get(state, "blocked")
    assert got[21].lag_hours == 24.0167 and got[0].lag_hours == 0.0 and got[19].lag_hours is None


def test_what_is_stored_must_be_what_is_worked_out(spark):
    own = systems(spark).where("id < 3")
    stored = spark.createDataFrame([(0, "fresh", "published", None, GOOD["as_of"]), (1, "fresh", "published", None, T(2026, 9, 1)), (9, "fresh", "published", None, GOOD["as_of"])], "id int, freshness_state string, publish_state string, blocked_reason string, as_of timestamp")
    got = {r.id: (r.release, r.reasons) for r in status.released(stored, own, "id").collect()}
    assert got == {0: (True, []), 1: (False, ["status_outdated", "differs:freshness_state", "differs:publish_state", "differs:blocked_reason", "not_fresh"]), 2: (False, ["status_missing", "not_fresh"]), 9: (False, ["unknown_system"])}


MEMBER = "topic string, cluster_id string, size int, tech_layer string, secondary_layers array<string>, maturity string, delta string, evidence_grade string, blockers array<string>"


def test_members_make_a_topic(spark):
    rows = [
        ("a", "1", 20, "S3", ["S4"], "M4", "D3", "E3", ["B2", "B1"]), ("a", "2", 3, "S1", None, "M9", "D0", "E3", ["B1"]), ("a", "3", 3, "S1", [], None, "D1", "E3", None), ("a", "4", 99, None, None, "M5", "D3", "E1", None),
        ("b", "5", None, "S2", ["S6", "S5", "S4", "S1"], "M5", "D3", "E2", None), ("b", "6", 1, "S2", None, "M1", "D0", "E2", None), ("b", "7", 1, "S2", None, "M1", "D0", "E2", None),
        ("c", "8", 1, "S1", None, "M1", "D3", "E1", None), ("c", "9", 1, "S2", None, "M1", "D0", "E9", None), ("d", "10", 1, None, None, "M1", "D0", "E1", None),
    ]
    got = {r.topic: r for r in roadmap.assessed(spark.createDataFrame(rows, MEMBER), "topic").collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.tech_layer, a.secondary_layers, a.maturity, a.delta, a.evidence_grade, a.blockers) == ("S3", ["S1", "S4"], "M2", "D1", "E3", ["B1", "B2"]) and a.cap_notes == ["E3: M4 to M2", "E3: D3 to D1"]
    assert (b.tech_layer, b.secondary_layers, b.maturity, b.delta, b.evidence_grade, b.cap_notes) == ("S2", ["S1", "S4", "S5"], "M5", "D2", "E2", ["no E1: D3 to D2"])
    assert (c.tech_layer, c.delta, c.evidence_grade, c.cap_notes) == ("S1", "D3", "E1", [])


def test_absent_assessments_are_counted(spark):
    one = lambda *t: spark.createDataFrame([(x,) for x in t], "topic string")
    rows, counts = roadmap.joined(one("a", "b", "c"), one("a", "b"), one("b"), "topic")
    assert {r.topic: r.tech_present for r in rows.collect()} == {"a": False, "b": True} and tuple(counts.first()) == (1, 1)


@pytest.mark.parametrize(("row", "found", "horizon", "sure"), [
    (("emerging", "model", "S3", ["S4"], "M2", "D2", "E1", 0.9), "layer_shift", "mid", 0.9), (("emerging", "model", "S3", [], "M3", "D3", "E2", 0.9), "capability_deepening", "near", 0.9), (("plateau", "model", "S3", ["S4"], "M2", "D2", "E1", 0.9), "unforecastable", "mid", 0.0),
    (("plateau", "model", "S6", ["S1"], "M4", "D1", "E1", 0.95), "commoditizing", "near", 0.9), (("plateau", "model", "S1", ["S3"], "M5", "D1", "E3", 0.95), "consolidating", "mid", 0.7), (("declining", "model", "S1", ["S3"], "M1", "D1", "E1", 0.6), "stalling", "far", 0.6),
    (("insufficient", "model", "S3", [], "M3", "D3", "E1", 0.9), "unforecastable", "near", 0.0), (("emerging", "unassessed", "S3", [], "M3", "D3", "E1", 0.9), "unforecastable", "near", 0.0), (("declining", "model", "S3", [], "M3", "D3", "E1", 0.9), "unforecastable", "near", 0.0),
    (("plateau", "model", None, None, None, None, None, 0.9), "unforecastable", "mid", 0.0), ((None, None, "S3", [], "M3", "D3", "E1", None), "unforecastable", "near", 0.0),
])
def test_trajectories(spark, row, found, horizon, sure):
    c = F.col
    df = spark.createDataFrame([row], "stage string, source string, layer string, secondary array<string>, maturity string, delta string, grade string, upstream double")
    df = df.withColumn("t", roadmap.trajectory(c("stage"), c("source"), c("layer"), c("secondary"), c("maturity"), c("delta"))).withColumn("h", roadmap.horizon(c("maturity")))
    r = df.withColumn("s", roadmap.confidence(c("t"), c("upstream"), c("stage"), c("grade"), c("layer").isNull(), F.lit(2), F.lit(True))).first()
    assert (r.t, r.h, r.s) == (found, horizon, sure)


def test_confidence_goes_down_only(spark):
    cases = [("stalling", 0.9, "plateau", "E1", True, 0, False, 0.4), ("commoditizing", 1.0, "plateau", None, False, 1, True, 0.7), ("commoditizing", 1.0, "plateau", "E2", True, 1, False, 0.3), ("stalling", None, "plateau", "E1", False, 2, True, 0.0), ("stalling", 0.2, "declining", "E1", False, 5, True, 0.2)]
    df = spark.createDataFrame(cases, "t string, u double, stage string, g string, absent boolean, n int, dated boolean, want double")
    c = F.col
    for r in df.select("want", roadmap.confidence(c("t"), c("u"), c("stage"), c("g"), c("absent"), c("n"), c("dated")).alias("got")).collect():
        assert r.got == r.want
