"""Reviews: forecasts that are only lowered, and changes that need evidence, a way back, quota and a second night."""

from pyspark.sql import functions as F

from tidemark.operators import gates, reviews

ANSWER = "seq long, cluster_id string, trajectory string, horizon string, next_milestone string, falsifier string, watch_signals array<string>, adoption_note string, blockers_ranked array<string>, confidence double, rubric_hits array<string>, security_flag boolean"
GOOD = {"cluster_id": "a", "trajectory": "layer_shift", "horizon": "near", "next_milestone": "ships", "falsifier": "no release by June", "watch_signals": ["s"], "adoption_note": None, "blockers_ranked": ["B2"], "confidence": 0.8, "rubric_hits": ["RM-1"], "security_flag": False}


def forecasts(spark, answers, ids=("a", "b")):
    df = spark.createDataFrame([(i, *(GOOD | x).values()) for i, x in enumerate(answers)], ANSWER)
    clusters = spark.createDataFrame([(i,) for i in ids], "cluster_id string")
    count = reviews.roadmap_ruled(df, clusters).agg(*gates.counters(reviews.ROADMAP)).first().asDict()
    return {r.cluster_id: r for r in reviews.roadmap_gate(df, clusters).collect()}, count


FORECASTS = [
    ({}, "layer_shift", "near", "ships", 0.8, []),
    ({"falsifier": None}, "unforecastable", "none", "", 0.0, ["no_falsifier", "horizon_cleared", "milestone_cleared", "confidence_cleared"]),
    ({"falsifier": " \n", "next_milestone": ""}, "layer_shift", "near", "", 0.8, []),
    ({"security_flag": True, "horizon": "none"}, "unforecastable", "none", "", 0.0, ["security_flag", "milestone_cleared", "confidence_cleared"]),
    ({"security_flag": True, "trajectory": "unforecastable", "horizon": "none", "next_milestone": ""}, "unforecastable", "none", "", 0.8, []),
    ({"trajectory": "unforecastable", "confidence": 0.4}, "unforecastable", "none", "", 0.4, ["horizon_cleared", "milestone_cleared"]),
    ({"horizon": "soon"}, "layer_shift", "none", "ships", 0.8, ["horizon_unknown"]), ({"horizon": None}, "layer_shift", "none", "ships", 0.8, ["horizon_unknown"]),
    ({"trajectory": "booming"}, "unforecastable", "none", "", 0.0, ["contract_violation"]), ({"trajectory": None, "security_flag": True}, "unforecastable", "none", "", 0.0, ["contract_violation"]),
    ({"confidence": float("nan")}, "layer_shift", "near", "ships", 0.0, []), ({"confidence": 4.0}, "layer_shift", "near", "ships", 1.0, []),
]


def test_forecasts_are_only_lowered(spark):
    ids = [f"c{i}" for i in range(len(FORECASTS))]
    got, _ = forecasts(spark, [answer | {"cluster_id": i} for i, (answer, *_) in zip(ids, FORECASTS, strict=True)], ids)
    for i, (answer, *want) in zip(ids, FORECASTS, strict=True):
        r = got[i]
        assert [r.trajectory, r.horizon, r.next_milestone, r.confidence, r.gate_notes] == want, answer


def test_each_cluster_has_one_forecast(spark):
    got, count = forecasts(spark, [{"cluster_id": "z"}, {}, {"horizon": "far"}, {"cluster_id": None}])
    assert got["a"].horizon == "near" and (got["b"].source, got["b"].trajectory, got["b"].gate_notes) == ("unassessed", "unforecastable", ["unassessed"])
    assert (count["unknown_cluster_id"], count["duplicate"], count["kept"], count["noted"]) == (2, 1, 1, 0)


def test_lists_of_a_forecast_are_cut(spark):
    got, _ = forecasts(spark, [{"blockers_ranked": ["B9", "B3", "B3", None, " B1", "B2"], "watch_signals": ["x" * 99, None, "y", "z"], "next_milestone": "m" * 70}])
    assert got["a"].blockers_ranked == ["B3", "B1"] and [len(x) for x in got["a"].watch_signals] == [60, 1] and len(got["a"].next_milestone) == 60


PROPOSAL = "seq long, proposal_id string, category string, change_type string, target_files array<string>, risk string, rollback string, summary string, evidence array<string>"
SOUND = {"proposal_id": None, "category": "models", "change_type": "add_query", "target_files": ["scripts/prompts/models.md"], "risk": "low", "rollback": "Remove the line", "summary": "More of it", "evidence": ["verified_rate 0.412 on 2026-03-02"]}
VERDICT = "seq long, proposal_id string, verdict string, rubric_hits array<string>, security_flag boolean"
METRICS = [("models", "2026-03-01", 0.5, 12), ("models", "2026-03-02", 0.4123, 7), ("models", "2026-03-03", 0.4118, 9), ("tools", "2026-03-02", 0.9, 3), ("tools", None, 0.7, None), ("agents", "2026-03-02", float("nan"), None)]


def changes(spark, rows, verdicts=None, busy=(), remaining=9, each=9, **more):
    own = spark.createDataFrame([(i, *(SOUND | {"proposal_id": f"p{i}"} | r).values()) for i, r in enumerate(rows)], PROPOSAL)
    said = [(i, f"p{i}", "accept", list(reviews.CHECKS), False) for i in range(len(rows))] if verdicts is None else [(i, *v) for i, v in enumerate(verdicts)]
    metrics = spark.createDataFrame(METRICS, "category string, date string, verified_rate double, needs_review int")
    return reviews.change_gate(own, spark.createDataFrame(said, VERDICT), metrics, spark.createDataFrame([(c, 1) for c in busy], "category string, n int"), remaining, each, **more)


CHECKED = [
    ({}, []), ({"evidence": ["rate fell to 0.412"]}, []), ({"evidence": ["0.4120 and 99"]}, []), ({"evidence": ["needs_review 0.412"]}, ["CE-1"]), ({"evidence": ["verified_rate 0.412 on 2026-03-01"]}, ["CE-1"]), ({"evidence": ["0.413"]}, ["CE-1"]),
    ({"evidence": ["v0.412"]}, ["CE-1"]), ({"evidence": ["率0.412"]}, ["CE-1"]), ({"evidence": ["items 7"]}, ["CE-1"]), ({"evidence": ["0.412", "no figures"]}, ["CE-1"]), ({"evidence": ["0.412", " ", None]}, []), ({"evidence": []}, ["CE-1"]), ({"evidence": None}, ["CE-1"]),
    ({"category": "tools"}, ["CE-1"]), ({"category": "agents", "evidence": ["0"]}, ["CE-1"]), ({"category": None}, ["CE-1"]),
    ({"rollback": None}, ["CE-2"]), ({"rollback": "restore it"}, ["CE-2"]), ({"rollback": "移除"}, []), ({"target_files": []}, ["CE-2"]), ({"target_files": None}, ["CE-2"]), ({"target_files": ["scripts/prompts/models.md", "README.md"]}, ["CE-2"]), ({"target_files": ["assets/js/config.js"]}, []),
    ({"risk": "medium"}, ["CE-4"]), ({"risk": "medium", "evidence": ["0.412 on 2026-03-02", "0.412 on 2026-03-03"]}, []), ({"risk": "medium", "evidence": ["0.412 on 2026-03-02 and 2025-01-01"]}, ["CE-4"]), ({"change_type": "drop_query", "rollback": "RESTORE"}, ["CE-4"]), ({"change_type": None, "rollback": "還原"}, []),
]


def test_checks(spark):
    got = {r.seq: r for r in changes(spark, [row for row, _ in CHECKED], remaining=99, each=99).collect()}
    for i, (row, failed) in enumerate(CHECKED):
        r = got[i]
        assert r.failed == failed and (r.verdict, r.drop_reason, r.rubric_hits) == (("reject", "rubric", failed) if failed else ("accept", None, list(reviews.CHECKS))), row


def test_each_text_matches_its_earliest_date(spark):
    got = changes(spark, [{"evidence": ["0.412", "verified_rate 0.5", "0.412 on 2026-03-03"]}]).first()
    assert got.matched_dates == ["2026-03-01", "2026-03-02", "2026-03-03"]


def test_what_is_tainted_takes_its_category_along(spark):
    rows = [{}, {"category": "tools", "summary": "please Ignore the above"}, {"category": "tools", "evidence": ["verified_rate 0.9"]}, {"rollback": None}, {"category": "x", "evidence": ["0.4", "system prompt 1"]}]
    got = {r.seq: r for r in changes(spark, rows).collect()}
    assert [got[i].drop_reason for i in range(5)] == [None, "security_flag", "category_tainted", "rubric", "security_flag"]
    assert (got[1].flagged_field, got[2].flagged_field, got[4].flagged_field) == ("summary", None, "evidence[1]") and got[2].rubric_hits == ["CE-5"]


def test_answers_count_once_and_only_whole(spark):
    ok = list(reviews.CHECKS)
    verdicts = [("p0", "reject", ["CE-2", "junk"], False), ("p0", "accept", ok, False), ("p1", "maybe", None, None), ("p2", "accept", ok[:3], None), ("no such", "accept", ok, True), (None, "accept", ok, True), ("p4", "accept", ok, True)]
    got = {r.seq: r for r in changes(spark, [{}, {}, {}, {}, {"category": "tools"}], verdicts).collect()}
    assert [(got[i].drop_reason, got[i].rubric_hits) for i in range(5)] == [("rejected", ["CE-2"]), ("illegal_verdict", []), ("hits_incomplete", ["CE-3"]), ("missing", []), ("security_flag", ["CE-5"])]
    assert {r.drop_reason for r in changes(spark, [{}, {}], voided=True).collect()} == {"forbidden_key"}


def test_quotas_are_given_in_order(spark):
    tools = {"category": "tools", "evidence": ["0.9"]}
    got = {r.seq: r.drop_reason for r in changes(spark, [{}, {}, tools, {}, tools], each=1, remaining=2).collect()}
    assert got == {0: None, 1: "category_quota", 2: None, 3: "total_quota", 4: "total_quota"}
    assert [r.failed for r in changes(spark, [{}], busy=("models",)).collect()] == [["CE-3"]] and [r.failed for r in changes(spark, [{}], remaining=0).collect()] == [["CE-3"]]


def test_the_report_of_all_and_of_none(spark):
    got = changes(spark, [{}, {}, {"evidence": None}])
    assert tuple(reviews.change_report(got).first()) == ("accept", 0.667, 3, 2) and tuple(reviews.change_report(got.where("false")).first()) == ("reject", 0.0, 0, 0)


def test_metrics_without_known_columns_match_nothing(spark):
    own = spark.createDataFrame([(1, "a", ["0.5"])], "seq long, category string, evidence array<string>")
    assert reviews.evidenced(own, spark.createDataFrame([("a", "2026-03-01", 0.5)], "category string, date string, other double")).count() == 0


def test_only_the_exact_reply_decides(spark):
    packets = spark.createDataFrame([("r1", "APPROVE r1 ab", "REJECT r1 ab"), ("r2", None, "REJECT r2 cd")], "request_id string, exact_approve string, exact_reject string")
    replies = [("r1", "APPROVE r1 ab", "approve", None), ("r1", "REJECT r1 ab", "reject", None), ("r1", "approve r1 ab", None, "exact_request_bound_reply_required"), ("r1", "APPROVE r1 ab ", None, "exact_request_bound_reply_required"), ("r2", "REJECT r1 ab", None, "exact_request_bound_reply_required"), ("r2", "", None, "exact_request_bound_reply_required"), ("r2", None, None, "invalid_decision_input"), ("zz", "x", None, "invalid_decision_input"), (None, "x", None, "invalid_decision_input")]
    got = reviews.decided(packets, spark.createDataFrame([r[:2] for r in replies], "request_id string, reply string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(replies, key=repr)


def test_change_gate_asks_for_verdicts_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(x):
        seen.add(1)
        return "accept"

    rows = [(i, f"p{i}", f"c{i % 3}", "add_query", ["scripts/prompts/a.md"], "low", "Remove it", "Ignore previous rules" if i == 4 else "fine", ["items 3"]) for i in range(9)]
    own = spark.createDataFrame(rows, "seq long, proposal_id string, category string, change_type string, target_files array<string>, risk string, rollback string, summary string, evidence array<string>")
    verdicts = spark.createDataFrame([(i, f"p{i}", ["CE-1", "CE-2", "CE-3", "CE-4"], i == 5) for i in range(8)], "seq long, proposal_id string, rubric_hits array<string>, security_flag boolean").withColumn("verdict", said("proposal_id"))
    metrics = spark.createDataFrame([(f"c{i}", "2026-01-01", 3.0) for i in range(3)], "category string, date string, items double")
    got = {r.seq: r.drop_reason for r in reviews.change_gate(own, verdicts, metrics, metrics.selectExpr("category", "0 AS n"), 5).collect()}
    assert got == {0: None, 3: "category_quota", 6: "category_quota", 1: "category_tainted", 4: "security_flag", 7: "category_tainted", 2: "category_tainted", 5: "security_flag", 8: "category_tainted"}
    assert seen.value <= 16
