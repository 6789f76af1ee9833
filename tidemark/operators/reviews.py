"""Reviews as gates: forecasts of topics, and verdicts on proposed changes, which stand only where their evidence, way back, quota and risk can be proven.

Both are lists of steps of `gates`: nothing is ever raised or filled in, only dropped, lowered or left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import capped, clamp01
from tidemark.operators.gates import NOTES, REASON, Drop, First, Fix, Quota, Step, _in, completed, ordered_about, ruled, text_list
from tidemark.operators.roadmap import TRAJECTORIES
from tidemark.tables import Steps

# Fixed values of forecasts.
NONE, UNKNOWN = "none", "unforecastable"
HORIZONS, BLOCKERS = ("near", "mid", "far", NONE), ("B1", "B2", "B3", "B4", "B5", "B6")
MILESTONE, FALSIFIER, ADOPTION, SIGNALS, MOST_BLOCKERS = 60, 120, 40, (3, 60), 2


def _blank(source: str) -> dict[str, str]:
    """A forecast that says nothing."""
    texts = dict.fromkeys(("next_milestone", "falsifier", "adoption_note"), "''") | dict.fromkeys(("watch_signals", "blockers_ranked", "rubric_hits"), "CAST(array() AS array<string>)")
    return texts | {"trajectory": f"'{UNKNOWN}'", "horizon": f"'{NONE}'", "confidence": "0.0D", "security_flag": "false", "source": f"'{source}'"}


_SILENT = (("trajectory", f"'{UNKNOWN}'"), ("forced", "true"))
#: Forecasts: a milestone that nothing could refute is no forecast; what the gate itself made unforecastable has no confidence, what the answer called so keeps its own.
ROADMAP: tuple[Step, ...] = (
    Drop("unknown_cluster_id", "NOT known"),
    First("duplicate", ("cluster_id",)),
    Fix("contract_violation", f"NOT {_in('trajectory', TRAJECTORIES)}", tuple(_blank("contract_violation").items())),
    Fix("security_flag", f"security_flag AND trajectory <> '{UNKNOWN}'", _SILENT),
    Fix("no_falsifier", "next_milestone <> '' AND falsifier = ''", _SILENT),
    Fix("horizon_unknown", f"NOT {_in('horizon', HORIZONS)}", (("horizon", f"'{NONE}'"),)),
    Fix("horizon_cleared", f"trajectory = '{UNKNOWN}' AND horizon <> '{NONE}'", (("horizon", f"'{NONE}'"),)),
    Fix("milestone_cleared", f"trajectory = '{UNKNOWN}' AND next_milestone <> ''", (("next_milestone", "''"),)),
    Fix("confidence_cleared", "forced AND confidence > 0", (("confidence", "0.0D"),)),
)


def roadmap_ruled(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """answers (seq, cluster_id, trajectory, horizon, next_milestone, falsifier, watch_signals, adoption_note, blockers_ranked, confidence, rubric_hits, security_flag) through ROADMAP.

    Null texts are empty, a null or broken confidence is 0, blockers outside their scale and repeated ones fall away.
    """
    ids = clusters.select("cluster_id").distinct().withColumn("known", F.lit(True))
    own = answers.join(ids, "cluster_id", "left").withColumn("known", F.col("known").isNotNull())
    texts = {c: F.coalesce(capped(F.col(c), n), F.lit("")) for c, n in (("next_milestone", MILESTONE), ("falsifier", FALSIFIER), ("adoption_note", ADOPTION))}
    named = F.filter(F.transform(F.coalesce("blockers_ranked", F.expr("CAST(array() AS array<string>)")), lambda x: capped(x, 16)), lambda x: x.isin(*BLOCKERS))
    shaped = texts | {
        "watch_signals": text_list(F.col("watch_signals"), *SIGNALS), "rubric_hits": text_list(F.col("rubric_hits"), 8, 16), "blockers_ranked": F.slice(F.array_distinct(named), 1, MOST_BLOCKERS),
        "confidence": clamp01(F.col("confidence").cast("double")), "security_flag": F.coalesce("security_flag", F.lit(False)), "source": F.lit("model"), "forced": F.lit(False),
    }
    return ruled(own.withColumns(shaped), ROADMAP, "seq").drop("known", "forced")


def roadmap_gate(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """One forecast for each cluster, with source (model, contract_violation or unassessed) and gate_notes."""
    ids = clusters.select("cluster_id").where("cluster_id is not null").distinct()
    return completed(roadmap_ruled(answers, clusters), ids, "cluster_id", _blank("unassessed") | {NOTES: "array('unassessed')"})


# Fixed values of changes: what may be changed, the metrics that evidence may name, the changes of medium risk, and words that say the way back.
TARGETS = r"^scripts/prompts/[a-z_]+\.md$|^assets/js/config\.js$|^scripts/tier-b-domains\.json$"
METRICS = ("verified_rate", "priority_hit_rate", "needs_review", "validation_pass_rate", "human_rating_score", "title_low_match", "backfill", "items", "verified", "priority_hits", "human_rating_count")
MEDIUM = ("drop_query", "drop_keyword", "rephrase_query")
UNDO_ADDED, UNDO_OTHER = "移除|(?i:remove)", "還原|快照|(?i:restore)"
CHECKS, TAINTED = ("CE-1", "CE-2", "CE-3", "CE-4"), "CE-5"
MEDIUM_DATES = 2
DATE, NUMBER = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"(?<![\p{L}\p{N}_.])-?[0-9]+(?:\.[0-9]+)?(?![\p{L}\p{N}_.])"


def change_steps(each: int, total: int) -> tuple[Step, ...]:
    """Verdicts on changes: tainted ones first, then what was answered, then what can be proven, then quotas in the proposals' order."""
    return (
        Drop("security_flag", "tainted"),
        Drop("category_tainted", "category_tainted"),
        Drop("forbidden_key", "voided"),
        Drop("missing", "NOT answered"),
        Drop("illegal_verdict", f"NOT {_in('answer', ('accept', 'reject'))}"),
        Drop("rejected", "answer = 'reject'"),
        Drop("rubric", "size(failed) > 0"),
        Drop("hits_incomplete", f"size(array_intersect(hits, array({', '.join(map(repr, CHECKS))}))) < {len(CHECKS)}"),
        Quota("category", each, total, "category_quota", "total_quota"),
    )


def _milli(x: Column) -> Column:
    return F.floor(x.cast("double") * 1000 + 0.5)


def evidenced(proposals: DataFrame, metrics: DataFrame) -> DataFrame:
    """seq and matched_dates of the proposals (seq, category, evidence) of which a number is a metric of its category, to three places.

    An evidence text that names dates or metrics means only those. Each text gives the earliest date that it fits. A date's own digits count as numbers,
    as any others. Metrics (category, date, any of METRICS) are grouped by category and value first, an equality join then finds them: a group has at most
    as many entries as the window has dates times metrics, and a text is joined once for each of its numbers, whatever the category's size.
    """
    there = [m for m in METRICS if m in metrics.columns]
    if not there:
        return proposals.select("seq", F.expr("CAST(array() AS array<string>)").alias("matched_dates")).limit(0)
    cells = metrics.select("category", F.col("date").cast("string").alias("date"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in there))).alias("c"))
    cells = cells.where("date is not null and c.v is not null and not isnan(c.v)")
    values = cells.groupBy("category", _milli(F.col("c.v")).alias("_milli")).agg(F.collect_set(F.struct("date", "c.metric")).alias("_cells"))
    said = proposals.select("seq", "category", F.posexplode("evidence").alias("_i", "_text"))
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(NUMBER), F.lit(0)), _milli))
    # Before the explode, so that they are worked out once a text and not once a number.
    said = said.select("seq", "category", "_i", F.regexp_extract_all("_text", F.lit(DATE), F.lit(0)).alias("_dates"), F.filter(F.array(*map(F.lit, METRICS)), lambda m: F.contains(F.col("_text"), m)).alias("_named"), numbers.alias("_numbers"))
    said = said.select("seq", "category", "_i", "_dates", "_named", F.explode("_numbers").alias("_milli"))
    fits = lambda x: ((F.size("_dates") == 0) | F.array_contains("_dates", x["date"])) & ((F.size("_named") == 0) | F.array_contains("_named", x["metric"]))
    hits = said.join(values, ["category", "_milli"]).withColumn("_date", F.array_min(F.transform(F.filter("_cells", fits), lambda x: x["date"])))
    return hits.where("_date is not null").groupBy("seq", "_i").agg(F.min("_date").alias("_date")).groupBy("seq").agg(F.sort_array(F.collect_set("_date")).alias("matched_dates"))


def change_facts(proposals: DataFrame, metrics: DataFrame, in_flight: DataFrame, remaining: int, each: int) -> DataFrame:
    """proposals (seq, category, change_type, target_files, risk, rollback, evidence) with matched_dates and `failed`, the checks that don't hold.

    CE-1: there is evidence, every text has a digit and one matches a metric. CE-2: a way back that suits the change, and targets that may be changed.
    CE-3: quota left, none of the category (rows of in_flight: category, n) under way. CE-4: changes of medium risk cite two dates of the window.
    """
    evidence = F.filter(F.coalesce("evidence", F.expr("CAST(array() AS array<string>)")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    own = proposals.withColumn("evidence", evidence)
    medium = (F.coalesce("risk", F.lit("")) == "medium") | F.coalesce("change_type", F.lit("")).isin(*MEDIUM)
    days = metrics.select(F.col("date").cast("string").alias("_day")).where("_day is not null").distinct()
    cited = own.where(medium).select("seq", F.explode(F.array_distinct(F.flatten(F.transform("evidence", lambda x: F.regexp_extract_all(x, F.lit(DATE), F.lit(0)))))).alias("_day"))
    cited = cited.join(days, "_day").groupBy("seq").agg(F.count("*").alias("_cited"))
    busy = in_flight.where("n > 0").select("category").distinct().withColumn("_busy", F.lit(True))
    own = own.join(evidenced(own, metrics), "seq", "left").join(cited, "seq", "left").join(busy, "category", "left")
    back = F.coalesce("rollback", F.lit(""))
    undo = F.when(F.startswith(F.coalesce("change_type", F.lit("")), F.lit("add_")), back.rlike(UNDO_ADDED)).otherwise(back.rlike(UNDO_OTHER))
    targets = F.filter(F.coalesce("target_files", F.expr("CAST(array() AS array<string>)")), lambda x: x.isNotNull())
    holds = {
        "CE-1": (F.size("evidence") > 0) & F.forall("evidence", lambda x: x.rlike("[0-9]")) & F.col("matched_dates").isNotNull(),
        "CE-2": undo & (F.size(targets) > 0) & F.forall(targets, lambda x: x.rlike(TARGETS)),
        "CE-3": F.lit(remaining > 0 and each > 0) & F.col("_busy").isNull(),
        "CE-4": ~medium | (F.coalesce("_cited", F.lit(0)) >= MEDIUM_DATES),
    }
    return own.withColumn("failed", F.array_compact(F.array(*(F.when(~ok, name) for name, ok in holds.items())))).drop("_cited", "_busy")


def change_gate(proposals: DataFrame, verdicts: DataFrame, metrics: DataFrame, in_flight: DataFrame, remaining: int, each: int = 1, voided: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Each proposal with an id: verdict (accept or reject), drop_reason (null: accepted), rubric_hits, failed, matched_dates and flagged_field.

    proposals: seq (distinct), proposal_id, summary and the columns of change_facts. verdicts: seq, proposal_id, verdict, rubric_hits, security_flag; the first of
    an id counts. Whatever holds words that give orders, or is flagged by a verdict, taints its whole category. voided: the answer had keys that it must not have, so nothing of it counts.
    """
    row = F.struct(F.col("verdict").alias("answer"), F.filter(F.coalesce("rubric_hits", F.expr("CAST(array() AS array<string>)")), lambda x: x.rlike("^CE-[1-5]$")).alias("hits"), F.coalesce("security_flag", F.lit(False)).alias("flag"))
    first = verdicts.where("proposal_id is not null").groupBy("proposal_id").agg(F.min_by(row, "seq").alias("_v"))
    base = proposals.where("proposal_id is not null").withColumn("flagged_field", ordered_about({c: F.col(c) for c in ("summary", "rollback")}, {"evidence": F.col("evidence")}, more))
    # Facts and tainted categories come from the proposals themselves: from joined rows each of them would do the joins again.
    flagged = base.select("proposal_id", "category").join(first.where("_v.flag").select("proposal_id"), "proposal_id")
    bad = base.where("flagged_field is not null").select("category").union(flagged.select("category")).distinct().withColumn("category_tainted", F.lit(True))
    own = change_facts(base, metrics, in_flight, remaining, each).join(bad, "category", "left").join(first, "proposal_id", "left")
    own = own.withColumns({"answered": F.col("_v").isNotNull(), "answer": F.col("_v.answer"), "hits": F.coalesce("_v.hits", F.expr("CAST(array() AS array<string>)")), "tainted": F.col("flagged_field").isNotNull() | F.coalesce("_v.flag", F.lit(False)), "voided": F.lit(voided)}).drop("_v")
    own = own.withColumn("category_tainted", F.col("category_tainted").isNotNull())
    # The quota reads the rows three times, so what has been found out about them is written once.
    own = Steps(own.sparkSession).result(own)
    out = ruled(own, change_steps(each, max(0, remaining)), "seq").drop(NOTES)
    reason, just = F.col(REASON), lambda *names: F.array(*map(F.lit, names))
    hits = (
        F.when(reason.isNull(), just(*CHECKS)).when(reason.isin("security_flag", "category_tainted"), just(TAINTED)).when(reason == "forbidden_key", F.when(F.size("hits") > 0, F.array_distinct("hits")).otherwise(just(TAINTED)))
        .when(reason == "rubric", F.col("failed")).when(reason.isin("hits_incomplete", "category_quota", "total_quota"), just("CE-3")).otherwise(F.array_distinct("hits"))
    )
    out = out.withColumns({"rubric_hits": hits, "verdict": F.when(reason.isNull(), "accept").otherwise("reject")})
    return out.drop("answered", "answer", "hits", "tainted", "voided", "category_tainted")


def change_report(gated: DataFrame) -> DataFrame:
    """One row: overall (accept if anything is accepted), score (accepted of all, to 3 places, 0 of none), proposals and accepted."""
    n, yes = F.count("*"), F.count_if(F.col("verdict") == "accept")
    return gated.agg(F.when(yes > 0, "accept").otherwise("reject").alias("overall"), F.when(n > 0, F.floor(yes / n * 1000 + 0.5) / 1000).otherwise(0.0).alias("score"), n.alias("proposals"), yes.alias("accepted"))


def decided(packets: DataFrame, replies: DataFrame) -> DataFrame:
    """replies (request_id, reply) with decision and reason: approve or reject only where the reply is, to the letter, what its packet (request_id, exact_approve, exact_reject; one row each) asks for.

    A null reply or one without a packet is invalid_decision_input, any other text exact_request_bound_reply_required. If both texts are the same it is approve.
    """
    own = replies.join(packets.select("request_id", "exact_approve", "exact_reject", F.lit(True).alias("_there")), "request_id", "left")
    reply = F.col("reply")
    decision = F.when(reply == F.col("exact_approve"), "approve").when(reply == F.col("exact_reject"), "reject")
    reason = F.when(reply.isNull() | F.col("_there").isNull(), "invalid_decision_input").when(decision.isNull(), "exact_request_bound_reply_required")
    return own.select(*replies.columns, decision.alias("decision"), reason.alias("reason"))
