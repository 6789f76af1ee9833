"""Gates: ordered rules that every answer has to pass, one definition for all.

A gate is a list of steps over rows with a unique order. Each step sees only the rows that are still live:

- Drop: rows that meet the condition go, with its reason; neighbouring ones become a single CASE, the first that holds counts.
- Fix: rows that meet the condition stay, with other values in some columns, and a note.
- First: of the live rows of a key all but the first go.
- Most: live rows beyond the first n (of each group, if `by` names one) go.
- Quota: at most `each` of a group and `total` altogether stay, as a loop in this order would have them.

Conditions and values are SQL text, so a gate is a table that can be printed and compared; a condition that is null does not hold. The result
has all rows, with drop_reason (null: kept) and gate_notes. Drops and fixes are projections; First and Most group or rank by their key, with
partial results before the shuffle, and never bring a group together whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import capped, clamp01
from tidemark.tables import Steps

REASON, NOTES = "drop_reason", "gate_notes"


@dataclass(frozen=True)
class Drop:
    reason: str
    when: str


@dataclass(frozen=True)
class Fix:
    note: str
    when: str
    values: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class First:
    reason: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Most:
    reason: str
    n: int
    by: str = ""


@dataclass(frozen=True)
class Quota:
    by: str
    each: int
    total: int
    each_reason: str
    total_reason: str


Step = Drop | Fix | First | Most | Quota


def _holds(sql: str) -> Column:
    return F.coalesce(F.expr(sql), F.lit(False))


def _dropped(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.withColumn(REASON, F.coalesce(REASON, reason))


def _limited(rows: DataFrame, step: Most | Quota, order: str) -> DataFrame:
    live = rows.where(F.col(REASON).isNull())
    if isinstance(step, Most) and not step.by:
        last = live.orderBy(order).limit(step.n).agg(F.max(order).alias("_last"))
        late = F.col("_last").isNull() | (F.col(order) > F.col("_last"))
        return _dropped(rows.crossJoin(F.broadcast(last)), F.when(late, step.reason)).drop("_last")
    each = step.n if isinstance(step, Most) else step.each
    # Under a literal limit Spark keeps as many rows of a group in each partition before the shuffle.
    head = live.withColumn("_r", F.row_number().over(W.partitionBy(step.by).orderBy(order))).where(F.col("_r") <= each).select(F.col(order).alias("_o"))
    if isinstance(step, Most):
        return _dropped(rows.join(head, F.col(order) == F.col("_o"), "left"), F.when(F.col("_o").isNull(), step.reason)).drop("_o")
    chosen = head.orderBy("_o").limit(step.total)
    # With the quota used up, whatever comes later is refused for that, whatever its group has.
    full = chosen.agg(F.when(F.count("*") >= step.total, F.coalesce(F.max("_o"), F.lit(-(1 << 62)))).alias("_full"))
    reason = F.when(F.col("_o").isNull(), F.when(F.col(order) > F.col("_full"), step.total_reason).otherwise(step.each_reason))
    return _dropped(rows.join(F.broadcast(chosen), F.col(order) == F.col("_o"), "left").crossJoin(F.broadcast(full)), reason).drop("_o", "_full")


def ruled(rows: DataFrame, steps: Sequence[Step], order: str) -> DataFrame:
    """rows with drop_reason and gate_notes. order: a column of distinct numbers."""
    out = rows.withColumn(REASON, F.lit(None).cast("string")).withColumn(NOTES, F.expr("CAST(array() AS array<string>)"))
    live = F.col(REASON).isNull()
    for kind, run in groupby(steps, type):
        own = list(run)
        if kind is Drop:
            case = F.lit(None).cast("string")
            for step in reversed(own):
                case = F.when(_holds(step.when), step.reason).otherwise(case)
            out = _dropped(out, case)
            continue
        for step in own:
            if kind is Fix:
                hit = live & _holds(step.when)
                new = {c: F.when(hit, F.expr(v)).otherwise(F.col(c)) for c, v in step.values}
                out = out.withColumns(new | {NOTES: F.when(hit, F.array_append(NOTES, F.lit(step.note))).otherwise(F.col(NOTES))})
            elif kind is First:
                names = [f"_k{i}" for i in range(len(step.key))]
                first = out.where(live).groupBy(*(F.col(k).alias(n) for k, n in zip(step.key, names, strict=True))).agg(F.min(order).alias("_first"))
                same = [F.col(k) == F.col(n) for k, n in zip(step.key, names, strict=True)]
                out = _dropped(out.join(first, same, "left"), F.when(F.col(order) > F.col("_first"), step.reason)).drop("_first", *names)
            else:
                out = _limited(out, step, order)
    return out


def completed(rows: DataFrame, expected: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Each expected key (distinct) once: its live row of ruled rows (one at most), or the defaults (SQL) with gate_notes of their own."""
    live = rows.where(F.col(REASON).isNull()).drop(REASON)
    both = expected.select(F.col(key).alias("_key")).join(live.withColumn("_there", F.lit(True)), F.col("_key") == F.col(key), "left")
    there = F.col("_there").isNotNull()
    return both.select(F.col("_key").alias(key), *(F.when(there, F.col(c)).otherwise(F.expr(defaults.get(c, "NULL"))).alias(c) for c in live.columns if c != key))


def reasons(steps: Sequence[Step]) -> list[str]:
    """Every reason that the steps can give, in their order."""
    out = []
    for s in steps:
        out += [] if isinstance(s, Fix) else [s.each_reason, s.total_reason] if isinstance(s, Quota) else [s.reason]
    return list(dict.fromkeys(out))


def counters(steps: Sequence[Step]) -> list[Column]:
    """Aggregates over ruled rows: rows by reason, live rows, and live rows with a note."""
    live = F.col(REASON).isNull()
    return [*(F.count_if(F.col(REASON) == r).alias(r) for r in reasons(steps)), F.count_if(live).alias("kept"), F.count_if(live & (F.size(NOTES) > 0)).alias("noted")]


def observed(rows: DataFrame, steps: Sequence[Step], name: str = "gate") -> tuple[DataFrame, Observation]:
    """The rows, and their counters from the same pass: filled when the rows have been written or collected."""
    seen = Observation(name)
    return rows.observe(seen, *counters(steps)), seen


# Fixed values of the three gates.
STAGES = ("emerging", "accelerating", "plateau", "declining", "insufficient")
CALLS = ("organic", "mixed", "syndicated")
GROWING = ("accelerating", "emerging")
LEAST_CONFIDENCE = 0.7
CERTAINTY = ("unverified", "snippet_inference", "verified")
EVIDENCE_IDS, HEADLINE, BODY, WHY = (1, 4), 40, 120, 60
HIGHLIGHTS_BY_DAYS, HIGHLIGHTS = {1: 3, 7: 5}, 3
REGIONS = {
    "SEARCH_QUERIES": ("add_query", "drop_query", "rephrase_query"),
    "PRIORITY": ("add_query", "drop_query", "rephrase_query"),
    "PRIORITY_KEYWORDS": ("add_keyword", "drop_keyword"),
    "TIER_B_DOMAINS": ("add_domain",),
}
RISKS = {"add_query": "low", "add_keyword": "low", "add_domain": "low", "drop_query": "medium", "drop_keyword": "medium", "rephrase_query": "medium"}
METRICS = ("verified_rate", "priority_hit_rate", "needs_review", "validation_pass_rate", "human_rating_score")
LEAST_DATES, LEAST_ROWS, LEAST_RATINGS = 3, 3, 5


def _in(column: str, values: Sequence[str]) -> str:
    return f"coalesce({column}, '') IN ({', '.join(map(repr, values))})"


def _blank(source: str) -> dict[str, str]:
    """An assessment that says nothing."""
    zero = {c: "0.0D" for c in ("confidence", "signal_strength", "source_breadth", "durability")}
    return zero | {"stage": "'insufficient'", "syndication_call": "'organic'", "headline": "''", "rationale": f"array('{source}')", "rubric_hits": "CAST(array() AS array<string>)", "security_flag": "false", "source": f"'{source}'"}


#: Assessments of trends: unknown and repeated ones go, broken ones are blanked, growth that isn't backed is lowered, never raised.
TREND: tuple[Step, ...] = (
    Drop("unknown_cluster_id", "NOT known"),
    First("duplicate", ("cluster_id",)),
    Fix("contract_violation", f"NOT ({_in('stage', STAGES)} AND {_in('syndication_call', CALLS)})", tuple(_blank("contract_violation").items())),
    Fix("security_flag", "security_flag AND stage <> 'insufficient'", (("stage", "'insufficient'"),)),
    Fix("syndicated", f"syndication_call = 'syndicated' AND {_in('stage', GROWING)}", (("stage", "'plateau'"),)),
    Fix("low_confidence", f"confidence < {LEAST_CONFIDENCE} AND {_in('stage', GROWING)}", (("stage", "'plateau'"),)),
)


def text_list(c: Column, most: int, each: int) -> Column:
    """Of the first `most` texts of an array those that aren't blank, cut to `each` characters."""
    return F.filter(F.transform(F.slice(F.coalesce(c, F.expr("CAST(array() AS array<string>)")), 1, most), lambda x: F.coalesce(capped(x, each), F.lit(""))), lambda x: x != "")


def trend_ruled(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """answers (seq, cluster_id, stage, syndication_call, confidence, signal_strength, source_breadth, durability, headline, rationale, rubric_hits, security_flag) through TREND."""
    ids = clusters.select("cluster_id").distinct().withColumn("known", F.lit(True))
    own = answers.join(ids, "cluster_id", "left").withColumn("known", F.col("known").isNotNull())
    shaped = {c: clamp01(F.col(c).cast("double")) for c in ("confidence", "signal_strength", "source_breadth", "durability")}
    shaped |= {"headline": F.coalesce(capped(F.col("headline"), 24), F.lit("")), "rationale": text_list(F.col("rationale"), 4, 300), "rubric_hits": text_list(F.col("rubric_hits"), 8, 16), "security_flag": F.coalesce("security_flag", F.lit(False)), "source": F.lit("model")}
    return ruled(own.withColumns(shaped), TREND, "seq").drop("known")


def trend_gate(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """One assessment for each cluster, with source (model, contract_violation or unassessed) and gate_notes."""
    blank = _blank("unassessed") | {NOTES: "array('unassessed')"}
    return completed(trend_ruled(answers, clusters), clusters.select("cluster_id").distinct(), "cluster_id", blank)


def ceiling(ids: Column, verified: Column) -> Column:
    """What may be claimed at most from so many pieces of evidence, of which so many are verified."""
    return F.when((ids > 0) & (verified == ids), "verified").when(verified > 0, "snippet_inference").otherwise("unverified")


def brief_steps(days: int | None, by: str = "") -> tuple[Step, ...]:
    """Highlights of a brief over so many days; those with a wider claim than their evidence go, they aren't rewritten."""
    rank = lambda c: f"array_position(array({', '.join(map(repr, CERTAINTY))}), {c})"
    cut = lambda c, n: Fix(f"{c}_cut", f"length({c}) > {n}", ((c, f"substring({c}, 1, {n})"),))
    return (
        Drop("security_flag", "security_flag"),
        Drop("contract_violation", f"NOT {_in('confidence', CERTAINTY)}"),
        Drop("unknown_evidence", f"size(evidence_ids) NOT BETWEEN {EVIDENCE_IDS[0]} AND {EVIDENCE_IDS[1]} OR n_known < size(evidence_ids)"),
        Drop("unknown_cluster", "cluster_id IS NOT NULL AND NOT cluster_known"),
        Drop("overclaimed", f"{rank('confidence')} > {rank('confidence_ceiling')}"),
        Drop("empty_text", "coalesce(headline, '') = '' OR coalesce(body, '') = ''"),
        cut("headline", HEADLINE), cut("body", BODY), cut("why", WHY),
        First("duplicate", (by, "highlight_id") if by else ("highlight_id",)),
        Most("over_cap", HIGHLIGHTS_BY_DAYS.get(days, HIGHLIGHTS), by),
    )


def brief_gate(highlights: DataFrame, candidates: DataFrame, clusters: DataFrame, days: int | None = None, by: str = "") -> DataFrame:
    """highlights (seq, highlight_id, headline, body, why, confidence, evidence_ids, cluster_id, security_flag; `by`, if they are of several briefs) through brief_steps.

    candidates: item_id and verified; clusters: cluster_id. A blank cluster_id is none. Highlights without an id are numbered h1, h2, ... within
    their brief, past the ids that others there have; numbers are given before rows are dropped, so they may have gaps.
    """
    texts = {c: capped(F.col(c), 4 * n) for c, n in (("headline", HEADLINE), ("body", BODY), ("why", WHY))}
    ids = F.array_distinct(text_list(F.col("evidence_ids"), 1 << 30, 40))
    own = highlights.withColumns(texts | {"evidence_ids": ids, "security_flag": F.coalesce("security_flag", F.lit(False)), "cluster_id": F.nullif(capped(F.col("cluster_id"), 120), F.lit("")), "highlight_id": F.nullif(capped(F.col("highlight_id"), 40), F.lit(""))})
    known = candidates.where("item_id is not null").groupBy(F.col("item_id").alias("_item")).agg(F.bool_or("verified").alias("_v"))
    facts = own.select("seq", F.explode("evidence_ids").alias("_item")).join(known, "_item").groupBy("seq").agg(F.count("*").alias("n_known"), F.count_if("_v").alias("n_verified"))
    real = clusters.select("cluster_id").where("cluster_id is not null").distinct().withColumn("cluster_known", F.lit(True))
    own = _numbered(own, by).join(facts, "seq", "left").join(real, "cluster_id", "left").fillna(0, ["n_known", "n_verified"]).withColumn("cluster_known", F.col("cluster_known").isNotNull())
    own = own.withColumn("confidence_ceiling", ceiling(F.size("evidence_ids"), F.col("n_verified")))
    # The rules read their rows several times over, so what is joined here is written once.
    own = Steps(own.sparkSession).result(own)
    return ruled(own, brief_steps(days, by), "seq").drop("n_known", "n_verified", "cluster_known")


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with an id for those that have none: the k-th of them gets the k-th number that no other id uses."""
    group = [by] if by else []
    none = rows.where("highlight_id is null").select("seq", *group).withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy("seq")))
    used = F.try_to_number(F.regexp_extract("highlight_id", "^h([1-9][0-9]{0,8})$", 1), F.lit("999999999")).cast("long")
    taken = rows.select(*group, used.alias("_u")).where("_u is not null").distinct()
    # The k-th free number is k and as many more as there are used ones that, less their own place in order, are below k.
    place = taken.select(*group, F.lit(None).cast("long").alias("seq"), (F.col("_u") - F.row_number().over(W.partitionBy(*group).orderBy("_u"))).alias("_v"), F.lit(1).alias("_used"))
    both = none.select(*group, "seq", F.col("_k").cast("long").alias("_v"), F.lit(0).alias("_used")).unionByName(place)
    past = F.sum("_used").over(W.partitionBy(*group).orderBy("_v", "_used").rowsBetween(W.unboundedPreceding, W.currentRow))
    given = both.withColumn("_past", past).where("_used = 0").select("seq", F.concat(F.lit("h"), F.col("_v") + F.col("_past")).alias("_id"))
    return rows.join(given, "seq", "left").withColumn("highlight_id", F.coalesce("highlight_id", "_id")).drop("_id")


def search_steps(each: int = 1, total: int = 3) -> tuple[Step, ...]:
    """Proposals to change what is searched for: shape first, then flags, then enough data, then a cause of their own, then quotas."""
    pairs = " OR ".join(f"(region = '{r}' AND {_in('change_type', t)})" for r, t in REGIONS.items())
    risk = "CASE change_type " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in RISKS.items()) + " END"
    by_prompt = "region IN ('SEARCH_QUERIES', 'PRIORITY')"
    return (
        Drop("unknown_category", "NOT known"),
        Drop("status", "coalesce(status, '') <> 'pending_review'"),
        Drop("security_flag", "coalesce(security_flag, true)"),
        Drop("region", f"NOT {_in('region', tuple(REGIONS))}"),
        Drop("change_type", f"NOT ({pairs})"),
        Drop("target_missing", "coalesce(size(target_files), 0) < 1"),
        Drop("prompt_missing", f"{by_prompt} AND NOT coalesce(prompt_present, false)"),
        Drop("region_empty", f"{by_prompt} AND change_type <> 'add_query' AND coalesce(CASE region WHEN 'PRIORITY' THEN priority_lines ELSE search_lines END, 0) = 0"),
        Drop("target", "NOT (size(target_files) = 1 AND target_files[0] = expected_target)"),
        Drop("risk", f"coalesce(risk, '') <> {risk}"),
        Drop("effect", f"NOT ({_in('metric', METRICS)} AND {_in('direction', ('up', 'down'))})"),
        Drop("rubric_format", "coalesce(size(rubric_hits), 0) < 1 OR NOT forall(rubric_hits, x -> x RLIKE '^SR-[0-8]$')"),
        Drop("rubric", "NOT arrays_overlap(rubric_hits, array('SR-4', 'SR-5'))"),
        Drop("evidence", "size(evidence) < 1"),
        Drop("summary", "coalesce(summary, '') = ''"),
        Drop("category_flagged", "flagged"),
        Drop("hosts_flagged", "hosts_flagged AND region = 'TIER_B_DOMAINS'"),
        Drop("no_change", "unchanged"),
        Drop("few_dates", f"coalesce(n_dates, 0) < {LEAST_DATES}"),
        Drop("few_rows", f"coalesce(metric_rows, 0) < {LEAST_ROWS}"),
        Drop("few_ratings", f"metric = 'human_rating_score' AND coalesce(ratings, 0) < {LEAST_RATINGS}"),
        Drop("not_isolated", "NOT coalesce(isolated, false)"),
        Quota("category", each, total, "category_quota", "total_quota"),
    )


def search_gate(proposals: DataFrame, facts: DataFrame, flags: DataFrame, unchanged: DataFrame, n_dates: int, pending: int = 0, each: int = 1, weekly: int = 3) -> DataFrame:
    """proposals through search_steps, the kept ones with a proposal_id of their own (SP-001, ...) in their order.

    proposals: seq, category, status, security_flag, region, change_type, target_files, risk, metric, direction, rubric_hits, evidence, summary.
    facts: a row for each known category with prompt_present, prompt_file, search_lines, priority_lines, metric_rows, ratings and isolated.
    flags: categories with a security flag, `*` for all hosts; unchanged: categories that are said to stay as they are. Both: category.
    """
    marks = {"flagged": flags.where("category <> '*'"), "unchanged": unchanged}
    own = proposals.join(facts.withColumn("known", F.lit(True)), "category", "left").withColumn("known", F.col("known").isNotNull())
    for name, table in marks.items():
        own = own.join(table.select("category").distinct().withColumn(name, F.lit(True)), "category", "left").withColumn(name, F.col(name).isNotNull())
    own = own.crossJoin(F.broadcast(flags.agg(F.coalesce(F.bool_or(F.col("category") == "*"), F.lit(False)).alias("hosts_flagged")))).withColumn("n_dates", F.lit(n_dates))
    target = F.when(F.col("region") == "PRIORITY_KEYWORDS", "assets/js/config.js").when(F.col("region") == "TIER_B_DOMAINS", "scripts/tier-b-domains.json").otherwise(F.coalesce("prompt_file", F.concat(F.lit("scripts/prompts/"), "category", F.lit(".md"))))
    evidence = F.slice(F.filter(text_list(F.col("evidence"), 1 << 30, 200), lambda x: x.rlike("[0-9]")), 1, 4)
    own = own.withColumns({"expected_target": target, "evidence": evidence, "summary": capped(F.col("summary"), 40)})
    steps = search_steps(each, max(0, weekly - pending))
    extra = [c for c in ("known", "flagged", "unchanged", "hosts_flagged", "n_dates", *facts.columns) if c != "category"]
    out = ruled(own, steps, "seq").drop("expected_target", *extra)
    # At most `weekly` rows are kept, so their numbers come from one small task.
    ids = out.where(F.col(REASON).isNull()).select("seq", F.format_string("SP-%03d", F.row_number().over(W.orderBy("seq"))).alias("proposal_id"))
    return out.drop("proposal_id").join(F.broadcast(ids), "seq", "left")


#: Phrases that tell a program to judge otherwise; names of a project's own settings come as `more`.
ORDERS = r"系統指示|系統訊息|system (prompt|instruction|message)|ignore (the )?(previous|above|prior)|忽略(上述|之前|以上)|已由.{0,8}(核准|批准|授權)|請直接 ?accept|直接接受|一律 ?accept|target_files|\.github/|allowedTools|permission-mode"


def ordered_about(texts: dict[str, Column], lists: dict[str, Column], more: tuple[str, ...] = ()) -> Column:
    """The first field that holds such a phrase: the texts in their order, then the lists, as name[i]; null if none does."""
    pattern = f"(?i)({'|'.join([ORDERS, *more])})"
    found = [F.when(F.coalesce(c.rlike(pattern), F.lit(False)), name) for name, c in texts.items()]
    for name, c in lists.items():
        at = F.array_position(F.transform(c, lambda x: F.coalesce(x.rlike(pattern), F.lit(False))), F.lit(True))
        found.append(F.when(at > 0, F.concat(F.lit(f"{name}["), at - 1, F.lit("]"))))
    return F.coalesce(*found)
