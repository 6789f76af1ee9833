"""Proposals through their states: merged by id, decided by verdicts, reverted and frozen by what the ledger holds. Run again on its own result, each step changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a verdict may say, and states that a verdict no longer changes.
VERDICTS = {"accept": "evaluated", "reject": "rejected"}
SETTLED, FROZEN = ("canary", "auto_applied", "reverted"), "frozen"


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All keys (distinct in each) with the fields of both, second's before first's unless they are null."""
    a, b = first.alias("a"), second.alias("b")
    names = list(dict.fromkeys([*first.columns, *second.columns]))
    pick = lambda c: F.coalesce(*(F.col(f"{t}.{c}") for t, own in (("b", second), ("a", first)) if c in own.columns)).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*map(pick, names))


def decided(proposals: DataFrame, verdicts: DataFrame, inputs: DataFrame, editable: str, now: str) -> DataFrame:
    """proposals (proposal_id, category, target_files, status, evaluated_at) after the verdicts (seq, proposal_id, verdict), with outcome.

    The last verdict that is one counts. inputs (proposal_id, category, target_files) tell what a proposal is about where the table doesn't. Outcome: null
    without a verdict, not_editable if a target doesn't match the pattern or there is none (then unknown ids stay out), frozen, settled, or merged.
    """
    word = F.element_at(F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv)), F.col("verdict"))
    said = verdicts.where(F.col("verdict").isin(*VERDICTS) & F.col("proposal_id").isNotNull()).groupBy("proposal_id").agg(F.max_by(word, "seq").alias("_new"))
    about = inputs.select("proposal_id", F.col("category").alias("_category"), F.col("target_files").alias("_targets"))
    own = proposals.join(said, "proposal_id", "full_outer").join(about, "proposal_id", "left")
    targets = F.when(F.size("target_files") > 0, F.col("target_files")).otherwise(F.col("_targets"))
    fit = F.coalesce((F.size(targets) > 0) & F.forall(targets, lambda t: F.coalesce(t.rlike(editable), F.lit(False))), F.lit(False))
    status, done = F.coalesce("status", F.lit("")), F.col("evaluated_at").isNotNull()
    outcome = (
        F.when(F.col("_new").isNull(), F.lit(None).cast("string")).when(~fit, "not_editable").when(status == FROZEN, "frozen")
        .when(done & ((status == F.col("_new")) | status.isin(*SETTLED)), "settled").otherwise("merged")
    )
    new = F.col("_outcome") == "merged"
    pick = lambda value, old: F.when(new, value).otherwise(old)
    own = own.withColumn("_outcome", outcome).where(F.col("_outcome").isNull() | (F.col("_outcome") != "not_editable") | F.col("status").isNotNull())
    values = {"category": F.coalesce("category", "_category"), "target_files": pick(targets, F.col("target_files")), "status": pick(F.col("_new"), F.col("status")), "evaluated_at": pick(F.lit(now), F.col("evaluated_at"))}
    return own.withColumns(values).select(*proposals.columns, F.col("_outcome").alias("outcome"))


def reverts(ledger: DataFrame) -> DataFrame:
    """proposal_id, category and reverts before, from the ledger's canary_reverted events (event_type, subject_id, category)."""
    return ledger.where("event_type = 'canary_reverted' AND subject_id IS NOT NULL").groupBy(F.col("subject_id").alias("proposal_id"), "category").agg(F.count("*").alias("reverts"))


def after_canary(proposals: DataFrame, judged: DataFrame, ledger: DataFrame, freeze_after: int | None) -> DataFrame:
    """proposals with the status and revert_count that the canary's judgement gives: judged has proposal_id and verdict (revert, confirm, waiting).

    Only those in the state canary move: to auto_applied when confirmed, to reverted when not, or to frozen with the freeze_after-th revert of the same id
    and category; no positive freeze_after freezes nothing.
    """
    own = proposals.join(judged.select("proposal_id", F.col("verdict").alias("_v")), "proposal_id", "left").join(reverts(ledger), ["proposal_id", "category"], "left")
    here = F.col("status") == "canary"
    back, count = here & (F.col("_v") == "revert"), F.coalesce("reverts", F.lit(0)) + 1
    frozen: Column = count >= freeze_after if freeze_after and freeze_after > 0 else F.lit(False)
    status = F.when(back & frozen, FROZEN).when(back, "reverted").when(here & (F.col("_v") == "confirm"), "auto_applied").otherwise(F.col("status"))
    kept = F.col("revert_count") if "revert_count" in proposals.columns else F.lit(None)
    out = own.withColumns({"_s": status, "_c": F.when(back, count).otherwise(kept).cast("long")})
    names = [c for c in proposals.columns if c not in ("status", "revert_count")]
    return out.select(*names, F.col("_s").alias("status"), F.col("_c").alias("revert_count"))
