"""Freshness of a system from its artifacts: an ordered ladder of rules, compiled to one CASE, and the gate that holds a stored status against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lag_hours

# Hours after which ingestion is stale, and by which public may be behind preview.
STALE_HOURS, LAG_HOURS = 26, 24
#: State, reason and condition, in order; the first that holds decides, fresh if none does.
LADDER: tuple[tuple[str, str | None, str], ...] = (
    ("blocked", "manifest_duplicate_path", "duplicate"),
    ("blocked", "ingestion_artifact_invalid", "ingestion = 'invalid'"),
    ("blocked", "preview_artifact_invalid", "preview = 'invalid'"),
    ("blocked", "public_artifact_invalid", "public = 'invalid'"),
    ("blocked", "ingestion_artifact_missing", "coalesce(ingestion, 'missing') IN ('missing', 'degraded')"),
    ("blocked", "preview_artifact_missing", "coalesce(preview, 'missing') IN ('missing', 'degraded')"),
    ("blocked", "source_latest_date_missing", "source_date IS NULL"),
    ("blocked", "ingestion_timestamp_missing", "ingestion_at IS NULL"),
    ("blocked", "preview_source_date_missing", "preview_date IS NULL"),
    ("blocked", "preview_timestamp_missing", "preview_at IS NULL"),
    ("blocked", "ingestion_timestamp_in_future", "ingestion_at > as_of"),
    ("blocked", "preview_timestamp_in_future", "preview_at > as_of"),
    ("blocked", "public_timestamp_in_future", "public_at > as_of"),
    ("blocked", "preview_date_ahead_of_source", "preview_date > source_date"),
    ("blocked", "public_date_ahead_of_source", "public_date > source_date"),
    ("stale", "ingestion_stale", f"ingestion_age > {STALE_HOURS}"),
    ("stale", "preview_stale", "preview_date < source_date"),
    ("pending", None, f"coalesce(public, 'missing') IN ('missing', 'degraded') OR public_date IS NULL OR public_at IS NULL OR public_date < source_date OR lag_hours > {LAG_HOURS}"),
)
PUBLISH = {"fresh": "published", "pending": "pending_owner_review"}


def _case(values: list[str | None], other: str | None) -> Column:
    out = F.lit(other)
    for (_, _, when), v in reversed(list(zip(LADDER, values, strict=True))):
        out = F.when(F.coalesce(F.expr(when), F.lit(False)), F.lit(v)).otherwise(out)
    return out


def status(systems: DataFrame) -> DataFrame:
    """systems (duplicate, health of ingestion, preview and public, their dates and instants, as_of) with lag_hours, freshness_state, publish_state and blocked_reason."""
    own = systems.withColumn("lag_hours", lag_hours(F.col("preview_at"), F.col("public_at"))).withColumn("ingestion_age", lag_hours(F.col("as_of"), F.col("ingestion_at")))
    own = own.withColumns({"freshness_state": _case([s for s, _, _ in LADDER], "fresh"), "blocked_reason": _case([r for _, r, _ in LADDER], None)}).drop("ingestion_age")
    publish = F.lit("blocked")
    for state, word in PUBLISH.items():
        publish = F.when(F.col("freshness_state") == state, word).otherwise(publish)
    return own.withColumn("publish_state", publish)


def released(stored: DataFrame, systems: DataFrame, key: str) -> DataFrame:
    """key, release and reasons: may what is stored (freshness_state, publish_state, blocked_reason, as_of) go out, when it is worked out anew?

    Every reason is named: status_missing, status_outdated (another as_of), differs:<column>, and not_fresh; a stored status without a system is unknown_system.
    """
    columns = ("freshness_state", "publish_state", "blocked_reason")
    new, old = status(systems).select(key, "as_of", *columns).alias("n"), stored.alias("o")
    both = new.join(old, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    there, known = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    differs = [F.when(there & known & ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")), f"differs:{c}") for c in columns]
    reasons = F.array_compact(F.array(
        F.when(~known, "unknown_system"), F.when(~there, "status_missing"), F.when(there & known & ~F.col("n.as_of").eqNullSafe(F.col("o.as_of")), "status_outdated"), *differs, F.when(known & (F.col("n.freshness_state") != "fresh"), "not_fresh"),
    ))
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), (F.size(reasons) == 0).alias("release"), reasons.alias("reasons"))
