"""From members with technology assessments to a topic's, and from that and its trend to trajectory, horizon and confidence. Rules are Column functions over fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import half_up

# Ordered scales, what a stage allows, and where a maturity puts the horizon.
MATURITIES, DELTAS, GRADES = ("M1", "M2", "M3", "M4", "M5"), ("D0", "D1", "D2", "D3"), ("E1", "E2", "E3", "E4")
TRAJECTORIES = ("layer_shift", "capability_deepening", "commoditizing", "consolidating", "stalling", "unforecastable")
ALLOWED = {
    "insufficient": ("unforecastable",),
    "emerging": TRAJECTORIES,
    "accelerating": TRAJECTORIES,
    "plateau": ("capability_deepening", "commoditizing", "consolidating", "stalling", "unforecastable"),
    "declining": ("stalling", "consolidating", "commoditizing", "unforecastable"),
}
HORIZONS = {"M1": "far", "M2": "mid", "M3": "near", "M4": "near", "M5": "mid"}
SECONDARY, SUPPORT = 3, 2


def _at_least(c: Column, low: str, scale: tuple[str, ...]) -> Column:
    return c.isin(*scale[scale.index(low) :])


def assessed(members: DataFrame, topic: str, support: int = SUPPORT) -> DataFrame:
    """A row for each topic with an assessed member: tech_layer, secondary_layers, maturity, delta, evidence_grade, blockers and cap_notes.

    members: cluster_id, size, tech_layer, secondary_layers, maturity, delta, evidence_grade, blockers; without a layer they aren't assessed. The
    layer is the one with most items, not most members; maturity and delta are the highest seen, then capped by the evidence: its grade is the first of E1
    to E3 that, with those before it, has min(support, graded members) members, else E4. Values outside a scale don't count. Distinct layers and
    blockers of a topic are few; everything else is a sum or a maximum, taken before the shuffle.
    """
    c = F.col
    live = members.where("tech_layer is not null")
    layers = live.groupBy(topic, "tech_layer").agg(F.sum(F.when(c("size") > 0, c("size")).otherwise(1)).alias("n"))
    primary = layers.groupBy(topic).agg(F.min_by("tech_layer", F.struct(-c("n"), "tech_layer")).alias("primary"))
    extra = F.coalesce("secondary_layers", F.expr("CAST(array() AS array<string>)"))
    every = live.select(topic, F.explode(F.array_append(extra, c("tech_layer"))).alias("layer")).distinct().join(primary, topic).where("layer <> primary")
    second = every.groupBy(topic).agg(F.slice(F.sort_array(F.collect_set("layer")), 1, SECONDARY).alias("secondary_layers"))
    named = live.select(topic, F.explode("blockers").alias("b")).where("b is not null").groupBy(topic, "b").agg(F.count("*").alias("n"))
    blockers = named.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct((-c("n")).alias("n"), "b"))), lambda x: x["b"]).alias("blockers"))
    best = lambda name, scale: F.max(F.when(c(name).isin(*scale), c(name)))
    # The names of a scale sort like their order.
    counts = [F.count_if(c("evidence_grade") == g).alias(f"_{g}") for g in GRADES]
    sums = live.groupBy(topic).agg(best("maturity", MATURITIES).alias("_m"), best("delta", DELTAS).alias("_d"), *counts, F.count("*").alias("members"))
    need = F.least(F.lit(support), c("_E1") + c("_E2") + c("_E3") + c("_E4"))
    grade = F.when((need > 0) & (c("_E1") >= need), "E1").when((need > 0) & (c("_E1") + c("_E2") >= need), "E2").when((need > 0) & (c("_E1") + c("_E2") + c("_E3") >= need), "E3").otherwise("E4")
    own = sums.join(primary, topic).join(second, topic, "left").join(blockers, topic, "left").withColumn("evidence_grade", grade)
    m, d = F.coalesce("_m", F.lit("M1")), F.coalesce("_d", F.lit("D0"))
    low = c("evidence_grade") == "E3"
    cut_m, cut_d = low & _at_least(m, "M3", MATURITIES), low & _at_least(d, "D2", DELTAS)
    capped_d = F.when(cut_d, "D1").otherwise(d)
    no_proof = (capped_d == "D3") & (c("_E1") == 0)
    notes = F.array_compact(F.array(F.when(cut_m, F.concat(F.lit("E3: "), m, F.lit(" to M2"))), F.when(cut_d, F.concat(F.lit("E3: "), d, F.lit(" to D1"))), F.when(no_proof, "no E1: D3 to D2")))
    none = F.expr("CAST(array() AS array<string>)")
    return own.select(
        topic, "members", c("primary").alias("tech_layer"), F.coalesce("secondary_layers", none).alias("secondary_layers"), F.when(cut_m, "M2").otherwise(m).alias("maturity"), F.when(no_proof, "D2").otherwise(capped_d).alias("delta"),
        "evidence_grade", F.coalesce("blockers", none).alias("blockers"), notes.alias("cap_notes"),
    )


def joined(timeline: DataFrame, trends: DataFrame, tech: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Topics of the timeline with their trend and, where there is one, assessment; and one row of counts: unmatched (no trend) and tech_absent."""
    both = timeline.join(trends.withColumn("_trend", F.lit(True)), topic, "left").join(tech.withColumn("_tech", F.lit(True)), topic, "left")
    here = F.col("_trend").isNotNull()
    counts = both.agg(F.count_if(~here).alias("unmatched"), F.count_if(here & F.col("_tech").isNull()).alias("tech_absent"))
    return both.where(here).withColumn("tech_present", F.col("_tech").isNotNull()).drop("_trend", "_tech"), counts


def trajectory(stage: Column, source: Column, layer: Column, secondary: Column, maturity: Column, delta: Column) -> Column:
    """What the layers, maturity and delta point to, where the stage allows it; unforecastable otherwise and without a trend that a model gave. A null layer is an absent assessment."""
    number = lambda x: F.regexp_extract(x, r"^S(\d+)$", 1)
    near = F.exists(F.coalesce(secondary, F.expr("CAST(array() AS array<string>)")), lambda s: (number(s) != "") & (F.abs(F.try_to_number(number(s), F.lit("99")) - F.try_to_number(number(layer), F.lit("99"))) == 1))
    size = F.coalesce(F.size(secondary), F.lit(0))
    has = lambda name: (layer == name) | F.coalesce(F.array_contains(secondary, name), F.lit(False))
    strong, weak = _at_least(delta, "D2", DELTAS), delta.isin("D0", "D1")
    seen = (
        F.when(layer.isNotNull() & near & strong, "layer_shift").when(layer.isNotNull() & (size == 0) & strong, "capability_deepening")
        .when(_at_least(maturity, "M4", MATURITIES) & weak & has("S6"), "commoditizing").when((maturity == "M5") | has("S5"), "consolidating")
        .when(weak & stage.isin("plateau", "declining"), "stalling").otherwise("unforecastable")
    )
    fit = F.lit(False)
    for name, words in ALLOWED.items():
        fit = fit | ((stage == name) & seen.isin(*words))
    known = F.coalesce(source, F.lit("unassessed")).isin("unassessed", "contract_violation")
    return F.when(F.coalesce(fit, F.lit(False)) & ~known, seen).otherwise("unforecastable")


def horizon(maturity: Column) -> Column:
    """near, mid or far; mid without a maturity."""
    out = F.lit("mid")
    for m, h in HORIZONS.items():
        out = F.when(maturity == m, h).otherwise(out)
    return out


def confidence(found: Column, upstream: Column, stage: Column, grade: Column, tech_absent: Column, signals: Column, dated: Column) -> Column:
    """From 1 down by what is missing, at most 0.7 on E3 evidence or none, never above the trend's own and never below 0; 0 if unforecastable. signals: number of watch signals, dated: the falsifier's time is the horizon's end."""
    off = lambda when, by: F.when(F.coalesce(when, F.lit(False)), by).otherwise(0.0)
    left = 1.0 - off(tech_absent, 0.3) - off((stage == "plateau") & found.isin("commoditizing", "consolidating"), 0.1) - off(F.coalesce(signals, F.lit(0)) < 2, 0.1) - off(~F.coalesce(dated, F.lit(False)), 0.2)
    most = F.when(F.coalesce(grade, F.lit("E3")) == "E3", 0.7).otherwise(1.0)
    return F.when(found == "unforecastable", 0.0).otherwise(half_up(F.greatest(F.lit(0.0), F.least(left, most, F.coalesce(upstream, F.lit(0.0))))))
