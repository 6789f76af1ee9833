"""Rule tables over measured trends, as Column functions. Where a rule names a range, its lower end is the anchor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import half_up


def source_breadth(effective: Column) -> Column:
    return F.when(effective >= 40, 0.8).when(effective >= 15, 0.5).when(effective >= 5, 0.2).otherwise(0.0)


def signal_strength(slope: Column, r2: Column, ma7: Column, ma30: Column) -> Column:
    """Without a slope 0."""
    rising = (slope > 0) & (r2 >= 0.5) & (ma7 >= 1.3 * ma30)
    return F.when(slope.isNull(), 0.0).when(rising, 0.8).when(F.abs(slope) < 0.05, 0.3).when(slope > 0, 0.5).otherwise(0.0)


def durability(ma30: Column, ma90: Column, occurrences: Column) -> Column:
    """Without a long average 0, like fewer than 200 occurrences."""
    ratio = ma30 / F.nullif(ma90, F.lit(0.0))
    lower = F.when((ratio >= 0.9) & (occurrences >= 1000), 0.8).when(ratio >= 0.7, 0.5).when(ratio >= 0.5, 0.3).otherwise(0.0)
    return F.when(ratio.isNull() | (occurrences < 200), 0.0).otherwise(lower)


def syndication_call(density: Column, sources: Column, top_count: Column, occurrences: Column) -> Column:
    """From the densest repeat group, its sources and the largest group's count."""
    return F.when((density >= 2.0) & (sources >= 3) | (top_count >= 0.1 * occurrences), "syndicated").when((density >= 1.2) & (sources > 1), "mixed").otherwise("organic")


def stage(sufficient: Column, ma7: Column, ma30: Column, ma90: Column, slope: Column, signal: Column, breadth: Column, lasting: Column, effective: Column, call: Column) -> Column:
    """The first stage whose conditions hold; syndicated topics rise to plateau at most, and few sources or a short life keep one from accelerating."""
    fast = (ma7 > ma30) & (ma30 > ma90) & (slope > 0) & (signal >= 0.7) & (breadth >= 0.5) & (lasting >= 0.3) & (effective >= 5)
    new = (ma7 >= 1.3 * ma30) & (slope > 0) & ((lasting < 0.5) | ma90.isNull())
    falling = (ma7 < ma30) & (slope < 0)
    rises = call != "syndicated"
    return F.when(~F.coalesce(sufficient, F.lit(False)), "insufficient").when(fast & rises, "accelerating").when(new & rises, "emerging").when(falling, "declining").otherwise("plateau")


def confidence_cap(continuity: Column, r2: Column, ma90: Column) -> Column:
    """The least of the caps that apply, 1 if none does."""
    one = F.lit(1.0)
    return F.least(F.when(continuity < 0.75, 0.85).otherwise(one), F.when(r2 < 0.5, 0.8).otherwise(one), F.when(ma90.isNull(), 0.75).otherwise(one))


def window_status(before_complete: Column, now_complete: Column, recent: Column, previous: Column) -> Column:
    """Of a topic in two windows: new, declining or persistent if both are observed whole, else focus."""
    return F.when(~(before_complete & now_complete), "focus").when(previous == 0, "new").when(recent < previous, "declining").otherwise("persistent")


def topic_score(recent: Column, sources: Column, fresh: Column) -> Column:
    """Recent items, half as much again for each source, 2 for a hit in the last two days."""
    return recent + 1.5 * sources + F.when(fresh, 2.0).otherwise(0.0)


def weighted(parts: list[tuple[Column, float]], places: int = 3) -> Column:
    """The sum of weight times part, each part rounded before."""
    terms = [half_up(c, places) * w for c, w in parts]
    return half_up(sum(terms[1:], terms[0]), places)


def exploration_slots(base: Column, quota: float) -> Column:
    return F.floor(base * quota / (1 - quota) + 0.5).cast("long")


def financial_relevance(base: Column, rate: Column) -> Column:
    return 0.7 * base + 0.3 * F.least(F.lit(1.0), rate / 0.25)
