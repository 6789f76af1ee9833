"""Checks of rows: each rule gives a problem or null, and a row keeps the list of its problems. Nothing is dropped until the caller splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import half_even, iso_date, suffixes, valid_url


def missing(present: dict[str, Column]) -> Column:
    """The names, in their order, of the fields whose condition does not hold; null counts as not holding."""
    found = F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in present.items()))
    return F.array_compact(found)


def filled(x: Column) -> Column:
    """A text that is not blank."""
    return F.coalesce(F.trim(x) != "", F.lit(False))


def filled_list(x: Column, empty: bool = False) -> Column:
    """A list of texts none of which is blank; the list itself may be empty if `empty` is set."""
    return x.isNotNull() & (F.size(x) >= (0 if empty else 1)) & F.forall(x, filled)


def date_problem(x: Column, today: Column, max_days: int = 90, future: bool = False, limit: bool = True) -> Column:
    """Why a text is no date of the allowed range, or null. With `future` later dates pass and older ones up to 730 days."""
    day = iso_date(x)
    problem = F.when(x.isNull() | (x == ""), "empty_or_invalid_type").when(day.isNull(), "invalid_format")
    if not limit:
        return problem
    if future:
        return problem.when(day < F.date_sub(today, 730), "date_too_old")
    return problem.when((day > today) | (day < F.date_sub(today, max_days)), "date_out_of_range")


def issues(rows: DataFrame, rules: list[Column]) -> DataFrame:
    """rows with `issues`: the problems (texts or null) that the rules give, in their order."""
    return rows.withColumn("issues", F.array_compact(F.array(*rules)))


def url_issue(url: Column) -> Column:
    return F.when(url.isNotNull() & ~valid_url(url), "Invalid URL")


def enum_issue(x: Column, allowed: tuple[str, ...], name: str, optional: bool = False) -> Column:
    bad = ~F.coalesce(x.isin(*allowed), F.lit(False))
    return F.when(bad & x.isNotNull() if optional else bad, f"Invalid {name}")


def exactly_among(rows: DataFrame, name: str, domains: DataFrame, out: str) -> DataFrame:
    """rows with `out`: their host (column `name`) is one of the domains (column domain, a small table)."""
    known = domains.select(F.col("domain").alias("_domain")).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, F.col(name) == F.col("_domain"), "left").withColumn(out, F.coalesce("_known", F.lit(False))).drop("_domain", "_known")


def at_or_below(rows: DataFrame, name: str, domains: DataFrame) -> DataFrame:
    """rows whose host (column `name`) is one of the domains (column domain) or below one: the parents of each distinct host meet the domains by equality."""
    hosts = rows.select(F.col(name).alias("_host")).distinct().select("_host", F.explode(suffixes(F.col("_host"))).alias("domain"))
    return rows.join(hosts.join(domains.select("domain").distinct(), "domain").select("_host").distinct(), F.col(name) == F.col("_host"), "left_semi")


def evidence_issue(hosts: Column, allowed: Column) -> Column:
    """Every host of a list is one of the allowed domains (an array) or below one; null lists pass."""
    fine = F.forall(hosts, lambda h: F.exists(allowed, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d))))
    return F.when(~F.coalesce(fine, F.lit(True)), "Invalid or company-mismatched evidence_urls")


def title_status(score: Column) -> Column:
    """verified from 0.3, title_low_match above 0, title_mismatch at 0 or without a score."""
    return F.when(score >= 0.3, "verified").when(score > 0, "title_low_match").otherwise("title_mismatch")


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, verified, needs_review, warnings, removed and pass_rate in per cent of all rows, from status and issues."""
    removed = (F.size("issues") > 0) | (F.col("status") == "title_mismatch")
    verified, review = ~removed & (F.col("status") == "verified"), ~removed & (F.col("status") != "verified")
    counts = rows.agg(F.count("*").alias("total"), F.count_if(verified).alias("verified"), F.count_if(review).alias("needs_review"), F.count_if(removed | review).alias("warnings"), F.count_if(removed).alias("removed"))
    return counts.withColumn("pass_rate", F.when(F.col("total") > 0, half_even(F.col("verified") / F.col("total") * 100)).otherwise(0.0))
