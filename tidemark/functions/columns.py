"""Column to Column functions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 4) -> Column:
    """floor(x * 10^places + 0.5) / 10^places: halves go up, also below zero; null stays null."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5).cast("double") / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def decay(age_days: Column, half_life: float = 30.0) -> Column:
    """The weight 0.5^(age / half life)."""
    return F.pow(F.lit(0.5), age_days / half_life)


def norm_title(x: Column) -> Column:
    """Lower case, runs of other than letters and digits as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def tokens(x: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct ASCII words of three letters or digits or more that aren't stop words, sorted."""
    words = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]{3,})"), 1)
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, stop))) if stop else words))


# Words that say nothing about a title.
STOP = tuple("the and for with from that this are you your how why what new into its has have not but can will about more than after over out".split())


def title_tokens(x: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct tokens of a title, sorted: ASCII words of three characters or more (with . + - within) that aren't stop words, and pairs of neighbouring CJK characters."""
    low = F.lower(F.coalesce(x, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9.+\-]*[a-z0-9]|[a-z0-9]{3,})"), 1), lambda w: F.length(w) >= 3)
    runs = F.regexp_extract_all(low, F.lit("([\u3400-\u9fff]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.concat(F.array_except(words, F.array(*map(F.lit, stop))), pairs)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeated elements; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_titles(html: Column) -> Column:
    """What a page calls itself: its title without tags, the part before each divider that a capital or CJK character follows, and its first heading; distinct, none blank."""
    bare = F.trim(F.regexp_replace(page_title(html), "<[^>]+>", ""))
    first = F.trim(F.regexp_extract(bare, r"(?s)^(.*?)\s*[|\-\u2013\u2014]\s*(?=[A-Z\u4e00-\u9fff])", 1))
    return F.array_distinct(F.filter(F.array(bare, first, page_heading(html)), lambda t: t != ""))


def page_heading(html: Column) -> Column:
    """The first h1, without tags."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))


def iso_date(x: Column) -> Column:
    """A date of the form yyyy-mm-dd that exists, or null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def half_even(x: Column, places: int = 2) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, places)


def clamp01(x: Column, default: float = 0.0) -> Column:
    """Between 0 and 1; the default for null and NaN."""
    return F.when(x.isNull() | F.isnan(x), default).otherwise(clamp(x, 0.0, 1.0))


def capped(x: Column, most: int) -> Column:
    """Line ends as spaces, trimmed, at most so many characters."""
    return F.substring(F.trim(F.translate(x, "\r\n", "  ")), 1, most)


def lag_hours(later: Column, earlier: Column) -> Column:
    """Hours between two timestamps, not below 0, to 4 places; null if either is."""
    millis = F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))
    return half_up(F.when(millis < 0, 0).otherwise(millis) / 3.6e6, 4)


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def local_day(ts: Column, zone: str = "Asia/Taipei") -> Column:
    """The date at a place of an instant that the session shows in UTC."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words of two titles over those of the longer one; 0.7 at least where one is part of the other; 0 if either is empty."""
    x, y = (F.filter(F.array_distinct(F.split(norm_title(t), " ")), lambda w: w != "") for t in (a, b))
    low, other = norm_title(a), norm_title(b)
    shared = F.size(F.array_intersect(x, y)).cast("double") / F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(low.contains(other) | other.contains(low), F.greatest(F.lit(0.7), shared)).otherwise(shared)
