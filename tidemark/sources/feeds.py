"""RSS and Atom texts as rows of items, in expressions only; what is no feed has format null and no items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The entities with a name that are decoded.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
HEAD = 4000


def _numeric(x: Column, mark: str, digits: str, base: int, most: int) -> Column:
    """Numbers after `mark` and before a semicolon as characters; those that are none stay as they are."""
    parts = F.split(x, f"(?i){mark}")

    def one(p: Column) -> Column:
        code = F.conv(F.regexp_extract(p, f"^(?i)({digits}{{1,{most}}});", 1), base, 10).cast("long")
        real = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.coalesce(real, F.lit(False)), F.concat(char, F.substring_index(p, ";", -(1 << 30)).substr(F.locate(";", p) + 1, F.length(p)))).otherwise(F.concat(F.lit(mark), p))

    return F.when(F.size(parts) < 2, x).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), "")))


def decoded(x: Column) -> Column:
    """Hexadecimal, then decimal, then named entities, each once."""
    x = _numeric(_numeric(x, "&#x", "[0-9a-f]", 16, 6), "&#", "[0-9]", 10, 7)
    return reduce(lambda y, n: F.regexp_replace(y, f"(?i)&{n};", NAMED[n]), NAMED, x)  # & last, so that nothing is decoded twice


def clean(x: Column) -> Column:
    """Text of an element: CDATA unwrapped, entities decoded, tags out, white space as single spaces."""
    bare = decoded(F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"[\s ]+", " "))


def element(block: Column, *names: str) -> Column:
    """The first element of the first name that there is, clean; empty without any."""
    out = F.lit("")
    for n in reversed(names):
        pattern = rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>"
        out = F.when(block.rlike(pattern), clean(F.regexp_extract(block, pattern, 1))).otherwise(out)
    return out


def link(block: Column) -> Column:
    """The first link element's href that has no rel or is the alternate, else the first href."""
    attrs = F.filter(F.regexp_extract_all(block, F.lit(r"(?i)<link\b([^>]*?)/?>"), 1), lambda a: a.rlike(r"(?i)href\s*=\s*[\"'][^\"']+[\"']"))
    rel = lambda a: F.regexp_extract(a, r"(?i)rel\s*=\s*[\"']([^\"']+)[\"']", 1)
    best = F.coalesce(F.get(F.filter(attrs, lambda a: rel(a).isin("", "alternate")), F.lit(0)), F.get(attrs, F.lit(0)))
    return F.coalesce(F.trim(decoded(F.regexp_extract(best, r"(?i)href\s*=\s*[\"']([^\"']+)[\"']", 1))), F.lit(""))


def instant(x: Column) -> Column:
    """Dates as feeds write them: ISO 8601, or day, month name and year with a zone, after a weekday or not; null if neither."""
    plain = F.regexp_replace(F.regexp_replace(x, r"^\s*[A-Za-z]{3,9},\s*", ""), r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    forms = [F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")]
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(x)), *(F.when(plain.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} "), f) for f in forms))


def formats(feeds: DataFrame, xml: str) -> DataFrame:
    """feeds with format: atom, rss or null, by the first characters."""
    head = F.substring(F.coalesce(xml, F.lit("")), 1, HEAD)
    return feeds.withColumn("format", F.when(head.rlike(r"(?i)<feed[\s>]"), "atom").when(head.rlike(r"(?i)<(rss|rdf:RDF|channel)[\s>]"), "rss"))


def items(feeds: DataFrame, xml: str, *keep: str) -> DataFrame:
    """The columns of keep, format, place, title, link and published_at of each item with a title. Feeds without items and other texts give no rows; `formats` tells them apart."""
    own = formats(feeds, xml).where("format is not null")
    blocks = F.when(F.col("format") == "atom", F.regexp_extract_all(xml, F.lit(r"(?is)<entry(?:\s[^>]*)?>(.*?)</entry>"), 1)).otherwise(F.regexp_extract_all(xml, F.lit(r"(?is)<item(?:\s[^>]*)?>(.*?)</item>"), 1))
    each = own.select(*keep, "format", F.posexplode(blocks).alias("place", "block"))
    atom, b = F.col("format") == "atom", F.col("block")
    named = element(b, "link", "guid")
    place = F.when(atom, link(b)).otherwise(F.when(named != "", named).otherwise(link(b)))
    when = instant(F.when(atom, element(b, "published", "updated")).otherwise(element(b, "pubDate", "dc:date", "published")))
    return each.select(*keep, "format", "place", element(b, "title").alias("title"), place.alias("link"), when.alias("published_at")).where("title <> ''")
