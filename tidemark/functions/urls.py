"""Addresses as Column functions. None decodes or re-encodes percent signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An http(s) address with a host, without user, white space, controls, angle brackets or quotes.
PLAIN = r"""^(?i:https?)://[^/?#@\s<>"'\\]+([/?#][^\s<>"']*)?$"""


def host(url: Column) -> Column:
    """The lower-case host of an http(s) address, without user, port and www.; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#]*@)?([^/?#:@]+)", 1)), r"^www\.", "")


def valid_url(url: Column) -> Column:
    """http(s) with a host, no user, no white space or control character; false for null."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#@\s]+([/?#].*)?$") & ~url.rlike(r"[\s\x00-\x1f]"), F.lit(False))


def _query(url: Column) -> Column:
    return F.split(F.regexp_extract(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?s)\?(.*)$", 1), "&")


def _joined(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")


def topic_url(url: Column) -> Column:
    """The key of equal pages: scheme and host in lower case, without www., default port, fragment, one last slash and tracking parameters; the others sorted by name. Null for other than plain http(s) addresses."""
    origin = F.lower(F.regexp_extract(url, r"^((?i:https?)://[^/?#]*)", 1))
    origin = F.regexp_replace(F.regexp_replace(origin, r"^(https://.*):443$|^(http://.*):80$", "$1$2"), r"://www\.", "://")
    path = F.regexp_replace(F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1), "/$", "")
    named = F.transform(F.filter(_query(url), lambda p: p != ""), lambda p, i: F.struct(F.regexp_extract(p, "^[^=]*", 0).alias("name"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.array_sort(F.filter(named, lambda x: ~x["name"].rlike("^(?i:utm_.*|fbclid|gclid)$")))
    return F.when(url.rlike(PLAIN), F.concat(origin, F.when(path == "", "/").otherwise(path), _joined(kept["p"])))


def ingest_url(url: Column) -> Column:
    """The key of merged items: scheme and authority in lower case, no fragment, no last slashes, no utm_*, fbclid, gclid, ref and source; parameters in their order. Empty for null and blank."""
    plain = F.trim(F.coalesce(url, F.lit("")))
    origin = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    kept = F.filter(_query(plain), lambda p: (p != "") & ~p.rlike("^(?i:utm_[^=]*|fbclid|gclid|ref|source)(=|$)"))
    kept = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    return F.when(plain == "", "").otherwise(F.concat(origin, F.when(path == "", "/").otherwise(path), _joined(kept)))


def suffixes(name: Column) -> Column:
    """A host and all its parent domains."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
