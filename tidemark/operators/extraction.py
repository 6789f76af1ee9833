"""JSON out of free text, and JSON values as canonical text, as rows of leaves, and without what must not leak. Python parses, in Arrow batches, row by row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a text without data says when there was no answer at all.
SENTINELS = ("session limit", "usage limit", "rate limit", "hit your limit", "reached your", "api error", "connection closed", "overloaded", "quota")
SHORT, URL_GONE = 400, "[url-removed]"
#: Texts in quotes, which may hold braces and escapes and need not end, and braces.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)
_FENCE = re.compile(r"(?m)^[ \t]*(?:```|~~~)[a-zA-Z0-9_-]*[ \t]*$")
_ITEMS = re.compile(r'\{[\s\S]*?"items"\s*:\s*\[[\s\S]*?\]\s*\}')
_ARRAY = re.compile(r"\[[\s\S]*\]")


def balanced(text: str) -> Iterator[str]:
    """Every outermost object in braces; braces in quotes don't count."""
    depth = start = 0
    for m in _MARKS.finditer(text):
        if m[0] == "{":
            start = start if depth else m.start()
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : m.end()]


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _listed(text: str) -> list | None:
    got = _parsed(text)
    return got["items"] if isinstance(got, dict) and isinstance(got.get("items"), list) else None


def found_items(raw: str) -> tuple[int, list]:
    """The strategy (1 to 4, 0: none) and the items: the last balanced object with items, the last that a pattern finds, an array, or any object with them."""
    text = _FENCE.sub("", raw)
    objects = list(balanced(text))
    for n, own in ((1, [x for x in objects if '"items"' in x]), (2, [m[0] for m in _ITEMS.finditer(text)])):
        for x in reversed(own):
            if (got := _listed(x)) is not None:
                return n, got
    if (m := _ARRAY.search(text)) and isinstance(got := _parsed(m[0]), list) and got:
        return 3, got
    for x in reversed(objects):
        if (got := _listed(x)) is not None:
            return 4, got
    return 0, []


def first_object(raw: str) -> str | None:
    """The value of a whole text, fences at its ends taken off, or of the first object in braces (counted as they stand); null if that is no JSON."""
    text = raw.strip()
    if text.startswith("```"):
        text = re.sub(r"\n?```$", "", re.sub(r"^```[a-zA-Z]*\n?", "", text)).strip()
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        pass
    depth, start = 0, None
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        else:
            depth -= 1
            if depth == 0 and start is not None:
                own = text[start : m.end()]
                return own if _parsed(own) is not None else None
    return None


def _text(value: object) -> str:
    """Keys sorted, no spaces, whole numbers without a point."""

    def plain(v: object) -> object:
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
            return int(v)
        return [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _without(value: object, leaks: frozenset[str]) -> object:
    if isinstance(value, list):
        return [_without(x, leaks) for x in value]
    if isinstance(value, dict):
        return {k: _without(x, leaks) for k, x in value.items() if k not in leaks}
    return URL_GONE if isinstance(value, str) and re.search("(?i)https?://", value) else value


def _leaves(value: object, path: str = "$", key: str | None = None) -> Iterator[dict]:
    if isinstance(value, dict) and value:
        for k, x in value.items():
            yield from _leaves(x, f"{path}.{k}", k)
    elif isinstance(value, list) and value:
        for i, x in enumerate(value):
            yield from _leaves(x, f"{path}[{i}]", key)
    else:
        yield {"path": path, "key": key, "value": value if isinstance(value, str) else json.dumps(value)}


def json_items(raw: Column) -> Column:
    """struct(strategy, items): the items as JSON texts; null texts have strategy 0 and none."""

    @F.pandas_udf("strategy int, items array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [found_items(x or "") for x in s]
        return pd.DataFrame({"strategy": [n for n, _ in got], "items": [[json.dumps(x, ensure_ascii=False) for x in own] for _, own in got]})

    return run(raw)


def json_object(raw: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: first_object(x or ""))

    return run(raw)


def no_answer(raw: Column) -> Column:
    """The first line, 200 characters at most, of a short text without braces that names a limit or a failure; empty for all others."""
    text = F.trim(F.coalesce(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit("")))
    said = F.exists(F.array(*map(F.lit, SENTINELS)), lambda x: F.contains(F.lower(text), x))
    return F.when((F.length(text) <= SHORT) & ~F.contains(text, F.lit("{")) & said, F.substring(F.regexp_extract(text, r"^([^\r\n]*)", 1), 1, 200)).otherwise("")


def canonical(value: Column) -> Column:
    """The same text for equal JSON values whatever the order of their keys; null for what is no JSON."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else _text(json.loads(x))
            except (ValueError, RecursionError):
                return None

        return s.map(one)

    return run(value)


def content_id(value: Column, length: int = 64) -> Column:
    """The first digits of the SHA-256 of the canonical text and a line end."""
    return F.substring(F.sha2(F.concat(canonical(value), F.lit("\n")), 256), 1, length)


def scrubbed(value: Column, leaks: tuple[str, ...]) -> Column:
    """The canonical text without these keys, at any depth, and with a mark in place of texts that hold an address; null for what is no JSON."""
    gone = frozenset(leaks)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else _text(_without(json.loads(x), gone))
            except (ValueError, RecursionError):
                return None

        return s.map(one)

    return run(value)


def leaves(value: Column) -> Column:
    """An array of struct(path, key, value) for each leaf, empty lists and objects too; empty for what is no JSON. Exploded, keys and values are rows to test."""

    @F.pandas_udf("array<struct<path:string,key:string,value:string>>")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            try:
                return [] if x is None else list(_leaves(json.loads(x)))
            except (ValueError, RecursionError):
                return []

        return s.map(one)

    return run(value)


def disallowed(value: Column, allowed: tuple[str, ...]) -> Column:
    """Paths of leaves under a key that is not allowed, and of texts with an address, sorted."""
    own = F.filter(leaves(value), lambda x: ~F.coalesce(x["key"], F.lit("")).isin("", *allowed) | x["value"].rlike("(?i)https?://"))
    return F.sort_array(F.transform(own, lambda x: x["path"]))
