"""Terms of large lexicons in texts, by one pass of an automaton over each text whatever the number of terms."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.topics import Lexicon

#: Terms that are sent to every task; a lexicon is a parameter of the driver, so a larger one is an error of the caller.
TERMS = 1_000_000


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, t)
    found.make_automaton()
    return found


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _terms_in(text: str, found: ahocorasick.Automaton) -> set[str]:
    """ASCII terms must not touch letters or digits of ASCII; others count anywhere."""
    out = set()
    for end, t in found.iter(text):
        start = end - len(t) + 1
        if t in out or t.isascii() and (start > 0 and _inside(text[start - 1]) or end + 1 < len(text) and _inside(text[end + 1])):
            continue
        out.add(t)
    return out


def matches(text: Column, lexicon: Lexicon) -> Column:
    """array of struct(topic, terms): every topic with a term in the text, with its terms, both in the lexicon's order. Null and empty texts match nothing; blank terms are left out."""
    own = [(topic, list(dict.fromkeys(t.lower() for t in terms if t.strip()))) for topic, terms in lexicon.items()]
    every = sorted({t for _, terms in own for t in terms})
    if len(every) > TERMS:
        raise ValueError(f"{len(every)} terms are more than {TERMS}")
    made: list[ahocorasick.Automaton] = []

    @F.pandas_udf("array<struct<topic:string,terms:array<string>>>")
    def run(s: pd.Series) -> pd.Series:
        if not made:
            made.append(_automaton(every))

        def one(x: str | None) -> list[dict]:
            got = _terms_in(x, made[0]) if x and every else ()
            return [{"topic": topic, "terms": hit} for topic, terms in own if (hit := [t for t in terms if t in got])] if got else []

        return s.map(one)

    return run(F.lower(text))


def best(found: Column, least: int = 2) -> Column:
    """struct(topic, hits) of the topic with most terms, `least` at least, of several the first; null if there is none."""
    none = F.expr("CAST(NULL AS struct<topic:string,hits:int>)")
    return F.aggregate(found, none, lambda a, x: F.when((F.size(x["terms"]) >= least) & (F.size(x["terms"]) > F.coalesce(a["hits"], F.lit(0))), F.struct(x["topic"].alias("topic"), F.size(x["terms"]).alias("hits"))).otherwise(a))


def matched(items: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """items with a row, topic and terms, for each topic that they match."""
    return items.withColumn("_m", F.explode(matches(F.col(text), lexicon))).select(*items.columns, "_m.topic", "_m.terms")
