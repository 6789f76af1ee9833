"""Greedy removal of near duplicates, equal to the loop over items in order, by rounds of joins.

The loop keeps an item unless an item kept before has its address or a title of a matching-character ratio above RATIO. So an item is
dropped once an earlier kept neighbour is known, and kept once all its earlier neighbours are dropped; every round decides at least
the first undecided one, and mostly nearly all. Items with one address or one title are groups, never pairs: a round needs only the least kept and
the least undecided number of each. Pairs exist between different titles alone.

Titles of one language share most of their letters and pairs of letters, so no index of grams keeps unlike ones apart; all pairs of different titles are looked at, which is
quadratic, but in blocks of about BLOCK titles: a task holds two blocks, a title is shuffled once for each block, and no pair leaves its task before the ratio itself, difflib's, has
been taken. Of lengths a and b more than 0.4 (a + b) characters match, in order, so as many characters are common at least (counted by a matrix product) and so long is
the longest common subsequence (64 characters of one title in a machine word, many pairs at once). Both are upper bounds, so nothing is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import Steps

RATIO = 0.8
#: Titles of a block; pairs looked at together; longer titles than LONG go to the ratio without a bound on their order.
BLOCK, TOGETHER, LONG = 3000, 1 << 18, 1024
_WORD, _NONE, _MOST = 64, 255, 64

def _shape(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, characters as numbers (equal ones have equal numbers, others may) up to LONG, and how often each number occurs."""
    each = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 251 for t in texts]
    codes = np.full((len(each), min(LONG, max(map(len, each), default=0))), _NONE, np.uint8)
    for row, x in zip(codes, each, strict=True):
        row[: len(x)] = x[:LONG]
    return np.array([len(x) for x in each]), codes, np.array([np.bincount(x, minlength=251) for x in each]).reshape(-1, 251)


def _common(many: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are the numbers of characters in common, up to the _MOST-th of each."""
    both = [(c, k) for c in range(251) for k in range(1, min(_MOST, many[:, c].max(initial=0), other[:, c].max(initial=0)) + 1)]
    c, k = (np.array([x[n] for x in both], int) for n in (0, 1))
    return (many[:, c] >= k).astype(np.float32), (other[:, c] >= k).astype(np.float32)


def _in_order(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows of codes no less than their longest common subsequence: the sum over the first one's words of 64 characters."""
    out = np.zeros(len(i), int)
    for at in range(0, a.shape[1], _WORD):
        part = a[:, at : at + _WORD]
        masks = np.zeros((len(a), 256), np.uint64)
        for p in range(part.shape[1]):
            masks[np.arange(len(a)), part[:, p]] |= np.uint64(1 << p)
        masks[:, _NONE] = 0
        v = np.full(len(i), ~np.uint64(0))
        for p in range(b.shape[1]):
            u = v & masks[i, b[j, p]]
            v = (v + u) | (v - u)
        out += np.bitwise_count(~v)
    return out


def _pairs(own: pd.DataFrame) -> pd.DataFrame:
    """x and y of two blocks, where x, coming after y, counts as equal to it; the ratio is not symmetric."""
    a, b = (own.loc[own["block"] == own[k], "low"].tolist() for k in ("bi", "bj"))
    same, found = own["bi"].iloc[0] == own["bj"].iloc[0], []
    (na, ca, ha), (nb, cb, hb) = _shape(a), _shape(b)
    fa, fb = _common(ha, hb)
    over, past = (np.maximum(h - _MOST, 0).sum(axis=1) for h in (ha, hb))
    step = max(1, TOGETHER // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = slice(at, at + step)
        need = 2 * (na[rows, None] + nb) // 5 + 1
        likely = fa[rows] @ fb.T + np.minimum(over[rows, None], past) >= need
        if same:
            likely &= np.arange(at, at + likely.shape[0])[:, None] < np.arange(len(b))
        i, j = np.nonzero(likely)
        least, long = need[i, j], (na[rows][i] > LONG) | (nb[j] > LONG)
        near = long | (_in_order(ca[rows], cb, i, j) >= least)
        for k, m in zip(i[near], j[near], strict=True):
            for x, y in ((a[at + k], b[m]), (b[m], a[at + k])):
                s = SequenceMatcher(None, x, y)
                if s.quick_ratio() > RATIO and s.ratio() > RATIO:
                    found.append((x, y))
    return pd.DataFrame(found, columns=["x", "y"], dtype=object)


def alike(titles: DataFrame, steps: Steps) -> DataFrame:
    """x and y: pairs of different titles (distinct, column low), where x after y is a duplicate of it."""
    titles = steps.keep(titles)
    blocks = max(1, -(-titles.count() // BLOCK))
    own = titles.withColumn("block", F.pmod(F.xxhash64("low"), F.lit(blocks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = own.select("low", "block", F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"))
    # As many tasks as pairs of blocks, whatever their bytes.
    dealt = own.repartition(min(10_000, blocks * (blocks + 1) // 2), "bi", "bj")
    return steps.keep(dealt.groupBy("bi", "bj").applyInPandas(_pairs, "x string, y string"))


def deduplicated(items: DataFrame, order: str, url: str, title: str, similar: bool = True) -> DataFrame:
    """items with `kept`, as the loop in the order (distinct numbers) decides. A null address or title counts as the empty one; empty ones are equal.

    similar: titles that are alike count; else equal ones only, as they are written.
    """
    with Steps(items.sparkSession) as steps:
        name = F.coalesce(F.col(title), F.lit(""))
        rows = steps.keep(items.select(F.col(order).alias("seq"), F.coalesce(F.col(url), F.lit("")).alias("url"), (F.lower(name) if similar else name).alias("low")))
        pairs = alike(rows.select("low").distinct(), steps) if similar else items.sparkSession.createDataFrame([], "x string, y string")
        state, c = rows.withColumn("state", F.lit(0)), F.col  # 0 undecided, 1 kept, 2 dropped
        while True:
            least = lambda name, *by: state.groupBy(*by).agg(F.min(F.when(c("state") == 1, c("seq"))).alias(f"k{name}"), F.min(F.when(c("state") == 0, c("seq"))).alias(f"u{name}"))  # noqa: E731, B023
            by_title, by_url = least("t", "low"), least("a", "url")
            near = pairs.join(by_title, c("y") == c("low")).groupBy("x").agg(F.min("kt").alias("kn"), F.min("ut").alias("un"))
            both = state.join(by_title, "low").join(by_url, "url").join(near, c("low") == c("x"), "left")
            kept, open_ = F.least("kt", "ka", "kn"), F.least("ut", "ua", "un")
            new = F.when(c("state") != 0, c("state")).when(kept < c("seq"), 2).when(open_ < c("seq"), 0).otherwise(1)
            state = steps.keep(both.select("seq", "url", "low", new.alias("state")))
            if state.where("state = 0").isEmpty():
                break
        done = steps.result(state.select(c("seq").alias("_seq"), (c("state") == 1).alias("kept")))
    return items.join(done, c(order) == c("_seq")).drop("_seq")
