"""Novelty, greedy removal and redraws against the loops that they stand for."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import title_tokens
from tidemark.operators import exploration, fuzzy, likeness


@pytest.mark.parametrize("kind", ["like", "unlike", "hot"])
def test_best_likeness_equals_all_pairs(spark, kind):
    rng = random.Random(kind)
    words = [f"w{i}" for i in range({"like": 60, "unlike": 900, "hot": 300}[kind])]
    draw = lambda n: sorted(set(rng.choices(words, [1 / (i + 1) for i in range(len(words))] if kind == "hot" else None, k=n)))
    older = [(i, draw(rng.randrange(0, 40))) for i in range(90)] + [(90, None), (91, [])]
    items = [(i, draw(rng.randrange(0, 60))) for i in range(80)] + [(80, None), (81, []), (82, ["nowhere"]), (83, older[3][1])]
    items += [(100 + i, sorted(set(older[i][1][:-2]) | {"new"})) for i in range(40)]
    a, b = (spark.createDataFrame(x, "id long, tokens array<string>") for x in (items, older))
    got = {r.id: r.n for r in likeness.novelty(a, "id", b.withColumnRenamed("id", "old"), "old").collect()}

    def plain(t):
        best = max((len(set(t) & set(u)) / len(set(t) | set(u)) for _, u in older if u), default=0)
        return 1 - best

    assert set(got) == {i for i, _ in items}
    for i, t in items:
        assert got[i] == (0.0 if not t else pytest.approx(plain(t), abs=1e-12)), (i, t)


def test_likeness_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "id long, tokens array<string>"), spark.createDataFrame([(1, ["a"]), (2, None)], "id long, tokens array<string>")
    assert likeness.novelty(none, "id", one.withColumnRenamed("id", "old"), "old").count() == 0
    assert sorted((r.id, r.n) for r in likeness.novelty(one, "id", none.withColumnRenamed("id", "old"), "old").collect()) == [(1, 1.0), (2, 0.0)]


def test_ranking_of_candidates(spark):
    rows = [(1, "alpha beta gamma", "2026-07-02"), (2, "gamma beta alpha", "2026-07-09"), (3, "single", "2026-07-09"), (4, "old item here", "2026-06-01"), (5, "fresh words only", None), (6, "fresh words again", "2026-07-03"), (7, "known title text", "2026-07-05"), (8, "other brand things", "2026-07-04")]
    entries = spark.createDataFrame(rows, "seq long, title string, published string").withColumn("tokens", title_tokens(F.col("title")))
    older = spark.createDataFrame([(1, "known title text"), (2, "alpha beta delta epsilon"), (3, "brand things elsewhere")], "old long, title string").withColumn("tokens", title_tokens(F.col("title")))
    got = [(r.seq, r.novelty) for r in likeness.ranked(entries, older, "old", "2026-07-01", 0.5, 3).orderBy("rank").collect()]
    assert got == [(6, 1.0), (5, 1.0), (1, 0.6)]  # equal sets: the first; known: 0; (8) is 0.5 and fourth


@pytest.mark.parametrize("limit", [0, 4, 500])
def test_ranking_in_rounds_equals_all_pairs(spark, limit, monkeypatch):
    """Rounds of seven stop early and lose nothing, with many ties and copies among the older sets."""
    monkeypatch.setattr(likeness, "ROUND", 7)
    compared, exact = [], likeness._exact
    monkeypatch.setattr(likeness, "_exact", lambda chunk, olds: compared.append(chunk.count()) or exact(chunk, olds))
    rng = random.Random(limit)
    words = [f"w{i}" for i in range(50)]
    draw = lambda low, high: sorted(set(rng.choices(words, [1 / (i + 1) for i in range(50)], k=rng.randrange(low, high))))
    entries = [(i, draw(2, 9), rng.choice([None, "2026-07-02", "2026-07-03"])) for i in range(60)] + [(60, ["nowhere", "unseen"], None), (61, ["unseen"], None), (62, None, None)]
    older = [(i, draw(1, 30)) for i in range(70)] + [(70 + i, ["w0", "w1", "w2"]) for i in range(30)] + [(100, []), (101, None)]
    first = {}
    for i, t, day in entries:
        if t and len(t) >= 2:
            first.setdefault(tuple(t), (i, t, day or ""))
    novel = lambda t: math.floor((1 - max(len({*t} & {*u}) / len({*t} | {*u}) for _, u in older if u)) * 1e4 + 0.5) / 1e4
    want = sorted(((i, novel(t), day) for i, t, day in first.values()), key=lambda r: r[0])
    want = sorted((r for r in sorted(want, key=lambda r: r[2], reverse=True) if r[1] >= 0.4), key=lambda r: -r[1])[:limit]
    a, b = spark.createDataFrame(entries, "seq long, tokens array<string>, published string"), spark.createDataFrame(older, "old long, tokens array<string>")
    got = [(r.seq, r.novelty, r.published or "") for r in likeness.ranked(a, b, "old", "2026-07-01", 0.4, limit).orderBy("rank").collect()]
    assert got == want
    assert sum(compared) < len(first) if limit < 500 else len(compared) > 2


def test_tokens_of_titles(spark):
    rows = [("GPT-4.1 beats the C++ model, a b.c!", ["beats", "c++", "gpt-4.1", "model"]), ("金管會AI指引", ["指引", "管會", "金管"]), ("中 a 文", []), (None, []), ("x1y the", ["x1y"])]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", title_tokens(F.col("t")).alias("t")).orderBy("i").collect()]
    want = [w for _, w in rows]
    want[0] = sorted({"beats", "gpt-4.1", "model", "b.c"})  # a word ends in a letter or digit, so c++ is c, too short
    assert got == want


def loop(rows, similar):
    seen, titles, kept = set(), [], {}
    for i, url, title in rows:
        url, title = url or "", title or ""
        same = url in seen or any((SequenceMatcher(None, title.lower(), t.lower()).ratio() > 0.8) if similar else title == t for t in titles)
        kept[i] = not same
        if not same:
            seen.add(url)
            titles.append(title)
    return kept


@pytest.mark.parametrize("similar", [True, False])
def test_greedy_removal_equals_the_loop(spark, similar):
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(0, 60))) for _ in range(25)]
    rows = []
    for i in range(260):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + len(t) // 4)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [t[k].upper()]]) if t else []
            if not t:
                break
        rows.append((i * 3, f"u{rng.randrange(150)}" if rng.random() < 0.9 else rng.choice(["", None]), "".join(t) if rng.random() < 0.97 else None))
    got = {r.seq: r.kept for r in fuzzy.deduplicated(spark.createDataFrame(rows, "seq long, url string, title string"), "seq", "url", "title", similar).collect()}
    assert got == loop(rows, similar) and len(set(got.values())) == 2


def test_greedy_removal_goes_by_what_was_kept(spark):
    """The second goes for the first, so it doesn't take the third away; then the third takes the fourth."""
    rows = [(1, "a", "one title of news today"), (2, "b", "one title of news todayxxxxx"), (3, "c", "one title of news todayxxxxxyyyyyyy"), (4, "c", "unlike"), (5, "d", None), (6, "e", "")]
    got = {r.seq: r.kept for r in fuzzy.deduplicated(spark.createDataFrame(rows, "seq long, url string, title string"), "seq", "url", "title").collect()}
    assert got == loop(rows, True) == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert fuzzy.deduplicated(spark.createDataFrame([], "seq long, url string, title string"), "seq", "url", "title").count() == 0


def plain_redraw(rows, k, cap, hhi_cap):
    def pick(pool):
        out, per = [], {}
        for r in pool:
            if len(out) >= k:
                break
            if per.get(r[1], 0) + 1 <= max(1, math.floor(k * cap)):
                per[r[1]] = per.get(r[1], 0) + 1
                out.append(r)
        return out

    pool = sorted(rows, key=lambda r: (-r[2], r[0]))
    chosen, demoted = pick(pool), []
    for _ in range(len(rows)):
        if not chosen or exploration.hhi_of([r[1] for r in chosen]) <= hhi_cap:
            break
        count = {}
        for r in chosen:
            count[r[1]] = count.get(r[1], 0) + 1
        top, n = min(count.items(), key=lambda x: (-x[1], x[0]))
        if n <= 1:
            break
        last = max(i for i, r in enumerate(pool) if r[1] == top)
        fewer = pool[:last] + pool[last + 1 :]
        again = pick(fewer)
        if len(again) < len(chosen):
            break
        pool, chosen = fewer, again
        demoted.append(top)
    return [r[0] for r in chosen], list(dict.fromkeys(demoted)), math.floor(exploration.hhi_of([r[1] for r in chosen]) * 1000 + 0.5) / 1000


def test_redraw_equals_the_loop(spark):
    rng = random.Random(11)
    rows, args = [], (6, 0.5, 0.2)
    for g in range(25):
        few = rng.randrange(1, 9)
        rows += [(len(rows), f"s{min(rng.randrange(few), rng.randrange(few))}", rng.random(), f"g{g}") for _ in range(rng.randrange(1, 40))]
    got = {}
    df = spark.createDataFrame(rows, "id long, source string, novelty double, lang string")
    for r in exploration.redrawn(df, "lang", "source", [F.desc("novelty"), F.col("id")], *args).orderBy("rank").collect():
        got.setdefault(r.lang, ([], r.demoted_sources, r.hhi))[0].append(r.id)
    some = 0
    for g in {r[3] for r in rows}:
        want = plain_redraw([r for r in rows if r[3] == g], *args)
        assert got[g] == want
        some += bool(want[1])
    assert some > 5 and exploration.redrawn(df.limit(0), "lang", "source", [F.desc("novelty")], *args).count() == 0


def test_places():
    assert [exploration.slots(b, q) for b, q in ((10, 0.2), (6, 0.25), (0, 0.5), (5, 0), (5, 1), (3, 0.5))] == [3, 2, 0, 0, 0, 3]
    assert exploration.hhi_of([]) == 0 and exploration.hhi_of(["a"]) == 1 and exploration.hhi_of(list("abcd")) == 0.25


def test_pairs_of_blocks_are_those_of_the_ratio():
    """No bound loses a pair: short, long and very long titles, other scripts, characters that share a number."""
    rng = random.Random(5)
    bases = ["".join(rng.choice(letters) for _ in range(n)) for n, letters in [(3, "ab"), (8, "abc"), (60, "abcdefgh "), (63, "abcd"), (66, "abcdefghij"), (150, "ab c"), (1100, "abcdef"), (40, "新聞標題中文字\U0001f600"), (50, "aŜ")]]
    titles = {""}
    for t in bases * 9:
        x = list(t)
        for _ in range(rng.randrange(0, 1 + len(x) // 3)):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], [rng.choice("xyzq新")], [x[k], x[k]]])
            if not x:
                break
        titles.add("".join(x))
    titles = sorted(titles)
    want = {(x, y) for x in titles for y in titles if x != y and SequenceMatcher(None, x, y).ratio() > 0.8}
    got = []
    for bi, bj in ((0, 0), (0, 1), (1, 1)):
        own = fuzzy.pd.DataFrame([(t, i % 2, bi, bj) for i, t in enumerate(titles) if i % 2 in (bi, bj)], columns=["low", "block", "bi", "bj"])
        got += fuzzy._pairs(own).itertuples(index=False, name=None)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_novelty_finds_the_tokens_of_a_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(x):
        seen.add(1)
        return x.split() if x else None

    items = spark.createDataFrame([(1, "a b c"), (2, "c d"), (3, None), (4, "x y z"), (5, "")], "id long, text string").select("id", words("text").alias("tokens"))
    older = spark.createDataFrame([(1, "a b c d"), (2, "c d")], "old long, text string").select("old", words("text").alias("tokens"))
    got = {r.id: r.n for r in likeness.novelty(items, "id", older, "old").collect()}
    assert got == {1: 0.25, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}
    assert seen.value == 7
