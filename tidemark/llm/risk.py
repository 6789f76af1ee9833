r"""Quality rules with thresholds whose false rejections are bounded by labelled holdouts, in DataFrame functions only.

Base counts of a text: words `[^\x20\x09-\x0D]+`, their characters, symbols, lines that repeat an earlier one, and words in WIDTH-word
windows that stand in the text twice or more. Windows are compared by 64-bit hashes within one text. Texts of fewer than LEAST words, or
with over REPEATS percent of repeated words, fail outright.

Each of RULES is a share of two counts and rejects above a cutoff of the grid 0, 1 / LEVELS, 2 / LEVELS, ... Cutoffs are chosen by stratum (lang) on
the labelled documents that pass the base rules: from the loosest on, a cutoff is certified while the exact binomial
(Clopper-Pearson) upper bound of the share of good documents that it rejects is ALPHA / rules at most, and no stricter one
is looked at after the first that isn't (fixed-sequence testing). The bounds hold together with a probability of 1 - DELTA, as each
stratum and rule gets its part of DELTA (Bonferroni), so at most ALPHA of a stratum's good documents are rejected. Of the certified
cutoffs the one with the most bad documents less good ones rejected is taken, the loosest of these; without a gain, or with too few labels for
a bound, the rule rejects nothing in that stratum.

Only counts by (stratum, rule, level) are summed, LEVELS a rule at most. Null texts have no words; a null lang is a stratum of its own.
Labels that are null, or whose doc_id is unknown or null, are not used; of several labels of one doc_id the least counts, for each row of that
id. Repeated rows are judged each. Without documents the result is empty, without labels only the base rules reject. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, Scratch, kept

WIDTH, LEAST, REPEATS = 5, 10, 20
LEVELS, ALPHA, DELTA = 50, 0.02, 0.1
#: Rule: the share of the first count in the second.
RULES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines")}
SYMBOLS, SPACE = "#*$%&|<>", "\t\n\x0b\f\r "
#: Rows of cutoffs that are sent to every task; more are joined by shuffle.
SENT = 100_000


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated(hashes: Column, name: str) -> dict[str, Column]:
    """Steps by which the number of words in windows that occur twice comes from the array `name` of window hashes."""
    # Sorted by hash, then place; a window is repeated if a neighbour has its hash. Most texts have none and skip this.
    some = F.size(F.array_distinct(name)) < F.size(name)
    none = F.expr("CAST(array() AS array<struct<h:bigint,i:int>>)")
    at = F.sort_array(F.transform(name, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, i: (F.get("_at", i - 1)["h"] == x["h"]) | (F.get("_at", i + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("_at", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    covered = F.transform("_places", lambda x, i: F.least(F.lit(WIDTH), F.coalesce(F.get("_places", i + 1) - x, F.lit(WIDTH))))
    return {"_at": F.when(some, at).otherwise(none), "_places": places, "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of each document."""
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("x")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    flat = F.col("text")
    for c in SPACE[:-1]:  # with one kind of white space left, the text is cut without a pattern
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    chars = without(F.col("text"), SPACE)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    rows = rows.withColumn("_chars", chars).withColumn("_lines", lines).withColumn("_words", F.transform(F.array_remove(F.split(flat, " "), ""), lambda w: F.xxhash64(w)))
    count = lambda chars: (F.length("_chars") - F.length(without(F.col("_chars"), chars))).cast("long")
    rows = rows.select(
        "doc_id", "stratum", "_words", F.size("_words").cast("long").alias("n_words"), F.length("_chars").cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"), count(UPPER).alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    starts = F.when(F.col("n_words") >= WIDTH, F.sequence(F.lit(0), (F.col("n_words") - WIDTH).cast("int"))).otherwise(F.expr("CAST(array() AS array<int>)"))
    rows = rows.withColumn("_win", F.transform(starts, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WIDTH)))))
    for name, c in repeated(F.col("_win"), "_win").items():
        rows = rows.withColumn(name, c)
    failed = (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words"))
    return rows.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def level(rule: str) -> Column:
    """The strictest cutoff number that doesn't reject is one above this; -1: none rejects."""
    num, den = map(F.col, RULES[rule])
    return F.when(den > 0, F.floor((num * LEVELS + den - 1) / F.greatest(den, F.lit(1))) - 1).otherwise(F.lit(-1)).cast("int")


def tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of X binomial with n and p, for k below the mean n * p, 1 from there on, where it is a half or more anyway."""
    up = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    log = F.aggregate(up, F.lit(0.0), lambda a, i: a + F.log((n - i + 1).cast("double") / i))
    most = F.exp(log + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    # From the term of k down each is i (1 - p) / ((n - i + 1) p) of the one above.
    down = F.aggregate(F.reverse(up), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * i * (1 - p) / ((n - i + 1) * p)).alias("t"), (a["s"] + a["t"] * i * (1 - p) / ((n - i + 1) * p)).alias("s")), lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(most * down)


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and, for each rule that has a certified cutoff with a gain, its number; rows: measured documents, labels: doc_id and quality."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = rows.where(~F.col("base_failed")).join(good, "doc_id").select("stratum", (F.col("quality") == 1).alias("good"), F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES))).alias("x"))
    counts = own.groupBy("stratum", "x.rule", "x.level").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    # Only the levels that occur differ in what they reject: those between have the counts of the next stricter one that does.
    sizes = counts.groupBy("stratum", "rule").agg(F.sum("g").alias("n")).withColumn("strata", F.count("*").over(W.partitionBy()) / len(RULES))
    grid = sizes.select("stratum", "rule", "n", "strata", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    stricter = W.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    dense = grid.join(counts, ["stratum", "rule", "level"], "left").select("stratum", "rule", "n", "strata", "level", *(F.coalesce(F.sum(c).over(stricter), F.lit(0)).alias(c) for c in "gb"))
    sure = tail(F.col("n"), F.col("g"), alpha / len(RULES)) <= F.lit(delta) / (F.col("strata") * len(RULES))
    held = dense.withColumn("held", F.every(sure).over(stricter)).where("held and b > g")
    best = held.groupBy("stratum", "rule").agg(F.max_by("level", F.struct(F.col("b") - F.col("g"), "level")).alias("cut"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and rejected_by: the rules that reject the document."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(measured(docs))
        cuts = scratch.keep(cutoffs(rows, labels, alpha, delta))
        # A row for each stratum.
        small = cuts.count() <= SENT
        both = rows.join(F.broadcast(cuts) if small else cuts, "stratum", "left")
        by = F.array_compact(F.array(F.when(F.col("base_failed"), "base"), *(F.when(level(r) >= F.col(f"cut_{r}"), r) for r in RULES)))
        named = both.withColumn("rejected_by", F.array_join(by, ","))
        return kept(named.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("rejected_by") == "").alias("kept"), "rejected_by"))


def _level_sql(rule: str) -> str:
    num, den = RULES[rule]
    return f"CASE WHEN {den} > 0 THEN ({num} * {LEVELS} + {den} - 1) // greatest({den}, 1) - 1 ELSE -1 END"


_P = ALPHA / len(RULES)
#: The same in DuckDB's SQL.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || lang, 'x') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(x) AS n FROM (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS x FROM rep) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, stratum, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, coalesce(ln.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {LEAST} OR 100 * n_repeat_words > {REPEATS} * n_words AS base_failed FROM m),
lv AS (SELECT r, doc_id, stratum, base_failed, unnest([{", ".join(f"{{'rule': '{x}', 'level': {_level_sql(x)}}}" for x in RULES)}], recursive := true) FROM b),
own AS (SELECT lv.*, q FROM lv JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
k AS (SELECT stratum, rule, c, count(*) FILTER (q = 1 AND level >= c) AS g, count(*) FILTER (q <> 1 AND level >= c) AS bad, count(*) FILTER (q = 1) AS n, (SELECT count(DISTINCT stratum) FROM own) AS strata
  FROM own, range({LEVELS}) x(c) GROUP BY stratum, rule, c),
sure AS (SELECT *, CASE WHEN g >= n * {_P}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, g + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P}::DOUBLE) + (n - i) * ln(1 - {_P}::DOUBLE)))) END <= {DELTA}::DOUBLE / (strata * {len(RULES)}) AS ok FROM k),
held AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY c DESC) AS held FROM sure),
cut AS (SELECT stratum, rule, arg_max(c, (bad - g) * 1000 + c) AS cut FROM held WHERE held AND bad > g GROUP BY stratum, rule),
no AS (SELECT r, string_agg(rule, ',' ORDER BY list_position([{", ".join(f"'{x}'" for x in RULES)}], rule)) AS why FROM lv JOIN cut USING (stratum, rule) WHERE level >= cut GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND why IS NULL AS kept,
  concat_ws(',', CASE WHEN base_failed THEN 'base' END, why) AS rejected_by FROM b LEFT JOIN no USING (r)
"""
