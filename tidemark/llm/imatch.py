"""I-Match fingerprints with randomised lexicon subsets, in DataFrame functions only.

Terms are words (A-Z folded) of at least MIN_CHARS characters. The lexicon keeps terms that occur in at least
LOW and at most HIGH of all documents that have a term (and in two documents at least): a term's document
frequency is LOW * documents or more, so there are at most (mean distinct terms of a document) / LOW terms,
however large the corpus. It goes to the tasks as one array of short texts, found by a term's hash; a lexicon of more than
LEXICON terms, for which texts would have to be books, is refused. Each term belongs to some of SUBSETS random
parts of the lexicon, by its MD5 sum: a quarter of the parts hold 1 of 4 terms, the next 1 of 16, then 1 of 64
and 1 of 256. A fingerprint has for each part 8 hex digits of the MD5 sum of the document's sorted distinct terms
in it, or a dash where it has none. A document without a lexicon term in any part has "x" and the MD5 sum of all its
sorted distinct terms instead, or of its text if it has no terms. The likeness of two fingerprints is the share of equal places among those
where either has terms; one of all terms is like (1) an equal one only.

The next document is found by windows over ranges of 2 ** 12 ids, in the one shuffle that the texts go through; only the
lowest document of a range looks into another. Null texts count as empty. Documents without doc_id come after all
others; rows of one doc_id have the same next document, and of several texts with one doc_id the greatest is the one
that the others see. An empty table gives an empty result. The session's plan descriptions are cut to 10,000 characters from here on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, kept, lower_ascii

MIN_CHARS, LOW, HIGH, SUBSETS = 3, 0.0005, 0.05, 32
#: Bits of an id that a window may span; LEVELS of them leave 2 ** 16 rows at most for the last one.
_STEP, _LEVELS = 12, 4
LEXICON = 500_000


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    low = lower_ascii(F.coalesce(text, F.lit("")))
    for space in "\t\n\v\f\r":  # with one kind of white space left, the text is cut without a pattern
        low = F.replace(low, F.lit(space), F.lit(" "))
    return F.array_distinct(F.filter(F.split(low, " "), lambda x: F.length(x) >= MIN_CHARS))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term and parts (bit j: belongs to subset j)."""
    with Scratch(docs.sparkSession) as scratch:
        # A document's first term counts it, so one pass gives document frequencies and the number of documents.
        own = docs.select(F.posexplode(terms(F.col("text"))).alias("at", "term"))
        df = scratch.keep(own.groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("at") == 0).alias("first")))
        n = df.agg(F.sum("first").alias("n"))
        band = df.where("df >= 2").join(F.broadcast(n), (F.col("df") >= F.col("n") * low) & (F.col("df") <= F.greatest(F.col("n") * high, F.lit(2.0))))
        # Eight random words of 32 bits; a bit of the first two is set in both for 1 of 4 terms, of four words for 1 of 16, and so on.
        word = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{i // 4}:"), "term").cast("binary")), i % 4 * 8 + 1, 8), 16, 10).cast("long") for i in range(8)]
        parts, met = F.lit(0).cast("long"), F.lit(0xFFFFFFFF)
        for i in range(4):
            met = met.bitwiseAND(word[2 * i]).bitwiseAND(word[2 * i + 1])
            parts = parts.bitwiseOR(met.bitwiseAND(F.lit(0xFF << 8 * i)))
        found = kept(band.select("term", parts.alias("parts")).where("parts != 0"))
    if (size := found.count()) > LEXICON:
        raise ValueError(f"a lexicon of {size} terms is too large to send to the tasks; raise low")
    return found


def slots(words: DataFrame) -> tuple[Column, int]:
    """The lexicon as a constant array of texts, each a run of (tab, term, blank, parts as 8 hex digits), and the array's size; a term is in the text of its hash. Terms hold no white space."""
    n = max(1, words.count() // 2)
    entry = F.concat(F.lit("\t"), "term", F.lit(" "), F.lpad(F.lower(F.conv("parts", 10, 16)), 8, "0"))
    full = words.groupBy(F.pmod(F.xxhash64("term"), F.lit(n)).alias("id")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("own"))
    every = words.sparkSession.range(n).join(full, "id", "left").select("id", F.coalesce("own", F.lit("")).alias("own"))
    row = every.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "own"))), lambda x: x["own"]), "\n").alias("all")).first()
    return F.split(F.lit(row["all"]), "\n"), n


def printed(rows: DataFrame, table: tuple[Column, int], text: str, name: str) -> DataFrame:
    """rows with the column `name`: the fingerprint of their text."""
    lists, n = table
    # What follows the term in the text of its slot: its parts, or, if it is not there, the whole text, which begins with a tab.
    after = lambda t: F.call_function("substring_index", F.element_at(lists, F.pmod(F.xxhash64(t), F.lit(n)).cast("int") + 1), F.concat(F.lit("\t"), t, F.lit(" ")), F.lit(-1))
    found = F.filter(F.transform("_terms", lambda t: F.struct(t.alias("t"), F.substring(after(t), 1, 8).alias("h"))), lambda x: (x["h"] != "") & ~x["h"].startswith("\t"))
    own = F.transform(found, lambda x: F.struct(x["t"].alias("t"), F.conv(x["h"], 16, 10).cast("long").alias("p")))
    rows = rows.withColumn("_terms", terms(F.col(text))).withColumn("_own", F.sort_array(own))
    # Few terms are in the thinner parts, so these look at those only.
    for i in range(4):
        level = F.lit(0xFF << 8 * i)
        rows = rows.withColumn(f"_own{i}", F.filter("_own", lambda e: e["p"].bitwiseAND(level) != 0))  # noqa: B023

    def part(j: int) -> Column:
        return F.transform(F.filter(f"_own{j // 8}", lambda e: e["p"].bitwiseAND(F.lit(1 << j)) != 0), lambda e: e["t"])

    rows = rows.withColumn("_in", F.array(*map(part, range(SUBSETS))))
    whole = F.when(F.size("_terms") > 0, F.array_join(F.sort_array("_terms"), " ")).otherwise(F.col(text))
    sums = F.transform("_in", lambda x: F.when(F.size(x) == 0, "-").otherwise(F.substring(F.md5(F.array_join(x, " ").cast("binary")), 1, 8)))
    rows = rows.withColumn(name, F.when(F.size("_own") == 0, F.concat(F.lit("x"), F.md5(whole.cast("binary")))).otherwise(F.array_join(sums, ".")))
    return rows.drop("_terms", "_own", "_in", *(f"_own{i}" for i in range(4)))


def likeness(a: Column, b: Column) -> Column:
    """Equal places that are not empty, of those that are not empty in both; fingerprints of all terms are like equal ones only."""
    pair = F.arrays_zip(F.split(a, r"\.").alias("a"), F.split(b, r"\.").alias("b"))
    same = F.size(F.filter(pair, lambda x: (x["a"] == x["b"]) & (x["a"] != "-")))
    some = F.size(F.filter(pair, lambda x: (x["a"] != "-") | (x["b"] != "-")))
    return F.when(a == b, F.lit(1.0)).when(a.startswith("x") | b.startswith("x"), F.lit(0.0)).otherwise(same.cast("double") / F.greatest(some, F.lit(1)))


def following(rows: DataFrame, levels: int = _LEVELS) -> DataFrame:
    """key, head and next: the head of the row with the next greater key (null for the greatest). Keys are distinct.

    Windows span 2 ** _STEP neighbouring key values at a time; what is last in one looks among the firsts of the others.
    """
    if not levels:
        return rows.withColumn("next", F.lead("head").over(W.orderBy("key")))
    own = rows.withColumn("cell", F.shiftright("key", _STEP))
    own = own.withColumn("next", F.lead("head").over(W.partitionBy("cell").orderBy("key")))
    cells = own.groupBy("cell").agg(F.min_by("head", "key").alias("head"))
    up = following(cells.withColumnRenamed("cell", "key"), levels - 1).select(F.col("key").alias("cell"), F.col("next").alias("above"))
    return own.join(up, "cell").select("key", "head", F.coalesce("next", "above").alias("next"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document."""
    # The lexicon stands in the plan as a constant; plan descriptions, which the driver keeps and logs, need not repeat it.
    docs.sparkSession.conf.set("spark.sql.maxPlanStringLength", "10000")
    table = slots(lexicon(docs))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Rows without id need no neighbour, so they are spread over cells that no id has.
    base = base.withColumn("cell", F.coalesce(F.shiftright("doc_id", _STEP), F.lit(-(1 << 53)) - F.pmod(F.xxhash64("text"), F.lit(1 << 12))))
    named = base.where("doc_id is not null")
    # Of each range of ids the next lower one's greatest id, and its text.
    cells = kept(docs.where("doc_id is not null").groupBy(F.shiftright("doc_id", _STEP).alias("cell")).agg(F.max("doc_id").alias("high")))
    lower = following(cells.select((-F.col("cell")).alias("key"), F.col("high").alias("head"))).select((-F.col("key")).alias("cell"), F.col("next").alias("id"))

    def seen(ids: DataFrame, *keep: str) -> DataFrame:
        """The text that others see of the ids, and its fingerprint."""
        texts = named.select(F.col("doc_id").alias("id"), "text").join(ids, "id").groupBy(*keep, "id").agg(F.max("text").alias("text"))
        return printed(texts, table, "text", "print")

    ends = seen(cells.agg(F.max("high").alias("id"))).agg(F.first(F.struct(F.col("id").alias("doc_id"), "text", "print")).alias("first"))
    last = printed(base.where("doc_id is null").agg(F.max("text").alias("text")).where("text is not null"), table, "text", "print")
    last = last.agg(F.first(F.struct(F.lit(None).cast("long").alias("doc_id"), "text", "print")).alias("last"))
    ends = F.broadcast(kept(ends.crossJoin(last)))  # one row: what comes after the last document, and the one without id
    below = kept(seen(lower.where("id is not null"), "cell").select("cell", F.struct(F.col("id").alias("doc_id"), "text", "print").alias("top")))

    before = W.partitionBy("cell").orderBy("doc_id").rangeBetween(W.unboundedPreceding, -1)
    rows = base.withColumn("under", F.max(F.struct("doc_id", "text")).over(before)).join(below, "cell", "left").crossJoin(ends)
    no_id = F.col("doc_id").isNull()
    other = F.when(no_id, F.coalesce("first", "last")).otherwise(F.coalesce("top", "last", "first"))
    rows = rows.select("doc_id", "cell", "text", F.when(no_id | F.col("under").isNull(), other["text"]).otherwise(F.col("under.text")).alias("next"), other["print"].alias("other"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    new = F.when(third > 0, F.concat(F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third))).otherwise(F.col("text"))
    rows = rows.select("doc_id", "cell", "other", "text", n.cast("long").alias("n_chars"), new.alias("edited"))
    rows = printed(printed(rows, table, "text", "fingerprint"), table, "edited", "edited_fingerprint")
    rows = rows.select("doc_id", "cell", "other", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint")
    # The same window again: rows are still dealt and sorted by it, so this needs no shuffle.
    rows = rows.withColumn("under", F.when(~no_id, F.max(F.struct("doc_id", "fingerprint")).over(before)["fingerprint"]))
    near_next = likeness(F.col("fingerprint"), F.coalesce("under", "other"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), near_next.alias("near_next"))


#: The same in DuckDB's SQL, for tables with distinct doc_ids that are not null.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT doc_id, t, n, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
ed AS (SELECT a.doc_id, a.t, a.n, a.next_id, CASE WHEN a.n // 3 > 0 THEN substring(a.t, 1, a.n - a.n // 3) || substring(b.t, 1, a.n // 3) ELSE a.t END AS e
  FROM nx a JOIN d b ON a.next_id = b.doc_id),
raw AS (SELECT doc_id, 1 AS kind, unnest(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')) AS term FROM ed
  UNION ALL SELECT doc_id, 2, unnest(string_split_regex(translate(e, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')) FROM ed),
tok AS (SELECT DISTINCT doc_id, kind, term FROM raw WHERE length(term) >= {MIN_CHARS}),
nn AS (SELECT count(DISTINCT doc_id) AS n FROM tok WHERE kind = 1),
lex AS (SELECT term FROM tok, nn WHERE kind = 1 GROUP BY term, nn.n HAVING count(*) >= 2 AND count(*) >= nn.n * CAST({LOW} AS DOUBLE) AND count(*) <= greatest(nn.n * CAST({HIGH} AS DOUBLE), 2.0)),
w AS (SELECT term, {", ".join(f"CAST('0x' || substring(md5('{i // 4}:' || term), {i % 4 * 8 + 1}, 8) AS BIGINT) AS w{i}" for i in range(8))} FROM lex),
part AS (SELECT term, j FROM w, range(32) r(j)
  WHERE ((CASE j // 8 WHEN 0 THEN w0 & w1 WHEN 1 THEN w0 & w1 & w2 & w3 WHEN 2 THEN w0 & w1 & w2 & w3 & w4 & w5 ELSE w0 & w1 & w2 & w3 & w4 & w5 & w6 & w7 END) >> j) & 1 = 1),
h AS (SELECT doc_id, kind, j, substring(md5(string_agg(tok.term, ' ' ORDER BY tok.term)), 1, 8) AS h FROM tok JOIN part ON tok.term = part.term GROUP BY doc_id, kind, j),
g AS (SELECT doc_id, kind, j, coalesce(h.h, '-') AS h FROM (SELECT doc_id, kind, j FROM d, range({SUBSETS}) r(j), (SELECT unnest([1, 2]) AS kind)) LEFT JOIN h USING (doc_id, kind, j)),
allt AS (SELECT doc_id, kind, md5(string_agg(term, ' ' ORDER BY term)) AS m FROM tok GROUP BY doc_id, kind),
f AS (SELECT g.doc_id, g.kind, CASE WHEN bool_and(g.h = '-') THEN 'x' || coalesce(any_value(allt.m), md5(CASE WHEN g.kind = 1 THEN any_value(ed.t) ELSE any_value(ed.e) END)) ELSE string_agg(g.h, '.' ORDER BY g.j) END AS fp
  FROM g JOIN ed ON ed.doc_id = g.doc_id LEFT JOIN allt ON allt.doc_id = g.doc_id AND allt.kind = g.kind GROUP BY g.doc_id, g.kind),
near AS (SELECT a.doc_id, count(*) FILTER (a.h = b.h AND a.h <> '-') AS s1, count(*) FILTER (a.h <> '-' OR b.h <> '-') AS n1, count(*) FILTER (a.h = c.h AND a.h <> '-') AS s2, count(*) FILTER (a.h <> '-' OR c.h <> '-') AS n2
  FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.j = b.j AND a.kind = 1 AND b.kind = 2 JOIN ed ON ed.doc_id = a.doc_id JOIN g c ON c.doc_id = ed.next_id AND c.j = a.j AND c.kind = 1 GROUP BY a.doc_id)
SELECT ed.doc_id, n AS n_chars, sha256(e) AS edited_sha256, f1.fp AS fingerprint, f2.fp AS edited_fingerprint,
  (CASE WHEN f1.fp = f2.fp THEN 1.0 WHEN f1.fp[1] = 'x' OR f2.fp[1] = 'x' THEN 0.0 ELSE CAST(s1 AS DOUBLE) / n1 END)::DOUBLE AS near_edited,
  (CASE WHEN f1.fp = f3.fp THEN 1.0 WHEN f1.fp[1] = 'x' OR f3.fp[1] = 'x' THEN 0.0 ELSE CAST(s2 AS DOUBLE) / n2 END)::DOUBLE AS near_next
FROM ed JOIN f f1 ON f1.doc_id = ed.doc_id AND f1.kind = 1 JOIN f f2 ON f2.doc_id = ed.doc_id AND f2.kind = 2 JOIN f f3 ON f3.doc_id = ed.next_id AND f3.kind = 1 JOIN near ON near.doc_id = ed.doc_id
"""
