"""Queries that choose: what is new, what is no near duplicate, what is from enough sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import page_title, title_tokens, topic_url
from tidemark.functions.columns import STOP
from tidemark.operators import exploration, fuzzy, likeness
from tidemark.plans.catalog import _R, _TITLE, _read, query

_TOKENS = lambda x: f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9.+\\-]*[a-z0-9]|[a-z0-9]{{3,}}'), lambda w: len(w) >= 3 AND w NOT IN ({', '.join(map(repr, STOP))}))))"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 5 > 0 THEN CAST(CAST(DATE '2024-01-01' + CAST(page_id % 28 AS INT) AS DATE) AS VARCHAR) END AS published, {_TOKENS(_TITLE)} AS t FROM pages),
e AS (SELECT min(page_id) AS page_id, arg_min(coalesce(published, ''), page_id) AS published, t FROM p WHERE (published IS NULL OR published >= '2024-01-05') AND len(t) >= 2 GROUP BY t),
b AS (SELECT doc_id, {_TOKENS('text')} AS t FROM documents), x AS (SELECT page_id, len(t) AS na, unnest(t) AS w FROM e), y AS (SELECT doc_id, len(t) AS nb, unnest(t) AS w FROM b),
j AS (SELECT page_id, max(j) AS j FROM (SELECT page_id, count(*)::DOUBLE / (na + nb - count(*)) AS j FROM x JOIN y USING (w) GROUP BY page_id, doc_id, na, nb) GROUP BY page_id),
n AS (SELECT page_id, published, {_R('1 - coalesce(j, 0.0::DOUBLE)')} AS novelty FROM e LEFT JOIN j USING (page_id))
SELECT page_id, nullif(published, '') AS published, novelty, CAST(row_number() OVER (ORDER BY novelty DESC, published DESC, page_id) AS INT) AS rank FROM n WHERE novelty >= 0.4 QUALIFY rank <= 100""")
def novelty_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages by how unlike they are to any whole document; the best 100 are the feature. Days are made from page_id, some are unknown."""
    day = F.when(F.col("page_id") % 5 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")).cast("string"))
    entries = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), title_tokens(page_title(F.col("html"))).alias("tokens"), day.alias("published"))
    older = _read(spark, sf_dir, "documents").select("doc_id", title_tokens(F.col("text")).alias("tokens"))
    return likeness.ranked(entries, older, "doc_id", "2024-01-05", 0.4, 100).select(F.col("seq").alias("page_id"), "published", "novelty", "rank")


@query()
def fuzzy_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages the loop over all pages keeps, by address and likeness of titles."""
    pages = _read(spark, sf_dir, "pages").select("page_id", topic_url(F.col("url")).alias("url"), page_title(F.col("html")).alias("title"))
    return fuzzy.deduplicated(pages, "page_id", "url", "title").select("page_id", "kept")


@query()
def hhi_redraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten places in each language for the longest documents, drawn again until their sources are spread."""
    own = exploration.redrawn(_read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "lang", "source", [F.desc("n_chars"), F.col("doc_id")], 10, 0.4, 0.14)
    return own.select("lang", "doc_id", "source", "rank", "hhi", F.array_join("demoted_sources", ",").alias("demoted_sources"))
