"""Queries of terms, names and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clusters, matching, outlets, topics, transitions
from tidemark.plans.catalog import _items, _read, query
from tidemark.plans.trends import TOPICS

_EACH = "[" + ", ".join(f"{{'topic': '{k}', 'terms': list_filter([{', '.join(f'CASE WHEN regexp_matches(l, {chr(39)}{topics.pattern((t,))}{chr(39)}) THEN {t!r} END' for t in ts)}], lambda x: x IS NOT NULL)}}" for k, ts in TOPICS.items()) + "]"


@query(f"SELECT doc_id, m.topic AS topic, array_to_string(m.terms, ',') AS terms FROM (SELECT doc_id, unnest({_EACH}) AS m FROM (SELECT doc_id, lower(text) AS l FROM documents)) WHERE len(m.terms) > 0")
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic of every document, with the terms that it has of it."""
    return matching.matched(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", TOPICS).select("doc_id", "topic", F.array_join("terms", ",").alias("terms"))


@query(f"SELECT doc_id, arg_max(m.topic, len(m.terms) * 100 - i) AS topic, max(len(m.terms)) AS hits FROM (SELECT doc_id, unnest(x) AS m, unnest(range(len(x))) AS i FROM (SELECT doc_id, {_EACH} AS x FROM (SELECT doc_id, lower(text) AS l FROM documents))) WHERE len(m.terms) >= 2 GROUP BY doc_id")
def best_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one topic of each document that has two terms of one or more."""
    own = _read(spark, sf_dir, "documents").select("doc_id", matching.matches(F.col("text"), TOPICS).alias("m"))
    return own.select("doc_id", matching.best(F.col("m")).alias("b")).where("b is not null").select("doc_id", "b.topic", F.col("b.hits").cast("long").alias("hits"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name, p_name AS k FROM part UNION SELECT DISTINCT p_type || ' ' || p_name || ' (shop.example)', p_name FROM part) SELECT name, min(trim(regexp_replace(lower(regexp_replace(name, '[(][^)]*[)]', '')), '[^a-z0-9]+', ' ', 'g'))) OVER (PARTITION BY k) AS outlet FROM n""")
def outlet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, and the same with their type before them, as names of sources."""
    part = _read(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).union(part.select(F.concat("p_type", F.lit(" "), "p_name", F.lit(" (shop.example)"))))
    return outlets.outlets(names, "name")


_STATUS = "CASE WHEN {0} % 7 = 0 THEN NULL WHEN {0} % 7 = 1 THEN 'frozen' WHEN {0} % 7 = 2 THEN 'canary' WHEN {0} % 7 = 3 THEN 'evaluated' ELSE 'pending_review' END"
_VERDICT = "CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'reject' ELSE 'later' END"


@query(f"""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS cat, {_STATUS.format('c_custkey')} AS s, c_custkey % 7 = 3 OR c_custkey % 7 = 2 AS done, c_acctbal >= 0 AS ok FROM customer WHERE c_custkey % 7 > 0),
i AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS cat, c_acctbal >= 0 AS ok FROM customer),
v AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CASE arg_max({_VERDICT}, o_orderkey) WHEN 'accept' THEN 'evaluated' ELSE 'rejected' END AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey),
x AS (SELECT coalesce(p.id, v.id) AS proposal_id, coalesce(p.cat, i.cat) AS category, p.s, p.id IS NOT NULL AS known, coalesce(done, false) AS done, n, CASE WHEN n IS NULL THEN NULL WHEN NOT coalesce(p.ok, i.ok) THEN 'not_editable' WHEN p.s = 'frozen' THEN 'frozen' WHEN coalesce(done, false) AND (p.s = n OR p.s = 'canary') THEN 'settled' ELSE 'merged' END AS outcome FROM p FULL JOIN v ON p.id = v.id LEFT JOIN i ON i.id = coalesce(p.id, v.id))
SELECT proposal_id, category, CASE WHEN outcome = 'merged' THEN n ELSE s END AS status, CASE WHEN outcome = 'merged' THEN '2024-02-01' WHEN done THEN '2024-01-01' END AS evaluated_at, outcome FROM x WHERE known OR outcome IS DISTINCT FROM 'not_editable'""")
def proposal_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as proposals, six of seven known, their orders as verdicts on them."""
    own = _read(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS string) AS proposal_id", "c_mktsegment AS category", "array(CASE WHEN c_acctbal >= 0 THEN 'scripts/prompts/news.md' ELSE 'elsewhere' END) AS target_files", "c_custkey")
    known = own.where("c_custkey % 7 > 0").selectExpr("proposal_id", "category", "target_files", f"{_STATUS.format('c_custkey')} AS status", "CASE WHEN c_custkey % 7 IN (2, 3) THEN '2024-01-01' END AS evaluated_at")
    verdicts = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", "CAST(o_custkey AS string) AS proposal_id", f"{_VERDICT} AS verdict")
    return transitions.decided(known, verdicts, own.drop("c_custkey"), r"^scripts/prompts/[a-z_]+\.md$", "2024-02-01").drop("target_files")


_HIT = f"x AS (SELECT doc_id, lang, source, day, item, string_split(text, chr(10))[1] AS title, m.topic AS topic, m.terms AS terms FROM (SELECT *, unnest({_EACH}) AS m FROM (SELECT *, lower(text) AS l, md5(text) AS item, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS day FROM documents)) WHERE len(m.terms) > 0)"
_BEST = "f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY topic, item ORDER BY day, doc_id) = 1), e AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY source LIKE '%1' DESC, day DESC, title, item) AS rank FROM f QUALIFY rank <= 8)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("title", F.substring_index("text", "\n", 1))
    return matching.matched(items, "text", TOPICS).drop("text")


@query(f"WITH {_HIT}, {_BEST} SELECT topic, CAST(rank AS INT) AS rank, item, doc_id, day, 'Matched ' || array_to_string(terms[1:4], ', ') AS reason FROM e")
def cluster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents of each topic (the limit is the feature), good sources and late days first."""
    own = clusters.evidence(_hits(spark, sf_dir), "item", ["day", "doc_id"], F.col("source").endswith("1"))
    return own.select("topic", "rank", "item", "doc_id", "day", "reason")


@query(f"""WITH {_HIT}, {_BEST}, s AS (SELECT topic, count(*) AS score FROM x GROUP BY topic), c AS (SELECT topic, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories FROM x GROUP BY topic),
p AS (SELECT topic, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT topic, source FROM x QUALIFY dense_rank() OVER (PARTITION BY topic ORDER BY source) <= 10) GROUP BY topic), l AS (SELECT topic, string_agg(item, ',' ORDER BY rank) AS evidence FROM e GROUP BY topic)
SELECT topic, score, categories, sources, evidence, CAST(row_number() OVER (ORDER BY score DESC, topic) AS INT) AS rank FROM s JOIN c USING (topic) JOIN p USING (topic) JOIN l USING (topic)""")
def ranked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by their number of hits, each with its languages, first sources and evidence."""
    hits = _hits(spark, sf_dir)
    scores = hits.groupBy("topic").agg(F.count("*").alias("score"))
    found = clusters.evidence(hits, "item", ["day", "doc_id"], F.col("source").endswith("1"))
    own = clusters.clusters(scores, hits, found, "item", "lang", "source")
    return own.select("topic", "score", F.array_join("categories", ",").alias("categories"), F.array_join("sources", ",").alias("sources"), F.array_join(F.transform("evidence", lambda x: x["item"]), ",").alias("evidence"), "rank")
