"""Queries of status and roadmap: customers as systems with orders as artifacts, brands as topics with parts as members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import roadmap, status
from tidemark.plans.catalog import _R, _read, query

_GROUP = lambda s: f"CASE WHEN count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) = 0 THEN 'missing' WHEN min(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END) < 5000 THEN 'invalid' WHEN max(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END) > 480000 THEN 'degraded' ELSE 'available' END"
_LAST = lambda s: f"max(CASE WHEN o_orderstatus = '{s}' THEN o_orderdate END)"
_AGGREGATES = ["count(*) > 18 AS duplicate", *(f"{_GROUP(s)} AS {n}" for n, s in (("ingestion", "F"), ("preview", "O"), ("public", "P"))), *(f"{_LAST(s)} AS {n}_at" for n, s in (("ingestion", "F"), ("preview", "O"), ("public", "P")))]


@query(f"""WITH s AS (SELECT o_custkey, {', '.join(_AGGREGATES)} FROM orders GROUP BY o_custkey), a AS (SELECT max(o_orderdate) AS as_of FROM orders),
d AS (SELECT *, date_trunc('year', ingestion_at) AS sd, date_trunc('year', preview_at) AS pd, date_trunc('year', public_at) AS ud, {_R("CASE WHEN preview_at < public_at THEN 0 ELSE date_diff('millisecond', public_at, preview_at) END / 3.6e6")} AS lag_hours, {_R("CASE WHEN as_of < ingestion_at THEN 0 ELSE date_diff('millisecond', ingestion_at, as_of) END / 3.6e6")} AS age FROM s, a),
r AS (SELECT *, CASE WHEN duplicate THEN 'manifest_duplicate_path' WHEN ingestion = 'invalid' THEN 'ingestion_artifact_invalid' WHEN preview = 'invalid' THEN 'preview_artifact_invalid' WHEN public = 'invalid' THEN 'public_artifact_invalid'
  WHEN ingestion <> 'available' THEN 'ingestion_artifact_missing' WHEN preview <> 'available' THEN 'preview_artifact_missing' WHEN pd > sd THEN 'preview_date_ahead_of_source' WHEN ud > sd THEN 'public_date_ahead_of_source' END AS b FROM d)
SELECT o_custkey, lag_hours, CASE WHEN b IS NOT NULL THEN 'blocked' WHEN age > 26 OR pd < sd THEN 'stale' WHEN public <> 'available' OR ud < sd OR lag_hours > 24 THEN 'pending' ELSE 'fresh' END AS freshness_state, coalesce(b, CASE WHEN age > 26 THEN 'ingestion_stale' WHEN pd < sd THEN 'preview_stale' END) AS blocked_reason FROM r""")
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    own = orders.groupBy("o_custkey").agg(*map(F.expr, _AGGREGATES)).crossJoin(F.broadcast(orders.agg(F.max("o_orderdate").alias("as_of"))))
    year = lambda c: F.date_trunc("year", c)
    own = own.withColumns({"source_date": year("ingestion_at"), "preview_date": year("preview_at"), "public_date": year("public_at")})
    return status.status(own).select("o_custkey", "lag_hours", "freshness_state", "blocked_reason")


_MEMBERS = [
    "p_brand AS topic", "p_partkey AS cluster_id", "p_size AS size", "CASE WHEN p_partkey % 9 > 0 THEN concat('S', 1 + p_size % 6) END AS tech_layer", "concat('M', 1 + p_partkey % 5) AS maturity",
    "concat('D', p_partkey % 17 % 4) AS delta", "concat('E', 1 + (p_partkey + p_size) % 4) AS evidence_grade",
]


@query(f"""WITH m AS (SELECT {', '.join(_MEMBERS)} FROM part), live AS (SELECT * FROM m WHERE tech_layer IS NOT NULL), l AS (SELECT topic, tech_layer, sum(size) AS n FROM live GROUP BY ALL),
p AS (SELECT topic, tech_layer FROM l QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, tech_layer) = 1),
s AS (SELECT topic, array_to_string(list_sort(list(l.tech_layer))[1:3], ',') AS secondary FROM l JOIN p USING (topic) WHERE l.tech_layer <> p.tech_layer GROUP BY topic),
g AS (SELECT topic, count(*) AS members, max(maturity) AS m, max(delta) AS d, count(*) FILTER (evidence_grade = 'E1') AS e1, count(*) FILTER (evidence_grade <= 'E2') AS e2, count(*) FILTER (evidence_grade <= 'E3') AS e3 FROM live GROUP BY topic),
x AS (SELECT *, CASE WHEN e1 >= least(2, members) THEN 'E1' WHEN e2 >= least(2, members) THEN 'E2' WHEN e3 >= least(2, members) THEN 'E3' ELSE 'E4' END AS grade FROM g),
y AS (SELECT *, CASE WHEN grade = 'E3' AND m > 'M2' THEN 'M2' ELSE m END AS maturity, CASE WHEN grade = 'E3' AND d > 'D1' THEN 'D1' WHEN d = 'D3' AND e1 = 0 THEN 'D2' ELSE d END AS delta FROM x)
SELECT topic, members, p.tech_layer AS tech_layer, coalesce(secondary, '') AS secondary_layers, maturity, delta, grade AS evidence_grade, CASE maturity WHEN 'M1' THEN 'far' WHEN 'M3' THEN 'near' WHEN 'M4' THEN 'near' ELSE 'mid' END AS horizon FROM y JOIN p USING (topic) LEFT JOIN s USING (topic)""")
def technology_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.expr("CAST(null AS array<string>)")
    members = _read(spark, sf_dir, "part").selectExpr(*_MEMBERS).withColumns({"secondary_layers": none, "blockers": none})
    own = roadmap.assessed(members, "topic")
    return own.select("topic", "members", "tech_layer", F.array_join("secondary_layers", ",").alias("secondary_layers"), "maturity", "delta", "evidence_grade", roadmap.horizon(F.col("maturity")).alias("horizon"))
