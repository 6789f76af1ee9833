"""Queries of the gates: orders stand for answers, customers for what they are about, parts for their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import gates
from tidemark.plans.catalog import _read, query

_CASE = "CASE o_orderpriority WHEN '1-URGENT' THEN '{}' WHEN '2-HIGH' THEN '{}' WHEN '3-MEDIUM' THEN '{}' WHEN '5-LOW' THEN '{}' ELSE '{}' END"
_STAGE, _CALL = _CASE.format("accelerating", "emerging", "plateau", "declining", "unspecified"), "CASE o_orderstatus WHEN 'F' THEN 'organic' WHEN 'O' THEN 'mixed' ELSE 'syndicated' END"
_SURE = _CASE.format("verified", "verified", "snippet_inference", "unverified", "unspecified")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every order as an assessment of its customer, and the customers that are asked about."""
    own = _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "CAST(o_custkey AS string) AS cluster_id", f"{_STAGE} AS stage", f"{_CALL} AS syndication_call", "o_totalprice / 400000 AS confidence", "o_totalprice / 600000 AS signal_strength",
        "CAST(NULL AS double) AS source_breadth", "CAST(NULL AS double) AS durability", "o_orderpriority AS headline", "array(o_orderstatus) AS rationale", "array('TR-1') AS rubric_hits", "o_totalprice < 10000 AS security_flag",
    )
    return own, _read(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr("CAST(c_custkey AS string) AS cluster_id")


_RULED = f"""x AS (SELECT o.o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS cluster_id, {_STAGE} AS s0, {_CALL} AS c0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 400000)) AS conf0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 600000)) AS sig0,
  o_totalprice < 10000 AS f0, c_custkey IS NOT NULL AS known, c_custkey IS NOT NULL AND o_orderkey > min(o_orderkey) OVER (PARTITION BY o_custkey) AS again, {_STAGE} = 'unspecified' AS broken
  FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey),
y AS (SELECT *, CASE WHEN NOT known THEN 'unknown_cluster_id' WHEN again THEN 'duplicate' END AS drop_reason, f0 AND s0 <> 'insufficient' AND NOT broken AS flagged, s0 IN ('accelerating', 'emerging') AS grows FROM x),
z AS (SELECT *, CASE WHEN broken OR flagged THEN 'insufficient' WHEN grows AND (c0 = 'syndicated' OR conf0 < 0.7) THEN 'plateau' ELSE s0 END AS stage,
  CASE WHEN broken THEN 'contract_violation' WHEN flagged THEN 'security_flag' WHEN grows AND c0 = 'syndicated' THEN 'syndicated' WHEN grows AND conf0 < 0.7 THEN 'low_confidence' ELSE '' END AS notes FROM y)"""


@query(f"""WITH {_RULED} SELECT CAST(c_custkey AS VARCHAR) AS cluster_id, coalesce(stage, 'insufficient') AS stage, CASE WHEN broken OR seq IS NULL THEN 'organic' ELSE c0 END AS syndication_call, CASE WHEN broken OR seq IS NULL THEN 0.0::DOUBLE ELSE conf0 END AS confidence,
  CASE WHEN broken OR seq IS NULL THEN 0.0::DOUBLE ELSE sig0 END AS signal_strength, CASE WHEN broken OR seq IS NULL THEN false ELSE f0 END AS security_flag, CASE WHEN seq IS NULL THEN 'unassessed' WHEN broken THEN 'contract_violation' ELSE 'model' END AS source, coalesce(notes, 'unassessed') AS notes
  FROM (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) LEFT JOIN (SELECT * FROM z WHERE drop_reason IS NULL) ON cluster_id = CAST(c_custkey AS VARCHAR)""")
def trend_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assessment for each customer that is asked about."""
    own = gates.trend_gate(*_answers(spark, sf_dir))
    return own.select("cluster_id", "stage", "syndication_call", "confidence", "signal_strength", "security_flag", "source", F.array_join("gate_notes", ",").alias("notes"))


@query(f"WITH {_RULED} SELECT count(*) FILTER (drop_reason = 'unknown_cluster_id') AS unknown_cluster_id, count(*) FILTER (drop_reason = 'duplicate') AS duplicate, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason IS NULL AND notes <> '') AS noted FROM z")
def trend_gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.trend_ruled(*_answers(spark, sf_dir)).agg(*gates.counters(gates.TREND))


@query(f"""WITH e AS (SELECT l_orderkey, list_distinct(list(CAST(l_partkey AS VARCHAR))) AS ids FROM lineitem GROUP BY l_orderkey),
k AS (SELECT l_orderkey, count(*) AS known, count(*) FILTER (p_size <= 30) AS ver FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_size <= 47 GROUP BY l_orderkey),
h AS (SELECT o_orderkey AS seq, CAST(date_trunc('month', o_orderdate) AS DATE) AS brief, CASE WHEN o_orderstatus <> 'P' THEN 'h' || o_orderkey % 5 END AS hid, {_SURE} AS confidence, coalesce(len(ids), 0) AS n, coalesce(known, 0) AS known, coalesce(ver, 0) AS ver, o_totalprice < 10000 AS flag, c_custkey IS NOT NULL AS there
  FROM orders LEFT JOIN e ON e.l_orderkey = o_orderkey LEFT JOIN k ON k.l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey),
u AS (SELECT brief, CAST(substring(hid, 2) AS BIGINT) - row_number() OVER (PARTITION BY brief ORDER BY hid) AS free FROM (SELECT DISTINCT brief, hid FROM h WHERE hid <> 'h0')),
b AS (SELECT seq, brief, row_number() OVER (PARTITION BY brief ORDER BY seq) AS k FROM h WHERE hid IS NULL),
g AS (SELECT b.seq, 'h' || (any_value(k) + count(free)) AS given FROM b LEFT JOIN u ON u.brief = b.brief AND u.free < k GROUP BY b.seq),
c AS (SELECT h.*, coalesce(hid, given) AS highlight_id, CASE WHEN n > 0 AND ver = n THEN 'verified' WHEN ver > 0 THEN 'snippet_inference' ELSE 'unverified' END AS ceil, list_position(['unverified', 'snippet_inference', 'verified'], confidence) AS a FROM h LEFT JOIN g USING (seq)),
r AS (SELECT *, CASE WHEN flag THEN 'security_flag' WHEN a IS NULL THEN 'contract_violation' WHEN n NOT BETWEEN 1 AND 4 OR known < n THEN 'unknown_evidence' WHEN NOT there THEN 'unknown_cluster' WHEN a > list_position(['unverified', 'snippet_inference', 'verified'], ceil) THEN 'overclaimed' END AS r1 FROM c),
d AS (SELECT *, CASE WHEN r1 IS NULL AND seq > min(CASE WHEN r1 IS NULL THEN seq END) OVER (PARTITION BY brief, highlight_id) THEN 'duplicate' ELSE r1 END AS r2 FROM r)
SELECT seq, brief, highlight_id, confidence, ceil AS confidence_ceiling, CASE WHEN r2 IS NULL AND count(*) FILTER (r2 IS NULL) OVER (PARTITION BY brief ORDER BY seq) > 5 THEN 'over_cap' ELSE r2 END AS drop_reason FROM d""")
def brief_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a highlight of its month's brief, with its parts as evidence."""
    o, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    parts = lines.groupBy(F.col("l_orderkey").alias("seq")).agg(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))).alias("evidence_ids"))
    own = o.selectExpr(
        "o_orderkey AS seq", "CAST(date_trunc('month', o_orderdate) AS date) AS brief", "CASE WHEN o_orderstatus <> 'P' THEN concat('h', o_orderkey % 5) END AS highlight_id", "concat('Order ', o_orderkey) AS headline", "o_orderpriority AS body", "o_orderstatus AS why",
        f"{_SURE} AS confidence", "CAST(o_custkey AS string) AS cluster_id", "o_totalprice < 10000 AS security_flag",
    ).join(parts, "seq", "left")
    candidates = _read(spark, sf_dir, "part").where("p_size <= 47").selectExpr("CAST(p_partkey AS string) AS item_id", "p_size <= 30 AS verified")
    clusters = _read(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr("CAST(c_custkey AS string) AS cluster_id")
    return gates.brief_gate(own, candidates, clusters, 7, "brief").select("seq", "brief", "highlight_id", "confidence", "confidence_ceiling", "drop_reason")
