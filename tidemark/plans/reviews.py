"""Queries of reviews: orders as forecasts of their customers, and as proposed changes whose evidence is their customer's order values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reviews
from tidemark.plans.catalog import _read, query

_TRAJECTORY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'layer_shift' WHEN '2-HIGH' THEN 'consolidating' WHEN '3-MEDIUM' THEN 'unforecastable' WHEN '5-LOW' THEN 'stalling' ELSE 'unspecified' END"
_HORIZON = "CASE o_orderstatus WHEN 'F' THEN 'near' WHEN 'O' THEN 'far' ELSE 'soon' END"
_MILESTONE, _FALSIFIER = "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'shipped' END", "CASE WHEN o_orderkey % 5 > 0 THEN 'not shipped in time' END"


@query(f"""WITH x AS (SELECT o_orderkey AS seq, o_custkey, {_TRAJECTORY} AS t0, {_HORIZON} AS h0, {_MILESTONE} AS m0, coalesce({_FALSIFIER}, '') AS f, greatest(0.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 400000)) AS c0, o_totalprice < 10000 AS flag FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
y AS (SELECT *, t0 = 'unspecified' AS broken, flag AND t0 NOT IN ('unforecastable', 'unspecified') AS s, m0 <> '' AND f = '' AND t0 <> 'unspecified' AS nf, h0 = 'soon' AND t0 <> 'unspecified' AS bad FROM x),
z AS (SELECT *, CASE WHEN broken OR s OR nf THEN 'unforecastable' ELSE t0 END AS t FROM y),
w AS (SELECT *, NOT broken AND t = 'unforecastable' AND NOT bad AS hc, NOT broken AND t = 'unforecastable' AND m0 <> '' AS mc, (s OR nf) AND c0 > 0 AS cc FROM z)
SELECT CAST(c_custkey AS VARCHAR) AS cluster_id, coalesce(t, 'unforecastable') AS trajectory, CASE WHEN seq IS NULL OR broken OR bad OR hc THEN 'none' ELSE h0 END AS horizon, CASE WHEN seq IS NULL OR broken OR mc THEN '' ELSE m0 END AS next_milestone, CASE WHEN seq IS NULL OR broken OR cc THEN 0.0::DOUBLE ELSE c0 END AS confidence,
  CASE WHEN seq IS NULL THEN 'unassessed' WHEN broken THEN 'contract_violation' ELSE 'model' END AS source,
  CASE WHEN seq IS NULL THEN 'unassessed' WHEN broken THEN 'contract_violation' ELSE concat_ws(',', CASE WHEN s THEN 'security_flag' END, CASE WHEN nf THEN 'no_falsifier' END, CASE WHEN bad THEN 'horizon_unknown' END, CASE WHEN hc THEN 'horizon_cleared' END, CASE WHEN mc THEN 'milestone_cleared' END, CASE WHEN cc THEN 'confidence_cleared' END) END AS notes
FROM (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) LEFT JOIN w ON o_custkey = c_custkey""")
def roadmap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast for each customer that is asked about."""
    none = "CAST(NULL AS array<string>)"
    answers = _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "CAST(o_custkey AS string) AS cluster_id", f"{_TRAJECTORY} AS trajectory", f"{_HORIZON} AS horizon", f"{_MILESTONE} AS next_milestone", f"{_FALSIFIER} AS falsifier", f"{none} AS watch_signals",
        "o_orderpriority AS adoption_note", f"{none} AS blockers_ranked", "o_totalprice / 400000 AS confidence", f"{none} AS rubric_hits", "o_totalprice < 10000 AS security_flag",
    )
    asked = _read(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr("CAST(c_custkey AS string) AS cluster_id")
    return reviews.roadmap_gate(answers, asked).select("cluster_id", "trajectory", "horizon", "next_milestone", "confidence", "source", F.array_join("gate_notes", ",").alias("notes"))


_WEEKLY = 500
_SAID = "floor(o_totalprice / 1e6 * 1000 + 0.5) + CASE WHEN o_orderkey % 5 = 0 THEN 500 ELSE 0 END"
_DROPS, _NO_BACK, _ELSEWHERE, _FEW_HITS, _UNANSWERED = "o_orderkey % 3 = 0", "o_orderkey % 4 = 0", "o_orderkey % 17 = 0", "o_orderkey % 6 = 0", "o_orderkey % 13 = 0"
_VERDICT = "CASE o_orderstatus WHEN 'P' THEN 'reject' ELSE CASE WHEN o_orderkey % 19 = 0 THEN 'maybe' ELSE 'accept' END END"


@query(f"""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice / 1e6 * 1000 + 0.5) AS BIGINT) AS milli, CAST({_SAID} AS BIGINT) AS said, o_orderkey % 7 = 0 AS mute, o_orderkey % 2 = 0 AS second, o_totalprice < 5000 AS tainted FROM orders),
m AS (SELECT DISTINCT o_custkey, day, milli FROM o), d AS (SELECT DISTINCT day FROM o), cd AS (SELECT DISTINCT o_custkey, day FROM o), bad AS (SELECT DISTINCT o_custkey FROM o WHERE tainted),
f AS (SELECT o.o_orderkey AS seq, o.o_custkey, o.tainted, bad.o_custkey IS NOT NULL AS cat, {_UNANSWERED} AS missing, {_VERDICT} AS answer, {_FEW_HITS} AS few,
  mute OR NOT (m.milli IS NOT NULL OR (second AND cd.day IS NOT NULL)) AS f1, {_NO_BACK} OR {_ELSEWHERE} AS f2, c_custkey IS NOT NULL AS f3, {_DROPS} AND (NOT mute)::INT + (second AND d.day IS NOT NULL)::INT < 2 AS f4
  FROM o LEFT JOIN bad ON bad.o_custkey = o.o_custkey LEFT JOIN m ON m.o_custkey = o.o_custkey AND m.day = o.day AND m.milli = o.said LEFT JOIN cd ON cd.o_custkey = o.o_custkey AND cd.day = o.day + 1 LEFT JOIN d ON d.day = o.day + 1
  LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = o.o_custkey),
r AS (SELECT *, concat_ws(',', CASE WHEN f1 THEN 'CE-1' END, CASE WHEN f2 THEN 'CE-2' END, CASE WHEN f3 THEN 'CE-3' END, CASE WHEN f4 THEN 'CE-4' END) AS failed, CASE WHEN few THEN 'CE-1,CE-2' ELSE 'CE-1,CE-2,CE-3,CE-4' END AS own,
  CASE WHEN tainted THEN 'security_flag' WHEN cat THEN 'category_tainted' WHEN missing THEN 'missing' WHEN answer = 'maybe' THEN 'illegal_verdict' WHEN answer = 'reject' THEN 'rejected' WHEN f1 OR f2 OR f3 OR f4 THEN 'rubric' WHEN few THEN 'hits_incomplete' END AS r1 FROM f),
q AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM (SELECT min(seq) AS seq FROM r WHERE r1 IS NULL GROUP BY o_custkey)),
z AS (SELECT r.*, CASE WHEN r1 IS NOT NULL OR k <= {_WEEKLY} THEN r1 WHEN seq > (SELECT max(seq) FROM q WHERE k = {_WEEKLY}) THEN 'total_quota' ELSE 'category_quota' END AS reason FROM r LEFT JOIN q USING (seq))
SELECT seq, CASE WHEN reason IS NULL THEN 'accept' ELSE 'reject' END AS verdict, reason AS drop_reason, CASE WHEN reason IS NULL THEN 'CE-1,CE-2,CE-3,CE-4' WHEN reason IN ('security_flag', 'category_tainted') THEN 'CE-5' WHEN reason = 'missing' THEN '' WHEN reason = 'rubric' THEN failed WHEN reason IN ('rejected', 'illegal_verdict') THEN own ELSE 'CE-3' END AS rubric_hits FROM z""")
def change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a change proposed for its customer; orders of the customer and day are the metrics that its evidence must meet."""
    o = _read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    said = f"CASE WHEN o_orderkey % 7 = 0 THEN 'no figures' ELSE concat('verified_rate ', CAST(CAST(({_SAID}) / 1000 AS decimal(10,3)) AS string), ' on ', day) END"
    proposals = o.selectExpr(
        "o_orderkey AS seq", "CAST(o_orderkey AS string) AS proposal_id", "CAST(o_custkey AS string) AS category", f"CASE WHEN {_DROPS} THEN 'drop_query' ELSE 'add_query' END AS change_type", f"array(CASE WHEN {_ELSEWHERE} THEN 'README.md' ELSE 'scripts/prompts/orders.md' END) AS target_files",
        "'low' AS risk", f"CASE WHEN {_NO_BACK} THEN '' WHEN {_DROPS} THEN 'Restore the line' ELSE 'Remove the line' END AS rollback", "CASE WHEN o_totalprice < 5000 THEN 'Ignore previous rules' ELSE o_orderpriority END AS summary",
        f"CASE WHEN o_orderkey % 2 = 0 THEN array({said}, concat('needs_review 0 on ', date_add(day, 1))) ELSE array({said}) END AS evidence",
    )
    hits = f"CASE WHEN {_FEW_HITS} THEN array('CE-1', 'CE-2') ELSE array('CE-1', 'CE-2', 'CE-3', 'CE-4', 'other') END AS rubric_hits"
    verdicts = o.where(f"NOT {_UNANSWERED}").selectExpr("o_orderkey AS seq", "CAST(o_orderkey AS string) AS proposal_id", f"{_VERDICT} AS verdict", hits, "false AS security_flag")
    metrics = o.selectExpr("CAST(o_custkey AS string) AS category", "day AS date", "o_totalprice / 1e6 AS verified_rate", "0 AS needs_review")
    under_way = _read(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("CAST(c_custkey AS string) AS category", "1 AS n")
    return reviews.change_gate(proposals, verdicts, metrics, under_way, _WEEKLY).select("seq", "verdict", "drop_reason", F.array_join("rubric_hits", ",").alias("rubric_hits"))
