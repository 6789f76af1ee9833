"""Queries of days and files: orders by day in two tiers, and orders as files of which line items expect some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import _read, query
from tidemark.sources import archive

_HOT, _COLD = "1996-01-01", "1996-07-01"


@query(f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s FROM orders), h AS (SELECT day, count(*) AS n, 0.5::DOUBLE AS pass_rate, false AS cold FROM o WHERE day >= DATE '{_HOT}' GROUP BY day),
c AS (SELECT day, count(*) AS n, CASE WHEN count(*) FILTER (s = 'P') = 0 THEN 1.0::DOUBLE END AS pass_rate, true AS cold FROM o WHERE day < DATE '{_COLD}' GROUP BY day),
d AS (SELECT * FROM h UNION ALL SELECT * FROM c WHERE day NOT IN (SELECT day FROM h))
SELECT count(*) AS covered, min(day) AS "first", max(day) AS "last", max(day) - min(day) + 1 AS span, floor(count(*) / (max(day) - min(day) + 1) * 1000 + 0.5) / 10 AS coverage, CAST(sum(n) AS BIGINT) AS total, CAST(floor(sum(n) / count(*) + 0.5) AS BIGINT) AS average, floor(avg(pass_rate) * 1e6 + 0.5) / 1e6 AS pass_rate, count(pass_rate) AS rated_days, arg_max(n, day) AS latest, arg_max(cold, day) AS latest_cold FROM d""")
def day_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of both tiers, the hot one first, as one row of figures."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus")
    hot = o.where(F.col("date") >= _HOT).groupBy("date").agg(F.count("*").alias("item_count"), F.lit(0.5).alias("pass_rate"))
    cold = o.where(F.col("date") < _COLD).groupBy("date").agg(F.count("*").alias("item_count"), F.when(F.count_if(F.col("o_orderstatus") == "P") == 0, 1.0).alias("pass_rate"))
    own = archive.kpis(archive.combined(hot, cold))
    return own.withColumn("pass_rate", F.floor(F.col("pass_rate") * 1e6 + 0.5) / 1e6)


_DATE = "CASE WHEN o_orderkey % 5 = 0 THEN '1996-02-30' ELSE '1996-02-29' END"
_RUN = "CASE WHEN o_orderkey % 3 = 0 THEN '\"1996-02-29T24:00Z\"' WHEN o_orderkey % 3 = 1 THEN 'null' ELSE '\"1996-02-29T23:59:01.5+08:00\"' END"
_CONTENT = f"""concat('{{"date": "', {_DATE}, '", "last_run": ', {_RUN}, ', "schema": "', o_orderpriority, '"', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '}}' END)"""


@query(f"""WITH f AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, {_CONTENT} AS content FROM orders),
e AS (SELECT DISTINCT 2 * l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'N')
SELECT CAST(coalesce(e.k, f.k) AS VARCHAR) AS path, e.k IS NOT NULL AS expected, f.k IS NOT NULL AS present, CASE WHEN f.k IS NULL THEN 'missing' WHEN f.k % 11 = 0 THEN 'invalid_type' WHEN f.k % 7 = 0 THEN 'invalid_json' WHEN f.k % 5 = 0 OR f.k % 3 = 0 THEN 'invalid_date' ELSE 'available' END AS status,
  CASE WHEN f.k % 11 > 0 THEN sha256(content) END AS sha256, CASE WHEN f.k % 11 > 0 THEN strlen(content) END AS bytes, CASE WHEN f.k % 7 > 0 THEN p END AS schema_version,
  CASE WHEN f.k IS NULL THEN '' WHEN f.k % 11 = 0 THEN 'not_a_regular_file' WHEN f.k % 7 = 0 THEN 'invalid_json' ELSE concat_ws(',', CASE WHEN f.k % 5 = 0 THEN 'invalid_date:date' END, CASE WHEN f.k % 3 = 0 THEN 'invalid_date:last_run' END) END AS errors
FROM e FULL JOIN f ON e.k = f.k WHERE coalesce(f.s, 'O') <> 'P'""")
def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, one in eleven no file, one in seven cut off, some with days or instants that don't exist."""
    o = _read(spark, sf_dir, "orders")
    found = o.selectExpr("'orders' AS `group`", "CAST(o_orderkey AS string) AS path", f"{_CONTENT} AS content", "o_orderkey % 11 > 0 AS is_file")
    expected = _read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").selectExpr("'orders' AS `group`", "CAST(2 * l_orderkey AS string) AS path")
    own = archive.inventory(expected, found, o.where("o_orderstatus = 'P'").selectExpr("CAST(o_orderkey AS string) AS path"))
    return own.select("path", "expected", "present", "status", "sha256", "bytes", "schema_version", F.array_join("errors", ",").alias("errors"))
