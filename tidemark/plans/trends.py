"""Queries of whole trend metrics and timelines: documents as dated items, their first line as title. Lists come as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import norm_title
from tidemark.operators import topics, trends
from tidemark.plans.catalog import _R, LEXICON, _read, query

#: A topic that no text has.
TOPICS = LEXICON | {"absent": ("qqqxqqq",)}


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with gaps: squares modulo 61 leave about half of them out."""
    k = F.col("doc_id") % 61
    own = _read(spark, sf_dir, "documents").select("text", "source", F.date_add(F.lit("2024-01-01").cast("date"), (k * k % 61).cast("int")).alias("day"), F.md5(F.col("text").cast("binary")).alias("item"), F.substring_index("text", "\n", 1).alias("title"))
    return own.withColumn("key", norm_title(F.col("title")))


def _metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _dated(spark, sf_dir)
    return trends.measured(topics.matched(items, "text", TOPICS), items), items


def _days(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda d: d.cast("string")), ",")


_DATED = "i AS (SELECT text, source, CAST(DATE '2024-01-01' + CAST((doc_id % 61) * (doc_id % 61) % 61 AS INT) AS DATE) AS day, md5(text) AS item, string_split(text, chr(10))[1] AS title, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM documents)"
_ALL = "h AS (" + " UNION ALL ".join(f"SELECT '{k}' AS topic, * FROM i WHERE regexp_matches(lower(text), '{topics.pattern(t)}')" for k, t in TOPICS.items()) + ")"
_CAL = """cal AS (SELECT min(day) AS a, max(day) AS z, count(DISTINCT day) AS seen, CAST(max(day) - min(day) AS BIGINT) + 1 AS cal FROM i),
axis AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM cal),
gaps AS (SELECT coalesce(string_agg(CAST(day AS VARCHAR), ',' ORDER BY day), '') AS missing FROM axis WHERE day NOT IN (SELECT day FROM i)),
d AS (SELECT topic, day, count(*) AS n, count(DISTINCT item) AS u FROM h GROUP BY ALL)"""
_MA = lambda w: f"(SELECT topic, {_R('CAST(sum(n) FILTER (day > z - {w}) AS DOUBLE) / count(*) FILTER (day > z - {w})'.format(w=w))} AS ma{w}, count(*) FILTER (day > z - {w}) AS ma{w}_days, {_R('CAST(count(*) FILTER (day > z - {w}) AS DOUBLE) / {w}'.format(w=w))} AS ma{w}_coverage, any_value(z - {w - 1} < a) AS ma{w}_truncated FROM d, cal GROUP BY topic)"
_METRICS = f"""WITH {_DATED}, {_ALL}, {_CAL},
g AS (SELECT topic, key, count(*) AS n, count(DISTINCT source) AS s, count(DISTINCT day) AS days, min(title) AS title, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM h WHERE key <> '' GROUP BY ALL),
src AS (SELECT topic, source, count(*) AS n FROM h GROUP BY ALL),
m AS (SELECT topic, count(*) AS occurrences, count(DISTINCT item) AS unique_items, count(DISTINCT day) AS active_days FROM h GROUP BY topic),
t AS (SELECT topic, count(*) AS unique_titles, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n > 1 AND s > 1) AS crossed, coalesce(max(n) FILTER (n > 1), 0) AS most FROM g GROUP BY topic),
c AS (SELECT topic, count(*) AS distinct_sources, sum(n * n)::DOUBLE AS sq FROM src GROUP BY topic),
ts AS (SELECT topic, string_agg(source || ':' || n, ',' ORDER BY n DESC, source) AS top_sources FROM (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, source) <= 5) GROUP BY topic),
tr AS (SELECT topic, string_agg(n || ':' || s || ':' || days || ':' || sources || ':' || md5(title), ',' ORDER BY n DESC, s DESC, title) AS top_repeats FROM (SELECT * FROM g WHERE n > 1 AND s > 1 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, s DESC, title) <= 5) GROUP BY topic),
sl AS (SELECT topic, count(*) AS points, CASE WHEN count(*) >= 3 THEN {_R('regr_slope(y, x)')} END AS slope, CASE WHEN count(*) >= 3 THEN {_R('regr_r2(y, x)')} END AS r2 FROM (SELECT topic, n::DOUBLE AS y, CAST(day - z + 29 AS DOUBLE) AS x FROM d, cal) WHERE x >= 0 GROUP BY topic),
dl AS (SELECT topic, string_agg(day || ':' || n || ':' || u, ',' ORDER BY day) AS daily FROM d GROUP BY topic)
"""


@query(_METRICS + f"""SELECT topic, occurrences, unique_items, coalesce(unique_titles, 0) AS unique_titles, active_days, {_R('active_days::DOUBLE / seen')} AS active_day_rate, daily, ma7, ma7_days, ma7_coverage, ma7_truncated, ma7_days > 0 AND ma7_coverage >= 0.6 AS ma7_sufficient,
  ma30, ma30_days, ma30_coverage, ma30_truncated, ma30_days > 0 AND ma30_coverage >= 0.6 AS ma30_sufficient, ma90, ma90_days, ma90_coverage, ma90_truncated, ma90_days > 0 AND ma90_coverage >= 0.6 AS ma90_sufficient, slope, r2, coalesce(points, 0) AS points,
  distinct_sources, {_R('sq / (occurrences * occurrences)')} AS hhi, {_R('1 / (sq / (occurrences * occurrences))')} AS effective_sources, top_sources, {_R('1 - coalesce(unique_titles, 0)::DOUBLE / occurrences')} AS duplicate_title_ratio, coalesce(repeated, 0) AS repeated_title_groups, coalesce(crossed, 0) AS cross_source_repeat_groups,
  coalesce(most, 0) AS max_title_repeat, coalesce(top_repeats, '') AS top_repeats, a AS "start", z AS "end", seen AS observed_days, cal AS calendar_days, missing AS missing_dates, {_R('seen::DOUBLE / cal')} AS continuity
  FROM m JOIN dl USING (topic) JOIN {_MA(7)} USING (topic) JOIN {_MA(30)} USING (topic) JOIN {_MA(90)} USING (topic) JOIN c USING (topic) JOIN ts USING (topic) LEFT JOIN t USING (topic) LEFT JOIN tr USING (topic) LEFT JOIN sl USING (topic), cal, gaps""")
def trend_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = _metrics(spark, sf_dir)
    flat = [x for w in trends.WINDOWS for x in (F.col(f"ma{w}.value").alias(f"ma{w}"), F.col(f"ma{w}.observed_days").alias(f"ma{w}_days"), *(F.col(f"ma{w}.{k}").alias(f"ma{w}_{k}") for k in ("coverage", "truncated", "sufficient")))]
    return m.select(
        "topic", "occurrences", "unique_items", "unique_titles", "active_days", "active_day_rate", F.array_join(F.transform("daily", lambda d: F.concat_ws(":", d["day"], d["n"], d["unique_items"])), ",").alias("daily"), *flat, "slope", "r2", "points",
        "distinct_sources", "hhi", "effective_sources", F.array_join(F.transform("top_sources", lambda x: F.concat_ws(":", x["source"], x["count"])), ",").alias("top_sources"), "duplicate_title_ratio", "repeated_title_groups", "cross_source_repeat_groups", "max_title_repeat",
        F.array_join(F.transform("top_repeats", lambda x: F.concat_ws(":", x["count"], x["distinct_sources"], F.size(x["dates"]), F.array_join(x["sources"], "+"), F.md5(x["title"].cast("binary")))), ",").alias("top_repeats"),
        "start", "end", "observed_days", "calendar_days", _days(F.col("missing_dates")).alias("missing_dates"), "continuity",
    )


_NAMES = " UNION ALL ".join(f"SELECT '{k}' AS topic" for k in TOPICS)


@query(f"""WITH {_DATED}, {_ALL}, {_CAL}, names AS ({_NAMES}),
g AS (SELECT topic, day, CASE WHEN day IN (SELECT day FROM i) THEN coalesce(n, 0) END AS n, CASE WHEN day IN (SELECT day FROM i) THEN coalesce(u, 0) END AS u FROM names CROSS JOIN axis LEFT JOIN d USING (topic, day)),
s AS (SELECT topic, string_agg(coalesce(n::VARCHAR, '-'), ',' ORDER BY day) AS occurrence_series, string_agg(coalesce(u::VARCHAR, '-'), ',' ORDER BY day) AS unique_series FROM g GROUP BY topic),
k AS (SELECT topic, n, row_number() OVER (PARTITION BY topic ORDER BY day DESC) AS r FROM g WHERE n IS NOT NULL),
w AS (SELECT topic, sum(n) FILTER (r <= 7) AS recent, sum(n) FILTER (r BETWEEN 8 AND 14) AS before, count(*) >= 14 AS enough, count(*) AS seen_days FROM k GROUP BY topic)
SELECT topic, coalesce(o, 0) AS occurrences, o IS NOT NULL AS present, occurrence_series, unique_series, CASE WHEN enough THEN recent::BIGINT END AS recent_sum, CASE WHEN enough THEN before::BIGINT END AS previous_sum, CASE WHEN enough AND before > 0 THEN {_R('(recent - before)::DOUBLE / before')} END AS change_rate,
  enough AS sufficient, hhi FROM names LEFT JOIN (SELECT topic, count(*) AS o FROM h GROUP BY topic) USING (topic) JOIN s USING (topic) JOIN w USING (topic) LEFT JOIN (SELECT topic, {_R('sum(n * n)::DOUBLE / (sum(n) * sum(n))')} AS hhi FROM (SELECT topic, source, count(*) AS n FROM h GROUP BY ALL) GROUP BY topic) USING (topic)""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic, the absent one too, over the whole calendar; `-` where nothing is known."""
    m, items = _metrics(spark, sf_dir)
    names = spark.createDataFrame([(k,) for k in TOPICS], "topic string")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")
    return trends.timeline(m, names, items).select(
        "topic", "occurrences", "present", text("occurrence_series").alias("occurrence_series"), text("unique_series").alias("unique_series"), "delta.recent_sum", "delta.previous_sum", "delta.change_rate", "delta.sufficient", "hhi",
    )


@query(f"WITH {_DATED}, {_ALL}, {_CAL} SELECT axis.day, n IS NOT NULL AS observed, n AS items FROM axis LEFT JOIN (SELECT day, count(*) AS n FROM i GROUP BY day) x ON x.day = axis.day")
def timeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.totals(_dated(spark, sf_dir))
