"""The queries by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import half_up, host, ingest_url, norm_title, page_heading, page_title, tokens, topic_url, word_overlap
from tidemark.operators import dynamic, feedback, health, likeness, merge, rules, series, topics, validation
from tidemark.streaming import feedback as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Topics that occur in the tables' four languages.
LEXICON = {"determiners": ("the", "der", "les"), "licences": ("license", "licensed"), "relatives": ("que", "which", "this"), "prepositions": ("pour", "para", "für", "with")}


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as dated items: day and the MD5 sum of the whole text, by which equal items are known."""
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"), F.md5(F.col("text").cast("binary")).alias("item"))


def _daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


_ITEMS = "(SELECT doc_id, text, lang, source, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS day, md5(text) AS item FROM documents)"
_DAILY = "(SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)"
_R = lambda x, k=4: f"(CAST(floor(({x}) * 1e{k} + 0.5) AS DOUBLE) / 1e{k})"
_HITS = "(" + " UNION ALL ".join(f"SELECT '{k}' AS topic, * FROM {_ITEMS} WHERE regexp_matches(lower(text), '{topics.pattern(t)}')" for k, t in LEXICON.items()) + ")"


@query(f"SELECT topic, day, count(*) AS occurrences, count(DISTINCT item) AS unique_items FROM {_HITS} GROUP BY ALL")
def topic_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.daily_counts(topics.matched(_items(spark, sf_dir), "text", LEXICON), "day", "item")


@query(f"SELECT topic, occurrences, unique_items, active_days, {_R('CAST(active_days AS DOUBLE) / n_days')} AS active_day_rate FROM (SELECT topic, count(*) AS occurrences, count(DISTINCT item) AS unique_items, count(DISTINCT day) AS active_days FROM {_HITS} GROUP BY topic), (SELECT count(DISTINCT day) AS n_days FROM {_ITEMS})")
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return topics.totals(topics.matched(items, "text", LEXICON), "day", "item", items.agg(F.count_distinct("day").alias("n_days")))


@query(f"SELECT topic, day, observed, CASE WHEN observed THEN coalesce(n, 0) END AS n FROM (SELECT DISTINCT event_type AS topic FROM events) CROSS JOIN (SELECT CAST(d AS DATE) AS day, CAST(d AS DATE) IN (SELECT CAST(ts AS DATE) FROM events) AS observed FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events)) LEFT JOIN (SELECT event_type AS topic, day, n FROM {_DAILY}) USING (topic, day)")
def daily_event_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _daily_events(spark, sf_dir).withColumnRenamed("event_type", "topic")
    return series.on_axis(counts, "topic", "n", series.calendar(counts.select("day"), "day"))


@query(f"SELECT lang, count(*) AS sources, {_R('sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE)')} AS hhi, {_R('CAST(sum(n) * sum(n) AS DOUBLE) / sum(n * n)')} AS effective_sources FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def source_concentration_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.concentration(_read(spark, sf_dir, "documents"), "lang", "source")


@query(f"SELECT lang, source, n, {_R('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY lang)')} AS share, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS INT) AS rank FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) QUALIFY rank <= 5")
def top_sources_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.top_sources(_read(spark, sf_dir, "documents"), "lang", "source", 5)


@query(f"SELECT key, n, sources, days, {_R('CAST(n AS DOUBLE) / days')} AS density, CASE WHEN {_R('CAST(n AS DOUBLE) / days')} >= 2 AND sources >= 3 THEN 'syndicated' WHEN {_R('CAST(n AS DOUBLE) / days')} >= 1.2 THEN 'mixed' ELSE 'organic' END AS call FROM (SELECT CASE WHEN t = '' THEN '' ELSE md5(t) END AS key, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT day) AS days FROM (SELECT source, day, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM {_ITEMS}) GROUP BY 1) WHERE key <> '' AND n > 1")
def repeat_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = norm_title(F.col("text"))
    return topics.repeats(_items(spark, sf_dir), F.when(normal == "", "").otherwise(F.md5(normal.cast("binary"))), "source", "day")


@query(f"SELECT event_type, day, {_R('CAST(sum(n) OVER w AS DOUBLE) / count(*) OVER w')} AS average, count(*) OVER w AS active_days, {_R('CAST(count(*) OVER w AS DOUBLE) / 7')} AS coverage, CAST(count(*) OVER w AS DOUBLE) / 7 >= 0.6 AS sufficient FROM {_DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)")
def moving_average_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_average(_daily_events(spark, sf_dir), "event_type", "n", 7)


@query(f"SELECT event_type, day, {_R('CAST(sum(n) OVER w AS DOUBLE) / count(*) OVER w')} AS average, count(*) OVER w AS active_days, {_R('CAST(count(*) OVER w AS DOUBLE) / 30')} AS coverage, CAST(count(*) OVER w AS DOUBLE) / 30 >= 0.6 AS sufficient FROM {_DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)")
def moving_average_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_average(_daily_events(spark, sf_dir), "event_type", "n", 30)


@query(f"SELECT event_type, day, {_R('CAST(sum(n) OVER w AS DOUBLE) / count(*) OVER w')} AS average, count(*) OVER w AS active_days, {_R('CAST(count(*) OVER w AS DOUBLE) / 90')} AS coverage, CAST(count(*) OVER w AS DOUBLE) / 90 >= 0.6 AS sufficient FROM {_DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)")
def moving_average_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_average(_daily_events(spark, sf_dir), "event_type", "n", 90)


@query(f"SELECT event_type, count(*) AS points, CASE WHEN count(*) >= 3 THEN {_R('regr_slope(y, x)')} END AS slope, CASE WHEN count(*) >= 3 THEN {_R('regr_r2(y, x)')} END AS r2 FROM (SELECT event_type, CAST(n AS DOUBLE) AS y, CAST(day - (SELECT max(day) FROM {_DAILY}) + 29 AS DOUBLE) AS x FROM {_DAILY}) WHERE x >= 0 GROUP BY event_type")
def trend_slope_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _daily_events(spark, sf_dir)
    return series.slope(counts, "event_type", "n", 30, counts.agg(F.max("day").alias("last_day")))


@query(f"SELECT event_type, recent, previous, c >= 14 AS sufficient, CASE WHEN c >= 14 AND previous > 0 THEN {_R('CAST(recent - previous AS DOUBLE) / previous')} END AS rate FROM (SELECT event_type, CAST(coalesce(sum(n) FILTER (r <= 7), 0) AS BIGINT) AS recent, CAST(coalesce(sum(n) FILTER (r > 7 AND r <= 14), 0) AS BIGINT) AS previous, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM {_DAILY}) GROUP BY event_type)")
def window_delta_7v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.change(_daily_events(spark, sf_dir), "event_type", "n")


@query("WITH s AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS total FROM orders GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY total DESC, o_orderpriority) AS INT) AS rank FROM s) SELECT *, CAST(lag(rank) OVER (PARTITION BY o_orderpriority ORDER BY month) - rank AS INT) AS moved FROM r")
def monthly_rank_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.monthly_rank(_read(spark, sf_dir, "orders").withColumn("one", F.lit(1)), "o_orderpriority", "o_orderdate", "one")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_rating_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.latest(_read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(f"SELECT source, count(*) AS ratings, {_R('sum(w * s) / sum(w)')} AS score FROM (SELECT source, power(CAST(0.5 AS DOUBLE), CAST(29 - doc_id % 30 AS DOUBLE) / 30) AS w, CAST(CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def decayed_rating_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _read(spark, sf_dir, "documents").select("doc_id", "source").join(_read(spark, sf_dir, "labels"), "doc_id")
    score = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    return feedback.decayed_score(rated, "source", score, (29 - F.col("doc_id") % 30).cast("double"))


@query(f"SELECT user_id, accepted, corrected, {_R('greatest(0.5, least(1.5, 1 + CAST(0.1 AS DOUBLE) * (accepted - corrected)))')} AS weight, CASE WHEN accepted > corrected THEN 'up' WHEN accepted < corrected THEN 'down' ELSE 'neutral' END AS direction FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS corrected FROM events GROUP BY user_id)")
def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.weights(_read(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


@query(f"WITH n AS (SELECT event_type, CAST(ts AS DATE) AS night, avg(CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY night DESC) AS r FROM n), o AS (SELECT event_type, avg(rate) FILTER (r <= 3) AS o, median(rate) FILTER (r > 3 AND r <= 10) AS b, count(*) AS n FROM r GROUP BY event_type) SELECT event_type, {_R('b')} AS baseline, {_R('o')} AS observed, {_R('floor((b - o) * 1e6 + 0.5) / 1e4')} AS drop_pp, CASE WHEN n < 4 THEN 'waiting' WHEN floor((b - o) * 1e6 + 0.5) / 1e4 > 10 THEN 'revert' ELSE 'confirm' END AS verdict FROM o")
def canary_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    nightly = _read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("night")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.0)).alias("rate"))
    return feedback.canary(nightly, "event_type", "night", "rate")


@query("SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3 ORDER BY n_chars DESC, doc_id LIMIT 20")
def source_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.capped(_read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 3, 20).select("doc_id", "source", "n_chars")


@query("SELECT r_name, month, count(*) AS orders, CAST(floor(sum(o_totalprice) + 0.5) AS BIGINT) AS total FROM (SELECT r_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (r_name, month)")
def month_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    all_ = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return all_.rollup("r_name", F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("orders"), F.floor(F.sum("o_totalprice") + 0.5).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def status_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_seen, max(CAST(o_orderdate AS DATE)) AS last_seen, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey")
def first_seen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


@query("WITH c AS (SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), o AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), k AS (SELECT source, count(*) AS n FROM c GROUP BY source) SELECT doc_id, source, false AS is_backfill FROM c UNION ALL SELECT doc_id, source, true FROM (SELECT o.*, row_number() OVER (PARTITION BY o.source ORDER BY doc_id) AS r, coalesce(k.n, 0) AS n FROM o LEFT JOIN k USING (source)) WHERE r <= 20 - n")
def backfill_min_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, filled up from the others to 20 a source."""
    d, rated = _read(spark, sf_dir, "documents").select("doc_id", "source"), _read(spark, sf_dir, "labels").select("doc_id")
    return merge.filled_up(d.join(rated, "doc_id", "left_semi"), d, "source", "doc_id", [F.col("doc_id")], 20)


@query("SELECT doc_id, coalesce(text, '') = '' OR text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL) AS is_new FROM documents")
def novel_items_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without text has no key and is always new."""
    key = F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(F.md5(F.col("text").cast("binary"))).alias("key")
    return merge.novel(_read(spark, sf_dir, "documents").select("doc_id", key), _read(spark, sf_dir, "benchmark").select(key), "key").select("doc_id", "is_new")


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(f"WITH d AS (SELECT page_id, list_distinct(regexp_extract_all(lower({_TITLE}), '[a-z0-9]{{3,}}')) AS t FROM pages), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS t FROM benchmark), x AS (SELECT page_id, len(d.t) AS na, unnest(d.t) AS w FROM d), y AS (SELECT item_id, len(b.t) AS nb, unnest(b.t) AS w FROM b), j AS (SELECT page_id, max(j) AS j FROM (SELECT page_id, CAST(count(*) AS DOUBLE) / (na + nb - count(*)) AS j FROM x JOIN y USING (w) GROUP BY page_id, item_id, na, nb) GROUP BY page_id) SELECT page_id, {_R('CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE 1 - coalesce(j, 0.0::DOUBLE) END')} AS novelty FROM d LEFT JOIN j USING (page_id)")
def title_jaccard_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole titles of pages against whole texts of the older corpus."""
    a = _read(spark, sf_dir, "pages").select("page_id", tokens(page_title(F.col("html"))).alias("tokens"))
    b = _read(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("tokens"))
    return likeness.novelty(a, "page_id", b, "item_id").select("page_id", half_up(F.col("n")).alias("novelty"))


@query(f"WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS t FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS t FROM benchmark), x AS (SELECT doc_id, len(d.t) AS na, unnest(d.t) AS w FROM d), y AS (SELECT item_id, len(b.t) AS nb, unnest(b.t) AS w FROM b), j AS (SELECT doc_id, max(j) AS j FROM (SELECT doc_id, CAST(count(*) AS DOUBLE) / (na + nb - count(*)) AS j FROM x JOIN y USING (w) GROUP BY doc_id, item_id, na, nb) GROUP BY doc_id) SELECT doc_id, {_R('CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE 1 - coalesce(j, 0.0::DOUBLE) END')} AS novelty FROM d LEFT JOIN j USING (doc_id)")
def document_jaccard_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents against whole texts of the older corpus."""
    a = _read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    b = _read(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("tokens"))
    return likeness.novelty(a, "doc_id", b, "item_id").select("doc_id", half_up(F.col("n")).alias("novelty"))


_PLAIN = r"""(?i)https?://[^/?#@\s<>"'\\]+([/?#][^\s<>"']*)?""".replace("'", "''")
_PARTS = r"""list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '')"""
_EACH = "CASE WHEN contains(p, '=') THEN p ELSE p || '=' END"
_URL = rf"""CASE WHEN regexp_full_match(url, '{_PLAIN}') THEN regexp_replace(regexp_replace(lower(regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1)), '^(https://.*):443$|^(http://.*):80$', '\1\2'), '://www\.', '://')
 || coalesce(nullif(regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/$', ''), ''), '/') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END"""


@query(rf"SELECT key, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, {_URL} AS key FROM (SELECT *, list_transform(list_sort(list_filter(list_transform({_PARTS}, lambda p, i: {{'name': regexp_extract(p, '^[^=]*'), 'i': i, 'p': {_EACH}}}), lambda x: NOT regexp_full_match(x.name, '(?i)(utm_.*|fbclid|gclid)'))), lambda x: x.p) AS q FROM pages)) WHERE key IS NOT NULL GROUP BY key")
def canonical_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", topic_url(F.col("url")).alias("key")).where("key is not null").groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query(rf"SELECT key, count(*) AS n, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', ''), ''), '/') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM (SELECT *, list_transform(list_filter({_PARTS}, lambda p: NOT regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|ref|source)(=|$)')), lambda p: {_EACH}) AS q FROM pages)) GROUP BY key")
def ingest_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", ingest_url(F.col("url")).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS heading FROM pages")
def page_title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", page_title(F.col("html")).alias("title"), page_heading(F.col("html")).alias("heading"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#]*@)?([^/?#:@]+)', 1)), '^www\.', '')"


@query(rf"SELECT host, count(*) AS pages, bool_or(regexp_matches(url, 'utm_')) AS tracked FROM (SELECT url, {_HOST} AS host FROM pages) WHERE host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org' GROUP BY host")
def domain_suffix_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that are a trusted domain or below one."""
    trusted = spark.range(1).select(F.explode(F.array(F.lit("example.com"), F.lit("example.org"))).alias("domain"))
    pages = _read(spark, sf_dir, "pages").select("url", host(F.col("url")).alias("host"))
    return validation.at_or_below(pages, "host", trusted).groupBy("host").agg(F.count("*").alias("pages"), F.bool_or(F.col("url").contains("utm_")).alias("tracked"))


_NORM = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_H1 = "regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')"
#: The word score of a title a and a heading b, and their distinct words x and y.
_SCORE = "CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE greatest(CASE WHEN contains(a, b) OR contains(b, a) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END, CAST(len(list_intersect(x, y)) AS DOUBLE) / greatest(len(x), len(y))) END"

_VALIDATED = rf"""(SELECT page_id, list_filter([
  CASE WHEN coalesce(trim({_TITLE}), '') = '' THEN 'Missing or invalid fields: title' END,
  CASE WHEN d IS NULL OR d = '' THEN 'Invalid date: empty_or_invalid_type' WHEN NOT regexp_full_match(d, '\d{{4}}-\d{{2}}-\d{{2}}') OR try_cast(d AS DATE) IS NULL THEN 'Invalid date: invalid_format'
    WHEN try_cast(d AS DATE) > DATE '2024-06-30' OR try_cast(d AS DATE) < DATE '2024-06-30' - 90 THEN 'Invalid date: date_out_of_range' END,
  CASE WHEN url IS NOT NULL AND (NOT regexp_full_match(url, '(?i)https?://[^/?#@\s]+([/?#].*)?') OR regexp_matches(url, '[\s\x00-\x1f]')) THEN 'Invalid URL' END,
  CASE WHEN NOT ({_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.org') THEN 'Non-official source' END], lambda x: x IS NOT NULL) AS issues,
  CASE WHEN {_SCORE} >= 0.3 THEN 'verified' WHEN {_SCORE} > 0 THEN 'title_low_match' ELSE 'title_mismatch' END AS status
  FROM (SELECT *, list_filter(list_distinct(string_split(a, ' ')), lambda w: w <> '') AS x, list_filter(list_distinct(string_split(b, ' ')), lambda w: w <> '') AS y FROM (SELECT *, {_NORM(_TITLE)} AS a, {_NORM(_H1)} AS b, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '2024-13-01' ELSE CAST(CAST(DATE '2024-03-01' + CAST(page_id % 150 AS INT) AS DATE) AS VARCHAR) END AS d FROM pages)))"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as items: a title, a date made from page_id (some null, some impossible), an address, a host of a trusted domain."""
    pages = _read(spark, sf_dir, "pages").withColumns({"title": page_title(F.col("html")), "host": host(F.col("url"))})
    day = F.date_add(F.lit("2024-03-01").cast("date"), (F.col("page_id") % 150).cast("int")).cast("string")
    pages = pages.withColumn("date", F.when(F.col("page_id") % 11 != 0, F.when(F.col("page_id") % 7 == 0, "2024-13-01").otherwise(day)))
    fields = validation.missing({"title": validation.filled(F.col("title"))})
    bad_date = validation.date_problem(F.col("date"), F.lit("2024-06-30").cast("date"))
    official = (F.col("host") == "example.com") | F.col("host").endswith(".example.com") | F.col("host").endswith(".example.org")
    found = [F.when(F.size(fields) > 0, F.concat(F.lit("Missing or invalid fields: "), F.array_join(fields, ", "))), F.concat(F.lit("Invalid date: "), bad_date), validation.url_issue(F.col("url")), F.when(~official, "Non-official source")]
    score = word_overlap(F.coalesce("title", F.lit("")), F.coalesce(page_heading(F.col("html")), F.lit("")))
    return validation.issues(pages, found).withColumn("status", validation.title_status(score))


@query(f"SELECT page_id, array_to_string(issues, '; ') AS issues, status FROM {_VALIDATED}")
def validated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("page_id", F.array_join("issues", "; ").alias("issues"), "status")


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT r AND status = 'verified') AS verified, count(*) FILTER (NOT r AND status <> 'verified') AS needs_review, count(*) FILTER (r OR status <> 'verified') AS warnings, count(*) FILTER (r) AS removed, round_even(count(*) FILTER (NOT r AND status = 'verified') / count(*) * 100, 2) AS pass_rate FROM (SELECT *, len(issues) > 0 OR status = 'title_mismatch' AS r FROM {_VALIDATED})")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summary(_validated(spark, sf_dir))


_NIGHTS = f"(SELECT event_type, day, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY day) AS rate FROM {_DAILY})"


def _nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event type and day the number of events and their share of the day's."""
    daily = _daily_events(spark, sf_dir)
    whole = daily.groupBy("day").agg(F.sum("n").alias("all"))
    return daily.join(whole, "day").select("event_type", "day", "n", (F.col("n").cast("double") / F.col("all")).alias("rate"))


@query(f"SELECT event_type, {_R('median(rate)')} AS baseline, count(*) AS nights FROM (SELECT * FROM {_NIGHTS} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 7) GROUP BY event_type")
def nightly_median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.nightly_baseline(_nights(spark, sf_dir), "event_type", "day", "rate")


@query(f"WITH m AS (SELECT event_type, median(rate) AS med, count(*) AS c FROM {_NIGHTS} GROUP BY event_type), l AS (SELECT event_type, max(rate) AS high, count(*) AS two FROM (SELECT * FROM {_NIGHTS} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 2) GROUP BY event_type), b AS (SELECT event_type, c >= 2 AND two = 2 AND high <= med - 0.002 AS low FROM m JOIN l USING (event_type)) SELECT event_type, low, low AND (SELECT count(*) FROM b WHERE NOT low) >= 2 AS isolated FROM b")
def sustained_low_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = health.sustained_low(_nights(spark, sf_dir), "event_type", "day", "rate", "n", 0.002)
    return health.isolated(low, "low", 2)


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS ok FROM orders), l AS (SELECT o_custkey, max(o_orderkey) FILTER (ok) AS last FROM o GROUP BY o_custkey) SELECT o_custkey, count(*) FILTER ((last IS NULL OR o_orderkey > last) AND NOT ok) AS failures FROM o JOIN l USING (o_custkey) GROUP BY o_custkey")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("ok"))
    return health.failure_streak(runs, "o_custkey", "o_orderkey", "ok")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'missing' ELSE 'stale' END"


@query(f"SELECT o_custkey, CASE WHEN bool_and(s = 'missing') THEN 'missing' WHEN bool_or(s NOT IN ('available', 'missing')) THEN 'invalid' WHEN bool_or(s = 'missing') THEN 'degraded' ELSE 'available' END AS health FROM (SELECT o_custkey, {_STATUS} AS s FROM orders) GROUP BY o_custkey")
def group_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.group_health(_read(spark, sf_dir, "orders").select("o_custkey", F.expr(_STATUS).alias("s")), "o_custkey", "s")


@query(f"SELECT k.s, coalesce(n, 0) AS n FROM (SELECT unnest(['available', 'missing', 'stale', 'blocked']) AS s) k LEFT JOIN (SELECT {_STATUS} AS s, count(*) AS n FROM orders GROUP BY 1) USING (s)")
def status_counts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.status_counts(_read(spark, sf_dir, "orders").select(F.expr(_STATUS).alias("s")), "s", ("available", "missing", "stale", "blocked"))


@query("WITH g AS (SELECT l_suppkey, count(*) FILTER (l_linenumber = 1) AS a, count(*) FILTER (l_linenumber <= 2) AS b, count(*) FILTER (l_linenumber <= 3) AS c, least(2, count(*)) AS need FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CASE WHEN a >= need THEN 'E1' WHEN b >= need THEN 'E2' WHEN c >= need THEN 'E3' ELSE 'E4' END AS grade FROM g")
def evidence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _read(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.lit("E"), F.least(F.col("l_linenumber"), F.lit(4)).cast("string")).alias("g"))
    return health.evidence_grade(graded, "l_suppkey", "g")


@query("SELECT p_partkey, CASE WHEN p_size <= 2 THEN 'insufficient' WHEN ma7 > ma30 AND ma30 > ma90 AND slope > 0 AND signal >= 0.7 AND breadth >= 0.5 AND dur >= 0.3 AND eff >= 5 THEN 'accelerating' WHEN ma7 >= 1.3 * ma30 AND slope > 0 AND (dur < 0.5 OR ma90 IS NULL) THEN 'emerging' WHEN ma7 < ma30 AND slope < 0 THEN 'declining' ELSE 'plateau' END AS stage, signal, breadth, dur AS durability FROM (SELECT *, CASE WHEN slope > 0 AND r2 >= 0.5 AND ma7 >= 1.3 * ma30 THEN 0.8 WHEN abs(slope) < 0.05 THEN 0.3 WHEN slope > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS signal, CASE WHEN eff >= 40 THEN 0.8 WHEN eff >= 15 THEN 0.5 WHEN eff >= 5 THEN 0.2 ELSE 0.0 END::DOUBLE AS breadth, CASE WHEN ma90 IS NULL OR ma90 = 0 OR occ < 200 THEN 0.0 WHEN ma30 / ma90 >= 0.9 AND occ >= 1000 THEN 0.8 WHEN ma30 / ma90 >= 0.7 THEN 0.5 WHEN ma30 / ma90 >= 0.5 THEN 0.3 ELSE 0.0 END::DOUBLE AS dur FROM (SELECT p_partkey, p_size, p_partkey % 13 + 0.5::DOUBLE AS ma7, p_partkey % 11 + 0.5::DOUBLE AS ma30, CASE WHEN p_partkey % 17 > 0 THEN p_partkey % 9 + 0.5::DOUBLE END AS ma90, (p_partkey % 7 - 3) / 10.0::DOUBLE AS slope, p_partkey % 10 / 10.0::DOUBLE AS r2, p_size::DOUBLE AS eff, p_partkey * 3 AS occ FROM part))")
def stage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule tables over measures made from the part keys."""
    k = F.col("p_partkey")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size", (k % 13 + 0.5).alias("ma7"), (k % 11 + 0.5).alias("ma30"), F.when(k % 17 > 0, k % 9 + 0.5).alias("ma90"), ((k % 7 - 3) / 10.0).alias("slope"), (k % 10 / 10.0).alias("r2"), F.col("p_size").cast("double").alias("eff"), (k * 3).alias("occ"))
    c = F.col
    p = p.withColumns({"signal": rules.signal_strength(c("slope"), c("r2"), c("ma7"), c("ma30")), "breadth": rules.source_breadth(c("eff")), "durability": rules.durability(c("ma30"), c("ma90"), c("occ"))})
    stage = rules.stage(c("p_size") > 2, c("ma7"), c("ma30"), c("ma90"), c("slope"), c("signal"), c("breadth"), c("durability"), c("eff"), F.lit("organic"))
    return p.select("p_partkey", stage.alias("stage"), "signal", "breadth", "durability")


@query("SELECT event_id, v, metric, m FROM (SELECT event_id, value AS v FROM events WHERE event_type = 'purchase') e JOIN (SELECT user_id AS metric, CASE WHEN max(abs(value)) < 1e9 THEN CAST(sum(CASE WHEN abs(value) < 1e9 THEN CAST(floor(value * 1e6 + 0.5) AS BIGINT) END) AS DOUBLE) / count(value) / 1e6 ELSE avg(value) END AS m FROM events GROUP BY user_id) u ON abs(v - m) < 0.05")
def evidence_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values near a user's mean. The mean is that of the values at six places, summed as whole numbers, since a sum of doubles differs with the order of rows (values of 1e9 and more keep it)."""
    e = _read(spark, sf_dir, "events")
    numbers = e.where("event_type = 'purchase'").select("event_id", F.col("value").alias("v"))
    small = F.abs("value") < 1e9
    units = F.sum(F.when(small, F.floor(F.col("value") * 1e6 + 0.5).cast("decimal(20,0)"))).cast("double")
    mean = F.when(F.max(F.abs("value")) < 1e9, units / F.count("value") / 1e6).otherwise(F.avg("value"))
    return merge.band_pairs(numbers, e.groupBy(F.col("user_id").alias("metric")).agg(mean.alias("m")), 0.05).select("event_id", "v", "metric", "m")


@query("WITH v AS (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS a, max(event_id) FILTER (event_type = 'click') AS b, max(event_id) FILTER (event_type = 'error') AS t FROM events GROUP BY user_id) SELECT user_id, greatest(coalesce(a, b), coalesce(b, a)) AS stamp, CASE WHEN a IS NULL OR b > a THEN 'click' ELSE 'view' END AS kind FROM v WHERE (a IS NOT NULL OR b IS NOT NULL) AND (t IS NULL OR t < greatest(coalesce(a, b), coalesce(b, a)))")
def lww_tombstone_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    last = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias(name)).withColumn("kind", F.lit(kind))
    return merge.without_deleted(merge.newest_wins(last("view", "stamp"), last("click", "stamp"), "user_id", "stamp", "kind"), last("error", "deleted"), "user_id", "stamp", "deleted")


@query(f"WITH t AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(lower({_TITLE}), '[a-z0-9]{{3,}}'))) AS w FROM pages) SELECT x.w AS a, y.w AS b, count(DISTINCT page_id) AS items FROM t x JOIN t y USING (page_id) WHERE x.w < y.w GROUP BY ALL HAVING count(DISTINCT page_id) >= 5")
def token_pair_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of whole page titles."""
    return topics.pairs(_read(spark, sf_dir, "pages"), "page_id", tokens(page_title(F.col("html"))), 5)


@query(f"SELECT k.event_type, coalesce(c.items, 0) AS items, coalesce({_R('CAST(c.high AS DOUBLE) / c.items')}, 0.0::DOUBLE) AS high_rate FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'absent']) AS event_type) k LEFT JOIN (SELECT event_type, count(*) AS items, count(*) FILTER (value > 50) AS high FROM events GROUP BY event_type) c USING (event_type)")
def category_metrics_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view", "absent")))).alias("event_type"))
    own = _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("items"), F.count_if(F.col("value") > 50).alias("high"))
    rate = F.coalesce(half_up(F.col("high").cast("double") / F.col("items")), F.lit(0.0))
    return kinds.join(own, "event_type", "left").select("event_type", F.coalesce("items", F.lit(0)).alias("items"), rate.alias("high_rate"))


@query(f"WITH l AS (SELECT max(day) AS last FROM {_DAILY}), g AS (SELECT event_type, avg(n) FILTER (day > last - 7) / nullif(avg(n), 0) AS r FROM {_DAILY}, l WHERE day > last - 30 GROUP BY 1), c AS (SELECT avg(n) FILTER (day > last - 7) / avg(n) AS a FROM (SELECT day, sum(n) AS n FROM {_DAILY} GROUP BY 1), l WHERE day > last - 30) SELECT event_type, {_R('r')} AS ratio, {_R('r / a - 1')} AS relative FROM g, c")
def relative_to_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days over thirty, as the events span thirty days."""
    return series.relative(_daily_events(spark, sf_dir), "event_type", "n", 7, 30)


_SCORED = f"""WITH i AS (SELECT topic, item, count(*) AS n, bool_or(day > DATE '2024-01-20') AS fresh, count(*) FILTER (contains(lower(text), 'price')) AS f, count(*) FILTER (source LIKE '%1') AS q FROM {_HITS} GROUP BY ALL),
s AS (SELECT topic, sum(n) AS total, count(*) AS items, count(*) FILTER (fresh) AS fresh, sum(f) AS f, sum(q) AS q FROM i GROUP BY topic),
a AS (SELECT topic, count(DISTINCT day) AS active FROM {_HITS} GROUP BY topic), d AS (SELECT count(DISTINCT day) AS days FROM {_ITEMS}),
p AS (SELECT topic, CAST(total AS BIGINT) AS total, items, {_R('least(1.0::DOUBLE, CAST(total AS DOUBLE) / 100)', 3)} AS relevance, {_R('CAST(active AS DOUBLE) / days', 3)} AS recency, {_R('CAST(fresh AS DOUBLE) / items', 3)} AS novelty,
  {_R('0.7::DOUBLE * 0.3::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, (CAST(f AS DOUBLE) / total) / 0.25::DOUBLE)', 3)} AS financial_relevance, {_R('CAST(q AS DOUBLE) / total', 3)} AS evidence_quality, 1.0::DOUBLE AS topic_weight FROM s JOIN a USING (topic), d)
SELECT *, {_R('relevance * 0.2::DOUBLE + recency * 0.2::DOUBLE + novelty * 0.15::DOUBLE + financial_relevance * 0.2::DOUBLE + evidence_quality * 0.15::DOUBLE + topic_weight * 0.1::DOUBLE', 3)} AS score FROM p"""


@query(_SCORED)
def weighted_topic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    hits = topics.matched(items, "text", LEXICON)
    days = items.agg(F.count_distinct("day").alias("n_days"))
    return topics.scored(hits, "item", "day", F.col("day") > F.lit("2024-01-20").cast("date"), F.contains(F.lower("text"), F.lit("price")), F.col("source").endswith("1"), days, 100)


@query("WITH r AS (SELECT *, value > 50 AS fit FROM events), g AS (SELECT * FROM r WHERE fit QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3), t AS (SELECT event_id FROM g ORDER BY value DESC, event_id LIMIT 10) SELECT event_id, event_type, CASE WHEN NOT coalesce(fit, false) THEN 'ineligible' WHEN event_id IN (FROM t) THEN 'chosen' WHEN event_id IN (SELECT event_id FROM g) THEN 'total_cap' ELSE 'group_cap' END AS outcome FROM r")
def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return feedback.allocated(e, "event_id", "event_type", F.col("value") > 50, [F.desc("value"), F.col("event_id")], 3, 10).select("event_id", "event_type", "outcome")




@query(f"""WITH t AS (SELECT page_id, {_NORM(_TITLE)} AS a, {_NORM(_H1)} AS b FROM pages), w AS (SELECT *, list_filter(list_distinct(string_split(a, ' ')), lambda x: x <> '') AS x, list_filter(list_distinct(string_split(b, ' ')), lambda x: x <> '') AS y FROM t)
SELECT page_id, {_R("CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE greatest(CASE WHEN contains(a, b) OR contains(b, a) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END, CAST(len(list_intersect(x, y)) AS DOUBLE) / greatest(len(x), len(y))) END")} AS score FROM w""")
def title_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each page against its heading."""
    return _read(spark, sf_dir, "pages").select("page_id", half_up(word_overlap(page_title(F.col("html")), page_heading(F.col("html")))).alias("score"))


@query("""WITH o AS (SELECT *, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(o_custkey AS VARCHAR) || lower(o_orderpriority) AS k FROM orders),
w AS (SELECT * FROM o WHERE date BETWEEN '1995-01-01' AND '1995-12-31'),
c AS (SELECT * FROM w WHERE o_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) = 1),
h AS (SELECT * FROM w WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) = 1)
SELECT coalesce(c.o_orderkey, h.o_orderkey) AS o_orderkey, coalesce(c.date, h.date) AS date, CASE WHEN c.o_orderkey % 3 = 0 THEN h.o_totalprice WHEN c.k IS NOT NULL THEN c.o_totalprice ELSE h.o_totalprice END AS o_totalprice,
  c.k IS NOT NULL AND h.k IS NULL AS is_new, coalesce(CASE WHEN h.o_orderkey % 5 > 0 THEN h.date END, '1996-01-01') AS first_seen, CASE WHEN c.k IS NOT NULL OR h.o_orderkey % 5 = 0 THEN '1996-01-01' ELSE h.date END AS last_seen
FROM c FULL JOIN h ON c.k = h.k ORDER BY 2 DESC, c.k IS NULL, 1 LIMIT 200""")
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd orders as fetched items, even ones as the history; some fetched prices are missing and come from there."""
    odd = F.col("o_orderkey") % 2 == 1
    seen = F.when(~odd & (F.col("o_orderkey") % 5 > 0), F.to_date("o_orderdate").cast("string"))
    price = F.when(~(odd & (F.col("o_orderkey") % 3 == 0)), F.col("o_totalprice"))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("seq"), "o_custkey", "o_orderpriority", F.to_date("o_orderdate").cast("string").alias("date"), price.alias("o_totalprice"), seen.alias("first_seen"), seen.alias("last_seen"))
    key = merge.item_key(F.lit(""), F.col("o_custkey"), F.col("o_orderpriority"))
    rows = merge.with_history(o.where("seq % 2 = 1"), o.where("seq % 2 = 0"), key, "date", "1995-01-01", "1995-12-31", "1996-01-01", 200)
    return rows.select("o_orderkey", "date", "o_totalprice", "is_new", "first_seen", "last_seen")


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 > 0) SELECT o_orderkey, f.l_orderkey IS NOT NULL AS answered, coalesce(f.l_quantity, 0.0)::DOUBLE AS l_quantity FROM orders LEFT JOIN (FROM a QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) = 1) f ON o_orderkey = l_orderkey")
def answers_to_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its first line as the answer, some orders without any."""
    lines = _read(spark, sf_dir, "lineitem").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_quantity").alias("order"), F.col("l_quantity").cast("double").alias("l_quantity"))
    return merge.answered(_read(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "order", {"l_quantity": 0.0})


def _page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 14).cast("int"))
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), day.alias("day"), host(F.col("url")).alias("host"), tokens(page_title(F.col("html"))).alias("terms"))


@query(f"""WITH i AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 14 AS INT) AS DATE) AS day, {_HOST} AS host, list_sort(list_distinct(regexp_extract_all(lower({_TITLE}), '[a-z0-9]{{3,}}')))[:36] AS t FROM pages),
u AS (SELECT page_id, day, host, unnest(t) AS w FROM i), p AS (SELECT x.w AS a, y.w AS b, x.day, x.host, x.day >= DATE '2024-01-08' AS now FROM u x JOIN u y USING (page_id) WHERE x.w < y.w),
g AS (SELECT a, b, count(*) FILTER (now) AS recent, count(*) FILTER (NOT now) AS previous, count(DISTINCT host) FILTER (now) AS sources, max(day) AS latest, bool_or(day >= DATE '2024-01-13') AS fresh FROM p GROUP BY a, b HAVING count(*) >= 2),
k AS (SELECT count(DISTINCT day) = 14 AS whole FROM i)
SELECT a, b, recent, previous, sources, latest, CASE WHEN NOT whole THEN 'focus' WHEN previous = 0 THEN 'new' WHEN recent < previous THEN 'declining' ELSE 'persistent' END AS status, CAST(recent + 1.5 * sources + CASE WHEN fresh THEN 2 ELSE 0 END AS DOUBLE) AS score FROM g, k""")
def dynamic_topic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _page_items(spark, sf_dir)
    return dynamic.candidates(items, items, "2024-01-14")


@query()
def dynamic_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice in rounds, which SQL can't express."""
    items = _page_items(spark, sf_dir)
    return dynamic.selected(dynamic.candidates(items, items, "2024-01-14"), items, "2024-01-14")


@query("WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY total DESC, o_custkey) AS rank FROM m) SELECT o_custkey, CAST(arg_min(rank, month) AS INT) AS first_rank, CAST(arg_max(rank, month) AS INT) AS last_rank, CAST(arg_min(rank, month) - arg_max(rank, month) AS INT) AS won FROM r GROUP BY o_custkey")
def rank_first_to_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.month_change(series.monthly_rank(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice"), "o_custkey")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream reads folders or patterns


@query(_DAILY[1:-1])
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form; the SQL is that of the batch."""
    return streams.completed(streams.daily_counts(_event_stream(spark, sf_dir), "ts", "event_type"), streams.own_folder(spark))


@query("SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def stream_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    return streams.completed(streams.latest(e, "user_id", "ts", "event_id"), streams.own_folder(spark))
