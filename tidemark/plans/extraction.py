"""Queries that take data out of text: pages as feeds, events as answers with JSON in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import page_title
from tidemark.operators import extraction
from tidemark.plans.catalog import _TITLE, _read, query
from tidemark.sources import feeds

_ANSWER = """CASE event_id % 6 WHEN 0 THEN '{"items": [' || props || ']}' WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '{"note": "a } within", "items": [' || props || ', ' || props || ']}' || chr(10) || '```'
  WHEN 2 THEN '[' || props || ', ' || props || ', 3]' WHEN 3 THEN 'API Error: ' || event_type WHEN 4 THEN '{"items": "none"} ' || props ELSE 'first {"items": []} then "{" and {"items": [' || props || ']} at last' END"""


@query("""SELECT event_type, strategy, count(*) AS answers, CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (failed <> '') AS failed, min(failed) AS failure FROM (SELECT event_type,
  CASE event_id % 6 WHEN 2 THEN 3 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS strategy, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 5 THEN 1 ELSE 0 END AS items, CASE WHEN event_id % 6 = 3 THEN 'API Error: ' || event_type ELSE '' END AS failed FROM events) GROUP BY ALL""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the items of answers, which carry the events' properties, are found, by kind of event."""
    own = _read(spark, sf_dir, "events").select("event_type", F.expr(_ANSWER).alias("raw"))
    own = own.select("event_type", extraction.json_items(F.col("raw")).alias("x"), extraction.no_answer(F.col("raw")).alias("failed"))
    return own.groupBy("event_type", F.col("x.strategy").alias("strategy")).agg(F.count("*").alias("answers"), F.sum(F.size("x.items").cast("long")).alias("items"), F.count_if(F.col("failed") != "").alias("failed"), F.min("failed").alias("failure"))


@query("""SELECT event_id, '{"a":[' || k || ',{"type":"' || event_type || '"}],"k":' || k || ',"z":null}' AS canonical, sha256('{"a":[' || k || ',{"type":"' || event_type || '"}],"k":' || k || ',"z":null}' || chr(10)) AS id, true AS same FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal properties with keys in two orders have one canonical text and one id."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    one = F.concat(F.lit('{"z": null, "k": '), k, F.lit(', "a": ['), k, F.lit('.0, {"type": "'), "event_type", F.lit('"}]}'))
    two = F.concat(F.lit('{"a":['), k, F.lit(',{"type":"'), "event_type", F.lit('"}],"z":null,"k":'), k, F.lit("}"))
    own = _read(spark, sf_dir, "events").select("event_id", extraction.canonical(one).alias("canonical"), extraction.content_id(one).alias("id"), extraction.content_id(two).alias("other"))
    return own.select("event_id", "canonical", "id", (F.col("id") == F.col("other")).alias("same"))


_CLEAN = f"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT page_id, 'atom' AS format, 0 AS place, {_CLEAN} AS title, url AS link, TIMESTAMP '2024-01-02 03:04:05' AS published_at FROM pages WHERE page_id % 3 = 0 AND {_CLEAN} <> ''
UNION ALL SELECT page_id, 'rss', 0, {_CLEAN}, url, TIMESTAMP '2024-02-0' || (1 + page_id % 5) || ' 08:00:00' FROM pages WHERE page_id % 3 = 1 AND {_CLEAN} <> '' UNION ALL SELECT page_id, 'rss', 1, 'Wörter & mehr', 'no' || page_id, NULL FROM pages WHERE page_id % 3 = 1""".replace("TIMESTAMP '2024-02-0' || (1 + page_id % 5) || ' 08:00:00'", "CAST('2024-02-0' || (1 + page_id % 5) || ' 08:00:00' AS TIMESTAMP)"))
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a feed of its title and address: Atom, RSS, or none at all."""
    title, k = page_title(F.col("html")), F.col("page_id") % 3
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    atom = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="a"><entry><title type="html">'), title, F.lit('</title><link rel="self" href="self"/><link rel="alternate" href="'), url, F.lit('"/><published>2024-01-02T03:04:05Z</published></entry></feed>'))
    rss = F.concat(F.lit("<rss><channel><title>all</title><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><pubDate>Mon, "), F.col("page_id") % 5 + 1, F.lit(" Feb 2024 10:00:00 +0200</pubDate></item><item><title>W&#xF6;rter &#38; <![CDATA[<b>mehr</b>]]></title><guid>no"), F.col("page_id"), F.lit("</guid></item></channel></rss>"))
    own = _read(spark, sf_dir, "pages").select("page_id", F.when(k == 0, atom).when(k == 1, rss).otherwise(F.concat(F.lit("<html><item><title>"), title, F.lit("</title></item>"))).alias("xml"))
    return feeds.items(own, "xml", "page_id")
