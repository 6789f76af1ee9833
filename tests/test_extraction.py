"""Feeds, JSON out of text and canonical JSON on the cases that their rules are stated by."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extraction as x
from tidemark.sources import feeds

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>T</title>
<item><title><![CDATA[Quantum Tokenizer &amp; Beyond]]></title><link>https://example.org/a</link><pubDate>Mon, 07 Sep 2026 10:00:00 GMT</pubDate></item>
<item><title>Second post</title><guid>https://example.org/b</guid></item><item><title> </title><link>c</link></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
<entry><title type="html">Atom &lt;b&gt;entry&lt;/b&gt; one</title><link rel="self" href="https://x.example/self"/><link rel="alternate" href="https://x.example/one"/><published>2026-09-08T01:02:03Z</published></entry>
<entry><title>Atom two</title><link href="https://x.example/two?a=1&amp;b=2"/><updated>2026-09-09T00:00:00Z</updated></entry>
<entry><title>three</title><link rel="self" href="only"/><published>soon</published></entry></feed>"""


def test_feeds_as_rows(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<<<html><body>not a feed</body></html>"), (4, None), (5, " " * 4001 + "<rss>")], "id int, xml string")
    assert {r.id: r.format for r in feeds.formats(df, "xml").collect()} == {1: "rss", 2: "atom", 3: None, 4: None, 5: None}
    got = [tuple(r) for r in feeds.items(df, "xml", "id").orderBy("id", "place").collect()]
    at = lambda *a: datetime.datetime(2026, 9, *a)
    assert got == [
        (1, "rss", 0, "Quantum Tokenizer & Beyond", "https://example.org/a", at(7, 10)), (1, "rss", 1, "Second post", "https://example.org/b", None),
        (2, "atom", 0, "Atom entry one", "https://x.example/one", at(8, 1, 2, 3)), (2, "atom", 1, "Atom two", "https://x.example/two?a=1&b=2", at(9, 0)), (2, "atom", 2, "three", "only", None),
    ]


def test_entities(spark):
    cases = {"&#x41;&#X1F600;b": "A😀b", "&#65;&#228;": "Aä", "&amp;lt; &LT;": "&lt; <", "&#x26;#65;": "A", "&#xD800; &#99999999; &#;": "&#xD800; &#99999999; &#;", "&unknown; & &#x": "&unknown; & &#x", "plain": "plain", "a&#59;b;c": "a;b;c"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", feeds.decoded(F.col("t")).alias("d")).orderBy("i")
    assert [r.d for r in df.collect()] == list(cases.values())


@pytest.mark.parametrize(("raw", "strategy", "items"), [
    ('{"items": [1, 2]}', 1, [1, 2]), ('```json\n{"items": [{"a": "}"}]}\n```', 1, [{"a": "}"}]), ('draft {"items": [1]} final {"items": [2]}', 1, [2]), ('{"x": "{ \\" {", "items": []}', 1, []),
    ('he said "no {"items": [7]} end', 2, [7]), ("result: [1, 2]", 3, [1, 2]), ("[]", 0, []), ('{"\\u0069tems": [5]}', 3, [5]), ('{"items": 1}', 0, []), ("", 0, []), ("no json", 0, []), ('{"a": {"items": [3]}}', 3, [3]), ('{"\\u0069tems": []}', 4, []),
])
def test_items_out_of_text(raw, strategy, items):
    assert x.found_items(raw) == (strategy, items)


def test_objects_out_of_text(spark):
    cases = [('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('so: {"a":2} that', '{"a":2}'), ("not json at all", None), ('x {"a": } {"b": 1}', None), (None, None), ("} {\"a\": 1}", None)]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, t string").select("i", x.json_object(F.col("t")).alias("o"), x.json_items(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.o for r in got] == [w for _, w in cases] and all(r.s.strategy == 0 for r in got)


def test_texts_without_an_answer(spark):
    cases = [("You've hit your limit\nresets 9pm", "You've hit your limit"), ("  API Error: 529 ", "API Error: 529"), ('{"title": "new api error"}', ""), ("quota " * 100, ""), ("fine", ""), (None, "")]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, t string").select("i", x.no_answer(F.col("t")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [w for _, w in cases]


def test_canonical_json(spark):
    a, b = {"b": [1.0, {"y": None, "x": "é"}], "a": {"url": "see HTTPS://x", "title": "t", "n": 1.5}}, {"a": {"n": 1.5, "title": "t", "url": "see HTTPS://x"}, "b": [1, {"x": "é", "y": None}]}
    rows = [(1, json.dumps(a)), (2, json.dumps(b)), (3, "{bad"), (4, None), (5, "[]")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r for r in df.select("i", x.canonical(F.col("t")).alias("c"), x.content_id(F.col("t"), 12).alias("h"), x.scrubbed(F.col("t"), ("title",)).alias("s"), x.leaves(F.col("t")).alias("l"), x.disallowed(F.col("t"), ("url", "n", "x", "y", "b")).alias("d")).collect()}
    assert got[1].c == got[2].c == '{"a":{"n":1.5,"title":"t","url":"see HTTPS://x"},"b":[1,{"x":"é","y":null}]}' and got[1].h == got[2].h and len(got[1].h) == 12
    assert got[1].s == '{"a":{"n":1.5,"url":"[url-removed]"},"b":[1,{"x":"é","y":null}]}'
    assert {(v.path, v.key, v.value) for v in got[2].l} == {("$.a.n", "n", "1.5"), ("$.a.title", "title", "t"), ("$.a.url", "url", "see HTTPS://x"), ("$.b[0]", "b", "1"), ("$.b[1].x", "x", "é"), ("$.b[1].y", "y", "null")}
    assert got[1].d == ["$.a.title", "$.a.url"] and (got[3].c, got[3].h, got[4].c, got[5].c) == (None, None, None, "[]") and got[3].l == []
