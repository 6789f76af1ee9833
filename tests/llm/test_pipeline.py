"""The pipeline's stages against plain versions, on the smallest table and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import bpe, mixing, pii, quality  # noqa: E402
from tidemark.llm import queries as q  # noqa: E402
from tidemark.llm.common import bucket_of  # noqa: E402

DIR = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_run_equals_plain_stages(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    net = quality.fit(docs, labels, bucket_of(F.col("doc_id"), 3) != 1)
    good = {r.doc_id for r in quality.score(docs, net).where("score >= 0.5").collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in good), key=lambda r: r.doc_id)
    root = {r.doc_id: r.doc_id for r in rows}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    left = [r for r in rows if root[r.doc_id] == r.doc_id]
    kept_rows = spark.createDataFrame(left, docs.schema)
    clean = pii.redacted(kept_rows, pii.fit(kept_rows))
    text = {r.doc_id: r.text for r in clean.collect()}
    times = {r.doc_id: r.times for r in mixing.mix(clean).collect() if r.times}
    out = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in out} == set(times) and len(out) == sum(times.values())
    assert all(sum(r.doc_id == k for r in out) == v for k, v in times.items())
    vocabulary = bpe.read_ranks(open(q.RANKS, "rb").read())
    assert all(b"".join(vocabulary[i] for i in r.ids).decode() == text[r.doc_id] and len(r.ids) == r.n_tokens for r in out)


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, sigs int, row int, times int, _mix_id int"
    rows = [(1, "one two three four five six", "en", "s", 27, 0.1, 0, 0, 0, 0), (1, "one two three four five six", "en", "s", 27, 0.1, 0, 0, 0, 0), (None, "seven eight", None, None, None, None, 1, 1, 1, 1), (3, None, "en", "s", 0, None, 2, 2, 2, 2), (4, "", "en", "t", 0, None, 3, 3, 3, 3), (5, "mail a@b.org " * 20_000, "en", "t", 5, None, 4, 4, 4, 4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            assert (out.columns == docs.columns) == (name != "byte_bpe")
            n = out.count()
            assert n <= 2 * docs.count()
            if name in ("pii", "byte_bpe"):
                assert n == docs.count()
            if name == "near_duplicates":
                assert n == docs.count()  # repeated rows of one id are one document, whose rows all stay
