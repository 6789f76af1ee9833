"""Every query of the catalogue gives what its SQL gives in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df, sql = QUERIES[name](spark, DIR), duck.sql(ORACLE[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(sql.columns, sql.fetchall())


def test_windows_and_novelty_of_the_survey(spark):
    assert {"moving_average_7", "moving_average_30", "moving_average_90"} <= set(QUERIES)
    novelty = QUERIES["document_jaccard_novelty"](spark, DIR)
    assert novelty.count() == spark.read.parquet(f"{DIR}/documents.parquet").count() and novelty.where("novelty < 1").count()


def test_means_of_the_band_join_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    values = [(i, i % 40, "purchase" if i % 4 == 0 else "view", round((i * 7919 % 9973) / 100 + 0.01, 2)) for i in range(8000)]
    got = []
    for k, own in enumerate((values, values[::-1], sorted(values, key=lambda r: r[3]))):
        spark.createDataFrame(own, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        got.append(rows(["event_id", "v", "metric", "m"], map(tuple, QUERIES["evidence_band_join"](spark, f"{tmp_path}/{k}").collect())))
    assert got[0] and got[0] == got[1] == got[2]
