"""Every query against its DuckDB SQL at the smallest scale, and folds against their rules."""

import duckdb
import pytest

from pagemill.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v != v:
        return "None"
    return str(v) if isinstance(v, (str, bool)) else repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, duck):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(tuple(map(text, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(text, r)) for r in want)


def test_folds_keep_every_word(spark):
    words = QUERIES["ocr_totals"](spark, SF).agg({"words": "sum"}).first()[0]
    assert QUERIES["lines_by_y"](spark, SF).count() == words
    kept = QUERIES["iou_dedup_greedy"](spark, SF)
    assert kept.count() < words * 1.2 and kept.where("word_no < 100000").count() == words
    r = QUERIES["regions"](spark, SF)
    assert r.where("x0 > x1 or y0 > y1 or conf < 0.2 or type not in ('text', 'balloon', 'sfx')").isEmpty()


def test_search_folds_ascii_only(spark):
    from pyspark.sql import functions as F

    from pagemill.functions.semantics import contains_ascii

    d = spark.createDataFrame([("ABC",), ("àbc",), ("ÀBC",), ("a_c",)], "t string")
    assert [r.t for r in d.where(contains_ascii(F.col("t"), "À")).collect()] == ["ÀBC"]
    assert d.where(contains_ascii(F.col("t"), "a_C")).count() == 2
