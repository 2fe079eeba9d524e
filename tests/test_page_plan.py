"""The whole page plan against its parts, and results whose order counts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill.operators import lines, recovery
from pagemill.plans import page
from pagemill.registry import ORACLES, QUERIES
from pagemill.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """The pages of a few documents, one without recogniser output, as tables of their own."""
    some = lambda df: df.where("doc_id in (1, 3, 17, 23, 30, 33)")
    pages, found = page._seen(spark, SF)
    return some(pages).cache(), some(found).cache(), some(page._rasters(spark, SF)).cache()


def test_plan_is_its_parts_in_order(spark, inputs):
    pages, found, rasters = inputs
    got = page.read_pages(*inputs, 25, 2, 1).cache()
    words = page.numbered_words(pages)
    assert words.groupBy("doc_id", "page_no").agg((F.max("word_no") + 1 == F.count("*")).alias("ok"), F.min("word_no").alias("m")).where("not ok or m > 0").isEmpty()
    boxes = lines.parse_tsv(pages).where("level = 4")
    kept = page.off_pictures(recovery.recover(words, boxes, found, pages).withColumn("k", F.col("word_no")), rasters, 25, 2, 1).cache()
    want = lines.rebuild(kept)
    cols = ["doc_id", "page_no", "line_no", "seg", "n_words", "text", "place"]
    assert sorted(map(tuple, got.where("not raw").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.where("not raw").agg(F.sum("n_found")).first()[0] == kept.where("pass is not null").count() > 0
    assert got.where("not raw").agg(F.sum("n_words")).first()[0] == kept.count()


def test_pages_without_words_have_raw_lines(inputs):
    pages, _, _ = inputs
    got = page.read_pages(*inputs, 25, 2, 1).where("raw").collect()
    assert {r.doc_id for r in got} == {17}
    for p in pages.where("doc_id = 17").collect():
        own = sorted((r for r in got if r.page_no == p.page_no), key=lambda r: r.place)
        texts = [t.strip() for t in p.text.split("\n") if t.strip()]
        assert [r.text for r in own] == texts and all(abs(r.conf - p.conf) < 1e-9 and (r.x0, r.x1) == (20, 1380) for r in own)
        h = 600 / (len(texts) + 2)
        assert all(abs(r.y0 - (i + 1) * h) < 1e-9 and abs(r.y1 - (i + 2) * h) < 1e-9 for i, r in enumerate(own))


def test_blank_pages(spark):
    row = "5\t1\t1\t1\t0\t1\t10\t20\t30\t12\t90\tword"
    cols = "doc_id long, page_no int, tsv string, text string, conf double, cjk boolean, chunked boolean, width int, height int"
    d = spark.createDataFrame([(1, 0, None, " \n", 5.0, False, False, 1400, 600), (1, 1, "", None, None, True, False, 1400, 600), (1, 2, row, "raw", 5.0, False, True, 1400, 600), (1, 3, None, "a\n\n b ", None, False, False, 1400, 600)], cols)
    none = spark.createDataFrame([], "doc_id long, page_no int, word_no int, mode string, text string, conf double, x0 long, y0 long, x1 long, y1 long")
    got = page.read_pages(d, none, spark.createDataFrame([], "doc_id long, page_no int, grey binary")).collect()
    assert sorted((r.page_no, r.text, r.raw, r.conf) for r in got) == [(2, "word", False, 90.0), (3, "a", True, 0.0), (3, "b", True, 0.0)]


ORDERED = [f"docs_sorted_{k}_{d}" for k in ("date", "size", "type") for d in ("asc", "desc")] + ["docs_recent", "recent_visible", "tags_of_doc", "scan_tags", "scan_projects", "scan_places", "docs_by_project", "docs_root", "docs_favorites", "docs_search", "docs_by_tag", "place_children"]


@pytest.mark.parametrize("name", ORDERED)
def test_order(name, spark):
    c = duckdb.connect()
    for t in ("documents", "region", "nation", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = [r["id"] for r in QUERIES[name](spark, SF).collect()]
    assert got == [r[0] for r in c.sql(f"SELECT id FROM ({ORACLES[name]})").fetchall()] and len(got) > 1


def test_names_are_sorted_by_collation(spark, monkeypatch):
    """Case and accents count after letters: an order of bytes would put capitals first and accents last."""
    names = ["a.pdf", "A.pdf", "ä.pdf", "b.pdf", "B.pdf", "e.pdf", "é.pdf", "f.pdf", "z.pdf"]
    d = tables.documents(spark, SF).limit(len(names)).withColumn("id", F.row_number().over(lines.Window.orderBy("id")).cast("long"))
    mixed = spark.createDataFrame([(i + 1, names[(i * 5) % 9]) for i in range(9)], "id long, filename string")
    monkeypatch.setattr(tables, "documents", lambda s, f, rows=None: d.drop("filename").join(mixed, "id"))
    assert [r.filename for r in QUERIES["docs_sorted_name_asc"](spark, SF).collect()] == names
    assert [r.filename for r in QUERIES["docs_sorted_name_desc"](spark, SF).collect()] == names[::-1]
