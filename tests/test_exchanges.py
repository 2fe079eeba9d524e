"""What is exchanged: texts of pages, once, and no words of theirs; folds take many pages at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill import registry
from pagemill.operators import lines
from pagemill.operators.spatial import by_page
from pagemill.sources import tables as T
from pagemill.sources.results import decoded

SMALL = "/root/testdata/sf0.001"


def exchanged(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


@pytest.mark.parametrize("name", ["tsv_words", "tsv_line_boxes", "tsv_odd_rows", "tsv_words_by_header", "ocr_page_pipeline", "rebuild_lines", "chunk_dedup", "line_assembly", "lines_by_y", "iou_dedup_greedy", "regions"])
def test_only_page_texts_are_exchanged(spark, name):
    found = exchanged(registry.QUERIES[name](spark, SMALL))
    assert found and all("REPARTITION_BY_NUM" in x for x in found) and len(found) <= 2, found


def test_words_of_a_page_in_place(spark, tmp_path):
    texts = [(0, " a\tbb  c\n" + "d " * 11), (1, None), (2, " \n"), (3, "x" * 7), (None, "né t o")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id is None, r.doc_id, r.page_no, r.line_no, r.k, r.text, r.x0, r.x1) for r in T.words(spark, str(tmp_path)).collect()), key=str)
    first = [("a", 0, 8), ("bb", 14, 30), ("c", 36, 44), *(("d", 50 + 14 * i + 60 * (i > 3), 58 + 14 * i + 60 * (i > 3)) for i in range(7)), *(("d", 14 * i, 14 * i + 8) for i in range(4))]
    want = [(False, 0, 0, i // 10, i % 10, *w) for i, w in enumerate(first)] + [(False, 3, 0, 0, 0, "x" * 7, 0, 56), (True, None, 0, 0, 0, "né", 0, 16), (True, None, 0, 0, 1, "t o", 22, 46)]
    assert got == sorted(want, key=str)


def test_pages_that_fill_several_batches(spark):
    """Pages of one row, of many batches and of null keys come whole and in order."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        sizes = {(1, 0): 1, (1, 1): 40, (2, 0): 7, (2, 1): 14, (3, 0): 2, (None, 0): 9, (None, None): 8, (0, 0): 3}
        rows = [(d, p, i) for (d, p), n in sizes.items() for i in reversed(range(n))]

        def fold(t: pa.Table, turns: list[int]) -> pa.Table:
            at = [(t.slice(a, z - a)) for a, z in zip(turns, turns[1:], strict=False)]
            return pa.table({"d": [x["d"][0].as_py() for x in at], "p": [x["p"][0].as_py() for x in at], "n": [x.num_rows for x in at], "ok": [x["i"].to_pylist() == [*range(x.num_rows)] for x in at]}, schema=pa.schema([("d", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("ok", pa.bool_())]))

        got = by_page(spark.createDataFrame(rows, "d long, p long, i long"), ["d", "p"], ["i"], fold, "d long, p long, n long, ok boolean").collect()
        assert {(r.d, r.p): r.n for r in got} == sizes and len(got) == len(sizes) and all(r.ok for r in got)
    finally:
        spark.conf.set(key, before)


def test_numbers_and_texts_of_rows(spark):
    """Short ways for plain numbers and ASCII texts give what the regular expressions give."""
    odd = ["", " 12x", "-3", "+4", "007", "x", "1.5", ".5", "5.", ".", "1.2.3", "12 ", "９", "9" * 6]
    rows = [(i, 0, "\t".join(["5", *[t] * 9, t, f"\x0b {t}\x1c \t"])) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in lines.parse_tsv(spark.createDataFrame(rows, "doc_id long, page_no long, tsv string")).collect()}
    whole = [0, 12, -3, 4, 7, 0, 1, 0, 5, 0, 1, 12, 0, int("9" * 6)]
    number = [0, 12, -3, 4, 7, 0, 1.5, 0.5, 5, 0, 1.2, 12, 0, float("9" * 6)]
    assert [got[i].word_no for i in range(len(odd))] == whole and [got[i].conf for i in range(len(odd))] == number
    assert [got[i].text for i in range(len(odd))] == [f"{t.lstrip()}\x1c" for t in odd]


@pytest.mark.parametrize("name", ["page_json", "page_json_words", "cached_pages", "cached_pages_store"])
def test_page_results_are_not_exchanged(spark, name):
    found = exchanged(registry.QUERIES[name](spark, SMALL))
    assert found and all("REPARTITION_BY_NUM" in x for x in found), found


def test_a_payload_is_parsed_once(spark):
    df = spark.createDataFrame([('{"dpi": 150}',), ("{",), (None,)], "payload string").select(decoded(F.col("payload")).alias("r"))
    df = df.select("r.dpi", "r.language", F.size("r.words").alias("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.dpi for r in df.collect()] == [150, None, None]
