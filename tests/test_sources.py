"""Sources and sinks of pages: recogniser output, page results as JSON, the cache plan and the export."""

import json

from pyspark.sql import functions as F

from pagemill.operators import lines
from pagemill.plans import cached
from pagemill.sources import export, results

TSV = "doc_id long, page_no int, tsv string"
ROW = "5\t1\t1\t1\t0\t{}\t10\t20\t30\t12\t90\t{}"


def parsed(spark, f, *texts):
    return sorted((r.page_no, r.text) for r in f(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], TSV)).collect())


def test_first_row_goes_if_it_holds_the_word(spark):
    head = "LEVEL\tpage"
    got = parsed(spark, lines.parse_tsv, "\n".join([head, ROW.format(1, "a")]), "\n".join([ROW.format(1, "Sea Level"), ROW.format(2, "b level"), "level\t1"]), f"\n \n{ROW.format(1, 'c')}", None, "", " \n\t", ROW.format(1, "  d\te \r"), "level")
    assert got == [(0, "a"), (1, "b level"), (2, "c"), (6, "d\te")]


def test_columns_by_header(spark):
    head = "text\tconf\theight\twidth\ttop\tleft\tlevel"
    good = [head, "a\t90.5\t12\t30\t20\t10\t5", " \t90\t12\t30\t20\t10\t5", "b\t\t\t\t\t\t4", "c"]
    got = lines.parse_tsv_by_header(spark.createDataFrame([(1, 0, "\n".join(good)), (1, 1, head.replace("conf", "sure") + "\nx\t1\t1\t1\t1\t1\t5"), (1, 2, head), (1, 3, None), (1, 4, "")], TSV)).where("level in (4, 5)").collect()
    assert sorted((r.page_no, r.level, r.text, r.conf, r.x0, r.y0, r.x1, r.y1) for r in got) == [(0, 4, "b", 0.0, 0, 0, 0, 0), (0, 5, "a", 90.5, 10, 20, 40, 32)]


def test_page_json(spark):
    words = [{"text": "é \"q\"", "confidence": 90.5, "bbox": {"x0": 1, "y0": 2, "x1": 3.5, "y1": 4}}]
    page = {"pageNumber": 3, "width": 10, "height": 20, "dpi": 150, "language": "eng", "lines": [{"text": "é", "confidence": 1, "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}, "words": words}], "words": words, "text": "é", "confidence": 55.25, "later": [1]}
    texts = [json.dumps(page), json.dumps(page)[:80], None, "", "null", "[]", "5", "{}", " {\"dpi\": 7}\n", "{\"dpi\": \"x\"}", "{} trailing"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, payload string").select("i", results.decoded(F.col("payload")).alias("r"))
    got = {r.i: r.r for r in d.collect()}
    assert got[0].pageNumber == 3 and got[0].pageSegMode is None and got[0].lines[0].words[0].bbox.x1 == 3.5 and got[0].words[0].text == 'é "q"' and got[0].confidence == 55.25
    assert all(got[i] is None for i in (1, 2, 3, 4, 5, 6, 9)) and got[7].dpi is None and got[8].dpi == 7
    again = d.where("i = 0").select(results.decoded(results.encoded(F.col("r"))).alias("s"), "r").first()
    assert again.s == again.r
    empty = spark.createDataFrame([(1, 0, 10, 20, 150, "eng", None)], "doc_id long, page_no int, width int, height int, dpi int, language string, psm int")
    none = spark.createDataFrame([], "doc_id long, page_no int, line_no long, k int, text string, conf double, x0 long, y0 long, x1 long, y1 long")
    r = results.results(none, empty).first().result
    assert (r.lines, r.words, r.text, r.confidence, r.dpi) == ([], [], "", 0.0, 150)


def test_cache_plan(spark):
    ok = lambda **o: json.dumps({"pageNumber": 9, "dpi": 150, "language": "eng", "pageSegMode": 3, "words": [], "text": "stored"} | o)
    tsv = "\n".join(ROW.format(i, t) for i, t in ((1, "read"), (2, "words")))
    pages = spark.createDataFrame([(1, i, None if i in (5, 0) else tsv, 100, 100) for i in range(8)], TSV + ", width int, height int")
    cache = spark.createDataFrame([(1, 0, ok(), 5), (1, 1, ok(dpi=200), 5), (1, 2, ok(language="jpn"), 5), (1, 3, ok()[:30], 5), (1, 4, ok(pageSegMode=None), 5), (1, 4, ok(dpi=1), 4), (1, 6, ok(), 4), (1, 6, ok(dpi=1), 5), (2, 0, ok(), 5)], "doc_id long, page_no int, payload string, updated_at long")

    def run(psm, numbers=None):
        out, new, counts = cached.with_cache(cached.chosen(pages, numbers), cache, "eng", 150, psm, now=9)
        return {r.page_no: (r.source, r.error, r.result and r.result.text, r.result and r.result.pageNumber) for r in out.collect()}, {(r.doc_id, r.page_no): r.updated_at for r in new.collect()}, counts.get

    got, new, counts = run(None)
    assert got == {0: ("cache", None, "stored", 0), 4: ("cache", None, "stored", 4), 5: (None, "OCR failed", None, None)} | {i: ("new", None, "read words", i) for i in (1, 2, 3, 6, 7)}
    assert new == {(1, 0): 5, (1, 4): 5, (2, 0): 5} | {(1, i): 9 for i in (1, 2, 3, 6, 7)}
    assert counts == {"pages": 8, "hits": 2, "reads": 5, "failures": 1}
    got, _, counts = run(3, [1, 5, 6])
    assert {i: x[0] for i, x in got.items()} == {0: "cache", 4: "new", 5: None} and counts["pages"] == 3
    out, new, _ = cached.with_cache(pages.where("false"), cache, "eng", 150)
    assert out.isEmpty() and new.count() == 7
    p = spark.createDataFrame([(3, 2), (9, 2), (0, 0)], "d int, n int").select(cached.progress(F.col("d"), F.col("n")).alias("p")).collect()
    assert [r.p for r in p] == [50.0, 100.0, 0.0]


def test_export_replaces_only_its_folders(spark, tmp_path):
    path = f"{tmp_path}/out"
    cols = "doc_id long, page_no long, word_no int, text string, conf long, x0 long, y0 long, x1 long, y1 long"
    words = spark.createDataFrame([(d, p, 10 * p + i, f"w{d}-{p}-{i}", 90, 40 * i, 10, 40 * i + 30, 30) for d in (1, 2, 3) for p in (0, 1) for i in range(3)], cols)
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf.pdf"), (3, "c"), (4, "none.pdf")], "doc_id long, filename string")
    seen = lambda: {(r.document_id, r.export_name): r.n for r in export.exported(spark, path).groupBy("document_id", "export_name").agg(F.count("*").alias("n")).collect()}
    assert export.exported(spark, path).isEmpty()
    export.export(words, docs, path)
    whole = {(1, "a_searchable.pdf"): 6, (2, "b_searchable.pdf.pdf"): 6, (3, "c"): 6}
    assert seen() == whole
    export.export(words, docs, path, 2)
    assert seen() == whole | {(1, "a_page_2_searchable.pdf"): 3, (2, "b_page_2_searchable.pdf.pdf"): 3, (3, "c"): 3}
    export.export(words.where("doc_id = 1 and word_no < 2"), docs, path)
    export.export(words, docs, path, 2)
    assert seen() == {(1, "a_searchable.pdf"): 2, (1, "a_page_2_searchable.pdf"): 3, (2, "b_searchable.pdf.pdf"): 6, (2, "b_page_2_searchable.pdf.pdf"): 3, (3, "c"): 3}
    rows = export.exported(spark, path).where("export_name = 'b_searchable.pdf.pdf'").collect()
    assert [r.text for r in rows if r.page_no == 0] == ["w2-0-0", "w2-0-1", "w2-0-2"]
