"""Page operators against hand-worked pages and plain folds."""

import base64

import pytest
from pyspark.sql import functions as F

from pagemill.operators import boxes, library, lines
from pagemill.sources import files

COLUMNS = "doc_id long, page_no int, line_no long, k int, word_no int, text string, conf double, x0 long, y0 long, x1 long, y1 long"
HEAD = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"


def test_tsv_lines_of_several_blocks(spark):
    rows = [HEAD, "5\t1\t1\t1\t0\t1\t0\t0\t20\t10\t95.4\tone", "5\t1\t2\t1\t0\t1\t0\t50\t20\t10\t-1\ttwo\ttabs ", "5\t1\t1\t2\t0\t1\t0\t20\t20\t10\t80abc\t", "short\trow", ""]
    got = lines.parse_tsv(spark.createDataFrame([(1, 0, "\n".join(rows))], "doc_id long, page_no int, tsv string")).collect()
    assert sorted((r.block_no, r.par_no, r.conf, r.text, r.y1) for r in got) == [(1, 1, 95.4, "one", 10), (1, 2, 80.0, "", 30), (2, 1, -1.0, "two\ttabs", 60)]
    assert len({r.line_no for r in got}) == 3


def test_line_text_follows_its_orientation(spark):
    slanted = [(1, 0, 0, i, i, t, 90.0, x, 40 * x // 100, x + 10, 40 * x // 100 + 12) for i, (t, x) in enumerate((("c", 200), ("a", 0), ("b", 100)))]
    upright = [(1, 0, 1, i, 10 + i, t, 90.0, 100 + i % 2, y, 112, y + 10) for i, (t, y) in enumerate((("down", 300), ("up", 100), ("mid", 200)))]
    got = {r.line_no: r for r in lines.assemble(spark.createDataFrame(slanted + upright, COLUMNS)).collect()}
    assert got[0].text == "a b c" and got[1].text == "up mid down"


def test_merge_counts_unknown_confidences(spark):
    w = spark.createDataFrame([(1, 0, 0, 0, 0, "a", 90.0, 0, 0, 10, 10), (1, 0, 0, 1, 1, "b", -1.0, 12, 1, 20, 12)], COLUMNS)
    m, a = lines.merge(w).first(), lines.assemble(w).first()
    assert (m.conf, m.x1, m.y1) == (44.5, 20, 12) and a.conf == 90.0


def fold_by_y(words, page_h=600):
    """(x0, y0, y1) in the order given: line numbers by an insertion sort and one pass."""
    order = []
    for i in range(len(words)):
        at = len(order)
        while at and ((d := words[i][1] - words[order[at - 1]][1]) if abs(words[i][1] - words[order[at - 1]][1]) > 2 else words[i][0] - words[order[at - 1]][0]) < 0:
            at -= 1
        order.insert(at, i)
    hs = sorted(max(1, w[2] - w[1]) for w in words)
    tol, out, line, top, low = max(4, 0.6 * hs[len(hs) // 2], 0.001 * page_h), {}, -1, 0, 0
    for i in order:
        _, y0, y1 = words[i]
        if line < 0 or abs((y0 + y1) / 2 - (top + low) / 2) > tol:
            line, top, low = line + 1, y0, y1
        top, low, out[i] = min(top, y0), max(low, y1), line
    return [out[i] for i in range(len(words))]


def test_lines_by_y(spark):
    pages = {1: [(60 * i, 24 * j + (i + j) % 3, 24 * j + 12 + i % 4) for j in range(4) for i in range(5)], 2: [(0, 0, 10), (50, 30, 42), (20, 31, 40), (10, 100, 100)], 3: [(5, 7, 7)]}
    rows = [(d, 0, 0, 0, i, "t", 90.0, x, a, x + 9, b) for d, ws in pages.items() for i, (x, a, b) in enumerate(ws)]
    got = {(r.doc_id, r.word_no): r.line for r in lines.lines_by_y(spark.createDataFrame(rows, COLUMNS)).collect()}
    for d, ws in pages.items():
        assert [got[d, i] for i in range(len(ws))] == fold_by_y(ws)


def test_non_latin_is_asked_of_letters(spark):
    w = spark.createDataFrame([(1, 0, 0, 0, 0, "—ab", 60.0, 0, 0, 16, 10), (1, 0, 0, 1, 1, "äb", 60.0, 20, 0, 36, 10)], COLUMNS).withColumns({"var": F.lit(900), "rel_h": F.lit(0.01)})
    none = w.where("false")
    assert [r.word_no for r in boxes.photo_filter(w, none).collect()] == [1]  # the dash is no letter
    tiles = spark.createDataFrame([(1, 0, 0, 0)], "doc_id long, page_no int, tx int, ty int")
    assert boxes.tile_filter(w, tiles, none).count() == 0 and boxes.tile_filter(w, tiles, w).count() == 2 and boxes.tile_filter(w, tiles.where("false"), none).count() == 2


def test_fallback_chain(spark):
    page = "doc_id long, page_no int, conf double"
    box = "doc_id long, page_no int, x0 long, y0 long, x1 long, y1 long, conf double, text string"
    found = spark.createDataFrame([(1, 0, 0, 0, 5, 5, 0.9, "t")], box)
    blocks = spark.createDataFrame([(1, 0, 0, 0, 9, 9, 90.0, "x"), (2, 0, 0, 0, 9, 9, 90.0, "x"), (2, 0, 1, 1, 9, 9, 10.0, "x"), (3, 0, 0, 0, 9, 9, 90.0, " ")], box)
    got = boxes.fallback(found, blocks, spark.createDataFrame([(1, 0, 50.0), (2, 0, 50.0), (3, 0, 0.0)], page)).collect()
    assert sorted((r.doc_id, r.kind, r.conf) for r in got) == [(1, "words", 0.9), (2, "block", 0.9), (3, "page", 0.5)]


def test_files(spark, tmp_path):
    for name, data in (("a.PDF", b"%PDF"), ("b.jpeg", b"\xff\xd8"), ("c.txt", b"text"), ("d.png", b"\x89PNG")):
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r for r in files.files(spark, str(tmp_path)).collect()}
    assert {n: r.mime_type for n, r in got.items()} == {"a.PDF": "application/pdf", "b.jpeg": "image/jpeg", "c.txt": "application/octet-stream", "d.png": "image/png"}
    assert base64.b64decode(got["a.PDF"]["data"]) == b"%PDF" and got["c.txt"]["size"] == 4
    picked = files.files(spark, str(tmp_path), files.DIALOG)
    assert {r["name"] for r in picked.collect()} == {"a.PDF", "b.jpeg", "d.png"}
    assert {bytes(r[0]) for r in picked.select(files.content(F.col("data"))).collect()} == {b"%PDF", b"\xff\xd8", b"\x89PNG"}
    with pytest.raises(FileNotFoundError, match="File not found"):
        files.files(spark, str(tmp_path / "none.pdf"))


def test_insert_numbers_and_defaults(spark):
    tags = spark.createDataFrame([(6, "old", "#1")], "id long, name string, color string")
    new = spark.createDataFrame([("b", ""), ("a", None), ("c", "#2")], "name string, color string")
    got = sorted((r.id, r.name, r.color) for r in library.insert(tags, new, {"color": "#6366f1"}).collect())
    assert got == [(6, "old", "#1"), (7, "a", "#6366f1"), (8, "b", "#6366f1"), (9, "c", "#2")]
    assert library.insert(tags.where("false"), new.limit(1), {}).first().id == 1


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from pagemill.streaming.cache import cache_stream

    schema = "event_id long, ts long, user_id long, event_type string, value double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    from pyspark.sql.types import _parse_datatype_string as parse

    state = lambda: {(r.document_id, r.page): r.payload for r in cache_stream(spark, f"{tmp_path}/in", f"{tmp_path}/state", parse(schema), 1).collect()}
    put([(1, 10, 1, "a", 1.0), (2, 11, 1, "a", 2.0), (3, 5, 2, "b", 3.0)])
    assert state() == {(1, "a"): 2.0, (2, "b"): 3.0}
    put([(4, 9, 1, "a", 9.0), (5, 6, 2, "b", 4.0)])  # the first is older than what is known
    assert state() == {(1, "a"): 2.0, (2, "b"): 4.0}


def test_stream_is_compacted(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string as parse

    from pagemill.streaming import cache

    schema = "event_id long, ts long, user_id long, event_type string, value double"
    want, folder = {}, f"{tmp_path}/state"
    assert cache.compacted(spark, folder).isEmpty()
    for i in range(5):
        rows = [(10 * i + j, 10 * i + j, j % 2, "ab"[i % 2], float(10 * i + j)) for j in range(2)]
        want |= {(r[2], r[3]): r[4] for r in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = cache.cache_stream(spark, f"{tmp_path}/in", folder, parse(schema), 1)
        assert {(r.document_id, r.page): r.payload for r in got.collect()} == want
        small = cache.compacted(spark, folder, 1)
        assert {(r.document_id, r.page): r.payload for r in small.collect()} == want
        assert len(cache._numbers(spark, f"{folder}/updates")) <= 1 and len(cache._numbers(spark, f"{folder}/whole")) == (i > 0)
