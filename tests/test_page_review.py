"""Findings of the review over page operators."""

from pyspark.sql import functions as F

from pagemill.operators import boxes

COLUMNS = "doc_id long, page_no int, line_no int, k int, word_no int, text string, conf long, x0 long, y0 long, x1 long, y1 long"


def test_tile_filter_tests_every_tile_row(spark):
    # Of tile column 0 only row 1 is masked, which begins at 128.
    rows = [(2, 0, 0, 0, 0, "ab", 10, 0, 120, 16, 132), (2, 0, 0, 1, 1, "ab", 10, 0, 100, 16, 112), (2, 0, 0, 2, 2, "ab", 10, 0, 130, 16, 142)]
    w = spark.createDataFrame(rows, COLUMNS).withColumns({"var": F.lit(0), "rel_h": F.lit(0.01)})
    masked = spark.createDataFrame([(2, 0, 0, 1)], "doc_id long, page_no int, tx int, ty int")
    assert {r.word_no for r in boxes.tile_filter(w, masked, w.where("false")).collect()} == {1}


def first_fit(words, w=1400, h=600):
    """Reference rule: words in reading order with a tolerance (an insertion sort), then first-fit groups of their texts."""
    order = []
    for a in words:
        i = len(order)
        while i and (a[1] - order[i - 1][1] if abs(a[1] - order[i - 1][1]) > 0.02 * h else a[0] - order[i - 1][0]) < 0:
            i -= 1
        order.insert(i, a)
    groups = []
    for x0, y0, x1, y1, t in order:
        for g in groups:
            b = g[0]
            if min(y1, b[3]) > max(y0, b[1]) and -x1 < x0 - b[2] < 0.05 * w or abs(y0 - b[3]) < 0.02 * h and min(x1, b[2]) > max(x0, b[0]):
                g[0] = (min(b[0], x0), min(b[1], y0), max(b[2], x1), max(b[3], y1))
                g[1].append(t)
                break
        else:
            groups.append([(x0, y0, x1, y1), [t]])
    return sorted((*b, " ".join(ts)) for b, ts in groups)


def test_regions_read_jittered_lines_in_order(spark):
    pages = {
        1: [(60 * i, 24 * j + (2 * i + j) % 3, 60 * i + 50, 24 * j + 12 + i % 5, f"w{j}{i}") for j in range(3) for i in range(8)],
        2: [(0, 0, 40, 12, "a"), (400, 2, 440, 14, "d"), (50, 5, 90, 17, "b"), (100, 1, 140, 13, "c"), (0, 200, 40, 212, "e"), (45, 190, 80, 202, "f")],
    }
    rows = [(d, 0, 0, 0, i, t, 90, x0, y0, x1, y1) for d, ws in pages.items() for i, (x0, y0, x1, y1, t) in enumerate(ws)]
    got = boxes.regions(spark.createDataFrame(rows, COLUMNS)).collect()
    for d, ws in pages.items():
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.text) for r in got if r.doc_id == d) == first_fit(ws)
    assert any(r.text.startswith("a b c") for r in got) and any("e" in r.text and r.text.index("e") < r.text.index("f") for r in got if r.doc_id == 2 and "f" in r.text)
