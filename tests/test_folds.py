"""Folds with an index against versions that compare all pairs, at a size where that shows."""

import random
import time

import pytest
from test_page_review import first_fit

from pagemill.operators import boxes

COLUMNS = "doc_id long, page_no int, word_no int, text string, conf double, x0 long, y0 long, x1 long, y1 long"


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / (max(1, (a[2] - a[0]) * (a[3] - a[1])) + max(1, (b[2] - b[0]) * (b[3] - b[1])) - i)


def page(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        x, y = rng.randrange(1300), rng.randrange(560)
        b = (x, y, x + rng.choice([0, 10, 40, 90]), y + rng.choice([0, 12, 16, 30]))
        out.append(b)
        for _ in range(rng.randrange(3)):
            out.append((b[0] + rng.randrange(9), b[1] + rng.randrange(3), b[2] + rng.randrange(9), b[3] + rng.randrange(4)))
    rng.shuffle(out)
    return out


def frame(spark, pages):
    return spark.createDataFrame([(d, 0, i, f"w{i}", 80.0, *b) for d, bs in pages.items() for i, b in enumerate(bs)], COLUMNS)


@pytest.mark.parametrize("least", [0.5, 0.6, 1.0])
def test_greedy_repeats(spark, least):
    pages = {d: page(d, 150) for d in range(4)} | {9: [(0, 0, 10, 10), (5, 0, 15, 10), (0, 0, 10, 10), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 10, 6)]}
    got = {(r.doc_id, r.word_no) for r in boxes.new_words_greedy(frame(spark, pages), least).collect()}
    want = set()
    for d, bs in pages.items():
        kept = []
        for i, b in enumerate(bs):
            if all(iou(k, b) < least for k in kept):
                kept.append(b)
                want.add((d, i))
    assert got == want and len(got) < sum(map(len, pages.values()))


def test_regions_first_fit(spark):
    # Tops in bands that the tolerant order tells apart: elsewhere it is no order, and sorts differ.
    pages = {d: [(x0, y0 // 40 * 30 + y0 % 4, x1, y0 // 40 * 30 + y0 % 4 + y1 - y0) for x0, y0, x1, y1 in page(50 + d, 120)] for d in range(4)}
    got = boxes.regions(frame(spark, pages)).collect()
    for d, bs in pages.items():
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.text) for r in got if r.doc_id == d) == first_fit([(*b, f"w{i}") for i, b in enumerate(bs)])


def test_many_words_on_one_page(spark):
    tall = {1: [(60 * (i % 22), 24 * (i // 22), 60 * (i % 22) + 50, 24 * (i // 22) + 14) for i in range(40_000)]}
    began = time.time()
    assert boxes.new_words_greedy(frame(spark, tall)).count() == 40_000
    assert time.time() - began < 60
