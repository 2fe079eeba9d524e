"""The pipeline and each of its stages against plain versions that compare every text with every other."""

import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute import base_spans
from test_methods import spared_by_pairs

import corpus_pipeline
from pagemill.llm import packing, quotes, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def generated():
    """(doc_id, text) with insults, near and exact copies, benchmark passages, secrets, a repeated row, nulls and a long text; labels; items."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((14, 10, 6, 30))] + [(9, None)]
    for i in range(320):
        w = rng.choices(vocabulary, k=70)
        if i % 8 == 1:
            for at in (3, 20, 40, 60):
                w[at] = rng.choice(["idiot", "M0R0N", "worthless!", "scum"])
        if i % 16 == 3:
            w[30] = rng.choice(["trash can", "clown fish,"])
        if i % 20 == 5:
            q = items[i // 20 % 4][1].split()
            w[25:25] = q[: len(q) if i % 40 == 5 else max(5, len(q) - 5)]
        if i % 10 == 7:
            w[50:50] = ["password=" + rng.choice(vocabulary) + "abc123", "AKIA" + "".join(rng.choices(string.ascii_uppercase, k=16)), "é", "token:", "'x1y2z3'", "deadbeef" * 4]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 8 == 1)))
    for i in range(0, 40, 2):
        near = rows[i][1].split()
        near[33] = "changed"
        if i % 4:
            near[10], near[50] = "other", "words"
        rows.append((1000 + i, " ".join(near)))
    rows += [(2000 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(60, 70)]
    rows += [rows[80], (None, "a text without an id " + rows[81][1]), (3000, None), (3001, ""), (3002, " ".join(rng.choices(vocabulary, k=9000)))]
    return rows, labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = generated()
    folder = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def not_toxic(rows, lexicon):
    return [(i, t) for i, t in rows if 1 / (1 + math.exp(-(lexicon.bias + lexicon.slope * math.log1p(spared_by_pairs(t, lexicon))))) < 0.3]


def without_copies(rows):
    words = [" ".join((t or "").lower().split()) for _, t in rows]
    sets = [set(zip(*(w.split()[k:] for k in range(5)), strict=False)) for w in words]
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    first = list(range(len(rows)))

    def root(k):
        while first[k] != k:
            k = first[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if words[a] == words[b] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)), key=key)
                first[y] = x
    return [rows[k] for k in range(len(rows)) if first[k] == k]


def without_passages(rows, items):
    low = lambda t: WORD.findall("".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
    windows = [q[s : s + 10] for q in (low(t) for _, t in items) if q for s in range(max(1, len(q) - 9))]
    holds = lambda w: any(w[k : k + len(q)] == q for q in windows for k in range(len(w)) if w[k] == q[0])
    return [(i, t) for i, t in rows if not holds(low(t))]


def without_secrets(text):
    out, at = [], 0
    for a, b, _ in base_spans(text or ""):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def table(df):
    return sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)


def as_table(rows):
    return sorted(((i, t, None if t is None else len(t)) for i, t in rows), key=str)


def test_every_stage_by_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    stages, have, left = dict(corpus_pipeline.STAGES), rows, []
    frame = lambda rs: spark.createDataFrame(rs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    for name, plain in (("toxicity", lambda rs: not_toxic(rs, lexicon)), ("near_duplicates", without_copies), ("benchmark_passages", lambda rs: without_passages(rs, items)), ("secret_spans", lambda rs: [(i, without_secrets(t)) for i, t in rs])):
        want = plain(have)
        assert table(stages[name](spark, docs if have is rows else frame(have), folder)) == as_table(want), name
        left.append(len(want))
        have = want
    assert len(rows) - 45 <= left[0] <= len(rows) - 35  # 40 toxic texts, and copies of some
    assert left[1] <= left[0] - 20 and left[1] - 25 <= left[2] <= left[1] - 5 and left[3] == left[2]
    assert sum("[SECRET]" in (t or "") for _, t in have) > 20

    from tokenizers import Tokenizer

    tk, pieces, sequences = Tokenizer.from_file(packing.tokenizer_path()), {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == {i for i, _ in have}
    for i, t in have:
        ids, at = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for start, n, crc, total in sorted(pieces[i]):
            assert (start, total) == (at, len(ids)) and n > 0 and zlib.crc32(ids[start : start + n].tobytes()) == crc
            at += n
        assert at == len(ids), i
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 4096 or at < 4096 and at & (at - 1) == 0


def test_many_introductions_take_linear_time(spark):
    """80,000 lines that introduce a quote; blank lines of other spaces part passages, and belong to none."""
    texts = ["On Monday A wrote:\n> x y\n" * 80000 + "\nend", "a\r\n \t\r\nb\r\n> q\r\n\r\n> r", "On Monday A wrote:\n\nOn Tuesday B wrote:\n> c\n\n\n> d\nlast"]
    d = spark.createDataFrame([(k, 0, "a", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.body, r.n_quotes) for r in quotes.parsed(d).collect()}
    assert got == {0: ("end", 1), 1: ("a\r\n\nb\r", 2), 2: ("On Monday A wrote:\n\nlast", 2)}


def test_quotes_of_a_message_without_a_turn(spark):
    rows = [(1, None, "a", "hello there"), (1, 0, "b", "> hello there\nyes"), (1, 1, "c", "> > hello there\n> yes\nno"), (2, 0, "a", "x y"), (2, 1, "b", ">" * 20000 + " x y\nz"), (2, 2, "c", " > \t> x y\n >\n\t z > w")]
    got = {(r.conv_id, r.turn): r for r in quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, t].n_linked, got[1, t].parent_turn, got[1, t].thread_turn, got[1, t].position) for t in (None, 0, 1)] == [(0, None, None, 0), (1, None, None, 1), (2, 0, None, 2)]
    assert [(got[2, t].quote_depth, got[2, t].n_linked, got[2, t].parent_turn, got[2, t].body) for t in (1, 2)] == [(20000, 1, 0, "z"), (2, 1, 0, " z > w")]
