"""Findings of the review over the training-data operators and the pipeline."""

import random
import string

from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import decontaminate, secrets, simhash, urls


def test_one_case_keys_and_long_paths():
    path, rng = secrets.vocabulary_path(), random.Random(1)
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        keys = ["".join(rng.choices(letters, k=40)) for _ in range(50)]
        assert sum(secrets.spans(f"key {k} end", path) == [(4, 44, "random")] for k in keys) >= 45
    for s in ("/documentation/configuration/administration/installation-2/guide", "/" + "documentation/" * 2000 + "-2/guide", "geschwindigkeitsbegrenzungen", "THIS_IS_A_CONSTANT_NAME", "getElementsByClassNameOrId"):
        assert secrets.spans(s, path) == []


def test_listed_pages_have_no_largest_number(spark, tmp_path):
    rows = [
        ("http://www.spam-farm.example.org/fr/1200.html", "block"), ("https://spam-farm.example.org:443/fr/98765/?q", "block"), ("http://ads-track.example.com/de/0", "block"),
        ("http://spam-farm.example.org/it/1200", "allow"), ("http://spam-farm.example.org/fr/01200", "allow"), ("http://x.spam-farm.example.org/fr/1200", "allow"), (None, "allow"),
    ]
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in urls.query(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(rows))] == [v for _, v in rows]


def test_benchmark_item_without_id(spark):
    item = "one two three four five six seven eight nine ten eleven"
    b = spark.createDataFrame([(None, item), (7, "other words")], "item_id long, text string")
    d = spark.createDataFrame([(1, f"zero {item} end"), (2, "some other words"), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(d, b).collect()}
    assert got == {1: (11, 0, True), 2: (2, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.clean(d, b).collect()] == [3]


def test_stage_drops_copies_near_the_limit(spark):
    rng, rows = random.Random(4), []
    for g in range(40):
        ws = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((10 * g, " ".join(ws)))
        for c in range(1, 4):  # words changed far apart: 5 shingles each
            near = list(ws)
            for i in range(2 + 2 * c + g % 3):
                near[20 + 30 * i] = f"new{g}-{c}-{i}"
            rows.append((10 * g + c, " ".join(near)))
    rows += [(None, rows[0][1]), (7000, "one text of an id"), (7000, "another text of this id"), (7001, "One text  of AN id"), (7002, ""), (7003, None), (7004, "one text of an id")]
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)))) or {t.lower()} if t else set() for _, t in rows]
    part = list(range(len(rows)))
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    same = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    words = [" ".join((t or "").lower().split()) for _, t in rows]
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if key(part[j]) < key(part[i]) and (words[i] == words[j] or sets[i] and sets[j] and same(sets[i], sets[j])):
                    part[i], moved = part[j], True
    want = sorted(((rows[i][0], rows[i][1] or "") for i in set(part)), key=str)
    assert 40 < len(want) < len(rows) - 10
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.near_duplicates(spark, d, "")
    assert got.columns == d.columns and sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == want
    assert simhash.deduplicate(d.where("false")).isEmpty()
