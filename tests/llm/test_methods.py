"""That operators run by their method, keep columns of any name, and stand texts and groups of any shape."""

import random
import re
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import common, decontaminate, nearest, simhash, toxicity, urls


def test_exact_join_stands_behind_the_filter(spark, monkeypatch):
    plans, rows, real = {}, {}, common.store

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = real(df, name)
        rows[name] = out
        return out

    monkeypatch.setattr(urls, "store", spied)
    listed = urls.listed(spark, 300)
    pages = listed.select(F.concat(F.lit("http://"), "canonical").alias("url")).unionByName(spark.range(20000).select(F.concat(F.lit("http://a.shop/x/"), "id").alias("url"))).withColumn("page_id", F.monotonically_increasing_id())
    judged = urls.judge(pages, listed)
    assert judged.where("verdict = 'block' and rule is null").count() == judged.where("listed").count() == rows["sure"].count() > 3000
    assert "LeftSemi" not in plans["passed"] and "listed-" not in plans["passed"] and "LeftSemi" in plans["sure"]
    # All sure rows passed the filter, and few others of 20,000.
    assert rows["sure"].count() <= rows["passed"].count() < rows["sure"].count() + 200
    assert plans["passed"].count("regexp") == 0  # URLs were taken apart before


def test_urls_by_the_rules_of_the_contract(spark, tmp_path):
    """Words and places of the contract, written out, and the longest rule that fits looked for row by row."""
    rules = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    hosts = [h + e for h in ("", "a.", "example.", "www.example.", "notexample.", "spam-farm.", "www.spam-farm.") for e in ("com", "net", "org", "Net", "netx")]
    urls_ = [f"https://{h}{p}" for h in hosts for p in ("/de/8", "/de/81?q", "/de/7", "/de/", "/de", "/DE/8", "/en/7", "/en/8#x", "/es/", "/x/de/8", "")]
    spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in urls.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        host, slash, rest = u.split("://")[1].partition("/")
        host, path = host.lower(), (slash + rest).split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for (h, p), v in rules.items() if f".{host}".endswith(f".{h}") and path.startswith(p)]
        listed = re.fullmatch(r"(www\.)?spam-farm\.[a-z]+/(de|en|es|fr)/[0-9]+", host + path)
        want = max(fit)[1:] if fit else (None, "block" if listed else "allow")
        assert (got[i].rule, got[i].verdict) == want, u


def test_nearest_equals_brute_force(spark):
    """Lengths that differ much, rows closer than a cell or a code, and ties: rows, order and scores."""
    rng = np.random.default_rng(4)
    n, d = 4000, 32
    free = rng.normal(size=(n, d))
    tables = {"lengths": free * np.exp(rng.normal(size=(n, 1))), "clusters": rng.normal(size=(6, d))[rng.integers(6, size=n)] + 1e-3 * free, "ties": rng.integers(-1, 2, size=(n, d)).astype(float)}
    for name, v in tables.items():
        table = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
        got = nearest.nearest(table).toPandas().sort_values(["query_id", "rank"])
        s = np.zeros((n // 20, n))
        for c in range(d):
            s += v[::20, c][:, None] * v[None, :, c]
        s[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
        for q, row in enumerate(s):
            want, mine = np.lexsort((np.arange(n), -row))[:20], got[got.query_id == q * 20]
            assert list(mine.vec_id) == list(want) and list(mine.score) == list(row[want]), (name, q * 20)


def spared_by_pairs(text, lexicon):
    folded, found = toxicity.fold(text), []
    for p, w in [*lexicon.weights.items(), *((f" {x} ", None) for x in lexicon.exceptions)]:
        at = folded.find(p)
        while at >= 0:
            found.append((at, at + len(p) - 1, w))
            at = folded.find(p, at + 1)
    best = {}
    for s, e, w in found:
        if w is not None and not any(v is None and s >= x and min(e, s + 1) <= y for x, y, v in found):
            best[s] = max(best.get(s, 0.0), w)
    return 100 * sum(best.values()) / max(25, folded.count(" ") - 1)


def test_density_by_pairs_and_of_long_texts():
    lexicon, rng = toxicity.Lexicon(), random.Random(1)
    parts = [w.strip() for w in lexicon.weights] + list(lexicon.exceptions) + ["plain", "can", "of"]
    for _ in range(300):
        t = " ".join(rng.choices(parts, k=rng.randrange(0, 40)))
        assert abs(toxicity.density(t, lexicon) - spared_by_pairs(t, lexicon)) < 1e-9
    long = f"{lexicon.exceptions[0]} " * (1_000_000 // (len(lexicon.exceptions[0]) + 1))
    began = time.time()
    toxicity.density(long, lexicon)
    assert time.time() - began < 5


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"text number {i} of words that differ {i * i} and go on a little longer than five", f"mine{i}", f"yours{i}", i * 7, -i, "d", "t") for i in range(12)] + [(12, None, "n", "n", 0, 0, "d", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, rid string, tk string, toxicity long, dk long, rid_ string, tk_ string").withColumn("toxicity_", F.col("doc_id") + 1).withColumn("dk_", F.lit("x")).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").createOrReplaceTempView("l")
    for stage in (corpus_pipeline.near_duplicates, lambda s, x, f: decontaminate.clean(x, spark.createDataFrame([(1, "none of this")], "item_id long, text string")), lambda s, x, f: corpus_pipeline.toxic(s, x, "/root/testdata/sf0.001")):
        out = stage(spark, d, "")
        assert out.columns == d.columns and sorted(map(str, out.collect())) == sorted(map(str, d.collect()))


def test_clean_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(50)]
    items = {i: rng.choices(vocabulary, k=rng.choice([4, 10, 14])) for i in range(8)}
    texts = {}
    for d in range(60):
        w, q = rng.choices(vocabulary, k=40), list(items[d % 8])
        if d % 3 == 1:
            q[len(q) // 2] = "changed"
        texts[d] = " ".join(w[:20] + (q if d % 4 else []) + w[20:])
    held = lambda t, q: any(t[i : i + min(10, len(q))] == q[s : s + min(10, len(q))] for s in range(max(1, len(q) - 9)) for i in range(len(t)))
    want = {d for d, t in texts.items() if not any(held(t.split(), q) for q in items.values())}
    b = spark.createDataFrame([(i, " ".join(q)) for i, q in items.items()], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.clean(spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string"), b).collect()}
    assert got == want | {99} and 5 < len(want) < 55


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(500, 2000 + i) for i in range(300)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(150)] + [(7, 7), (1, 0)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        part[b] = a
    want = {x: root(x) for a, b in edges for x in (a, b) if a != b}
    for hubs in (500, 3):
        monkeypatch.setattr(common, "HUBS", hubs)
        got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_radius_loses_no_link(monkeypatch):
    rng, wide = random.Random(9), 64
    texts = []
    for n in [1, 2, 3, 5, 8, 13, 20, 40, 80, 160, 300, 700, 2000] * 6:
        ws = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
        texts.append(" ".join(ws))
        for share in (0.80, 0.82, 0.85):
            changed, cut = list(ws), int(n * (1 - share) / (1 + share))  # words at the end: one shingle each
            for i in range(cut):
                changed[-1 - i] = f"u{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    pdf = pd.DataFrame({"text": texts, "wk": np.arange(len(texts))})
    groups = lambda out: len(pd.concat([out["a"], out["b"]]).unique())
    near = simhash._confirm(pdf)
    monkeypatch.setattr(simhash, "RADIUS", wide)
    monkeypatch.setattr(simhash, "_within_ring", lambda x, bits=wide: np.ones(x.shape, bool))
    every = simhash._confirm(pdf)
    assert groups(near) == groups(every) and len(near) == len(every) > 150


def test_ring_budgets_come_before_the_whole_check():
    """Chains prune: of pairs that share a segment's key, fewer pass each longer chain, and no near pair is lost."""
    rng = np.random.default_rng(3)
    flips = rng.integers(0, 64, (200_000, 12))
    x = np.bitwise_xor.reduce(np.where(np.arange(12)[None] < rng.integers(1, 12, 200_000)[:, None], np.uint64(1) << flips.astype("u8"), np.uint64(0)), axis=1)
    n, edges = simhash.SEGMENTS, simhash.EDGES
    d = np.stack([np.bitwise_count(x & simhash._mask(edges[i], edges[i + 1])).astype("i4") for i in range(n)], -1)
    d = np.concatenate([d, d], -1)
    left = []
    for length in range(1, n + 1):
        ok = np.zeros(len(x), bool)
        for i in range(n):
            total = np.cumsum(d[:, i : i + length], -1)
            ok |= (total * n <= simhash.BITS * np.arange(1, length + 1)).all(-1)
        left.append(int(ok.sum()))
    near = np.bitwise_count(x) <= simhash.BITS
    assert left == sorted(left, reverse=True) and len(set(left)) >= 4 and left[-1] == int(simhash._within_ring(x).sum()) >= int(near.sum())
    assert simhash._within_ring(x)[near].all()


def test_splitters_by_a_sort(spark):
    """Each splitter leaves its share of bytes below it, as near as a sort of all keys allows."""
    from pagemill.llm import sharding

    rng = random.Random(12)
    rows = [(rng.randrange(1 << 62), rng.randrange(1, 2000)) for _ in range(5000)] + [(rng.randrange(1 << 40), 50) for _ in range(3000)] + [(7 << 50, 90_000)] * 3
    total = sum(b for _, b in rows)
    targets = [total * i / 8 for i in range(1, 8)]
    bytes_at = {}
    for k, b in rows:
        bytes_at[k] = bytes_at.get(k, 0) + b
    edges, below = [0], 0
    for k in sorted(bytes_at):
        below += bytes_at[k]
        edges.append(below)
    cuts = sharding.splitters(spark.createDataFrame(rows, "key long, size long"), targets, 100.0, 20)
    assert cuts == sorted(cuts)
    for cut, t in zip(cuts, targets, strict=True):
        assert abs(sum(b for k, b in rows if k < cut) - t) <= max(100.0, min(abs(e - t) for e in edges))
