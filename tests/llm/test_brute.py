"""Operators against brute force on generated input, odd keys, and both ways of joining."""

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from pagemill.llm import common, decontaminate, licenses, quotes, secrets, sharding, simhash, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("most", [1 << 25, 0])  # broadcast, and the shuffle that splits keys
def test_meet_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    big = spark.createDataFrame([(i, i % 3 if i % 5 else None, "x") for i in range(200)], "i long, k long, salt string").repartition(4)
    small = common.store(spark.createDataFrame([(0, "a"), (1, "b"), (None, "n"), (9, "z")], "k long, v string"), "small")
    got = {how: sorted((tuple(r) for r in common.meet(big, small, ["k"], how).collect()), key=str) for how in ("inner", "left", "left_semi", "left_anti")}
    monkeypatch.setattr(common, "MOST_BROADCAST", 1 << 25)
    assert got == {how: sorted((tuple(r) for r in big.join(small, "k", how).select(*(["k", "i", "salt"] + (["v"] if how in ("inner", "left") else []))).collect()), key=str) for how in got}


def near_and_exact(texts, items, slop=2):
    """Per text: exact places, and items with a near or exact place, by comparing every window with every place."""
    docs, df = {d: low_words(t) for d, t in texts.items()}, {}
    for w in docs.values():
        for x in w:
            df[x] = df.get(x, 0) + 1
    out = {d: (set(), set(), set()) for d in docs}
    for item, text in items.items():
        q = low_words(text)
        n = min(10, len(q))
        for s in range(max(1, len(q) - 9) if q else 0):
            win = q[s : s + n]
            rare = sorted((df[x], x, o) for o, x in enumerate(win) if x in df)
            need = len(set(win)) - n // 5
            if not rare:
                continue
            (_, ta, oa), (_, tb, ob) = rare[0], rare[min(1, len(rare) - 1)]
            for d, w in docs.items():
                for p in range(-oa, len(w) - oa):
                    if p >= 0 and w[p : p + n] == win:
                        out[d][0].update(range(p, p + n))
                        out[d][1].add(str(item))
                        out[d][2].add(str(item))
                    lo = max(0, p - slop)
                    span = w[lo : lo + n + 2 * slop]
                    beside = any(lo <= p + ob + x < lo + len(span) and w[p + ob + x] == tb for x in range(-slop, slop + 1))
                    if w[p + oa] == ta and beside and len(set(win) & set(span)) >= need:
                        out[d][2].add(str(item))
    return out


def test_near_passages(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 10, 25]))) for i in range(12)}
    texts = {}
    for d in range(40):
        w = rng.choices(vocabulary, k=60)
        q = items[d % 12].split()
        if d % 3:
            for j in range(4, len(q), 10):  # a word in ten changed, or one put in
                q[j : j + d % 2] = ["changed"]
        if d % 4:
            w[20:20] = q
        texts[d] = " ".join(w)
    want = near_and_exact(texts, items)
    got = decontaminate.contamination(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    for r in got:
        hit, exact, near = want[r.doc_id]
        assert (r.n_hit, r.n_items, r.n_near, r.near_items) == (len(hit), len(exact), len(near), ",".join(sorted(near)))
    assert sum(r.n_near > r.n_items for r in got) >= 10


def test_licenses_by_brute_force(spark):
    rng = random.Random(3)
    names = ["Released under the MIT License.", "MIT", "cc-by-nc", "CC BY-NC-SA 4.0", "GNU General Public License version 2", "gpl", "under the BSD license", "SPDX-License-Identifier: Apache-2.0", "Apache License, Version 2.0", "the", "license is MIT", "all rights reserved", "mozilla public licence 2.0", "under", "word"]
    texts = {i: " ".join(rng.choices(names, k=rng.randrange(1, 30))) for i in range(60)} | {100: None, 101: "", 102: "...", 103: "plain words only"}
    every = licenses.rules()
    for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("first", F.lit(1))).collect():
        w = low_words(texts[r.doc_id])
        norm, found = f" {' '.join(w)} ", []
        for i, label, priority, score, _, rx in every:
            found += [(norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), priority, i, label, score) for m in re.finditer(rx, norm)]
        drops = lambda x, y: x[0] <= y[0] and x[1] >= y[1] and x[3] != y[3] and y[2] < 100 and (x[2] > y[2] or x[1] - x[0] > y[1] - y[0] or (x[2] == y[2] and x[:2] == y[:2] and x[3] < y[3]))
        stay = [y for y in found if not any(drops(x, y) for x in found)]
        base = sorted(y[0] for y in stay if y[2] == 100)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), base[0] if base else None, base[-1] if base else None)
        assert r.base_labels == ",".join(sorted({y[4] for y in stay if y[2] == 100})) and r.labels == ",".join(sorted({y[4] for y in stay})) and r.score == max((y[5] for y in stay), default=0.0)


def test_every_license_rule_passes_the_gate():
    held = re.compile(r"(?<![a-z0-9])(?:" + "|".join(licenses.GATE + list(licenses.PHRASES)) + ")(?![a-z0-9])|licen\\[sc\\]e|unlicense")
    assert len(licenses.rules()) > 200
    for _, label, _, _, keyword, rx in licenses.rules():
        assert held.search(rx), (label, rx)
        assert len(rx.split()) <= licenses.LONGEST


def test_license_text_of_any_length(spark):
    d = spark.createDataFrame([(1, "under the MIT license, all rights reserved; " * 20000)], "doc_id long, text string")
    began = time.time()
    r = licenses.scan(d).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (140000, 20000, 0, 139993, "mit,proprietary") and time.time() - began < 60


def threads(rows):
    """parent, thread root and body of generated messages (conv, turn, text), as thread() defines them, message by message."""
    intro = re.compile(r"^[ \t]*(on|am|le|el) .+(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$", re.I)
    out, said = {}, {}
    key = lambda ls: " ".join(low_words(" ".join(ls)))
    for conv, turn, text in sorted(rows):
        ls = []
        for x in (text or "").split("\n"):
            m = re.match(r"^((?:[ \t]*>)*)[ \t]?", x)
            ls.append((m[1].count(">"), x[m.end() :]))
        kept = []
        for i, (d, x) in enumerate(ls):
            after = next((e for e, y in ls[i + 1 :] if y.strip()), None)
            if not (intro.match(x) and after is not None and after > d):
                kept.append((d, x))
        parts, before = [], None
        for d, x in kept:
            if x.strip():
                if before is None or before != d:
                    parts.append((d, []))
                parts[-1][1].append(x)
                before = d
            else:
                before = None
        votes, linked = {}, 0
        for d, p in parts:
            if d:
                hits = {}
                for whole, k in [(True, key(p)), *((False, key([x])) for x in p)]:
                    if k and (conv, k) in said:
                        t = said[conv, k]
                        w, n = hits.get(t, (False, 0))
                        hits[t] = (w or whole, n + 1)
                if hits:
                    linked += 1
                    t = max(hits, key=lambda t: (*hits[t], t))
                    votes[d, t] = votes.get((d, t), 0) + 1
        parent = min(votes, key=lambda v: (v[0], -votes[v], -v[1]))[1] if votes else None
        own = [p for d, p in parts if not d]
        body = "\n\n".join("\n".join(p) for p in own)
        for k in [key([body]), *(key(p) for p in own), *(key([x]) for p in own for x in p)]:
            if k:
                said.setdefault((conv, k), turn)
        out[conv, turn] = (parent, turn if parent is None else out[conv, parent][1], body, sum(d > 0 for d, _ in parts), linked)
    return out


def test_quotes_by_brute_force(spark):
    rng, rows = random.Random(7), []
    for conv in range(12):
        texts = []
        for turn in range(12):
            lines = []
            for _ in range(rng.randrange(3)):
                if texts and rng.random() < 0.8:
                    if rng.random() < 0.4:
                        lines.append(rng.choice(["On Monday A wrote:", "Am Abend schrieb:", "On the road he wrote: no"]))
                    old = rng.choice(texts).split("\n")
                    a = rng.randrange(len(old))
                    lines += [("> " if rng.random() < 0.9 else ">") + x for x in old[a : a + rng.randrange(1, 5)]]
                if rng.random() < 0.5:
                    lines.append("")
            lines += [" ".join(rng.choices(["alpha", "beta", "Gamma,", "delta", "eps"], k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.2:
                lines.append("On the road he wrote:")
            texts.append("\n".join(lines))
        rows += [(conv, t, x) for t, x in enumerate(texts)]
    want = threads(rows)
    got = quotes.thread(spark.createDataFrame([(c, t, "a", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and sum(r.n_linked > 0 for r in got) > 40
    for r in got:
        assert (r.parent_turn, r.thread_turn, r.body, r.n_quotes, r.n_linked) == want[r.conv_id, r.turn], (r, want[r.conv_id, r.turn])
    for c in range(12):
        order = sorted((r.thread_turn, r.turn) for r in got if r.conv_id == c)
        assert [x for _, x in order] == [r.turn for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)]


def test_introductions_without_a_quote_stay(spark):
    texts = ["On the road he wrote:\nkeep me", "Am Abend schrieb:", "On " + "x" * 300 + " wrote:\n> old\nnew"]
    d = spark.createDataFrame([(1, i, "a", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.body for r in quotes.thread(d).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: "new"}


def base_spans(text):
    """Every base span by trying every place, character by character."""
    word, out = "password passwd secret token apikey api_key".split(), []
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    i = 0
    while i < len(text):
        w = next((w for w in word if "".join(c.lower() if c in string.ascii_letters else c for c in text[i : i + len(w)]) == w), None)
        j = i + len(w) if w else 0
        if w:
            j += j < len(text) and text[j] in "\"'"
            while j < len(text) and text[j] == " ":
                j += 1
            if j < len(text) and text[j] in ":=":
                j += 1
                while j < len(text) and text[j] == " ":
                    j += 1
                j += j < len(text) and text[j] in "\"'"
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    out += [(i, k, "assign")] if k - j >= 6 else []
                    i = k
                    continue
        i += 1
    for kind, ok, head, least in (("access", string.ascii_uppercase + string.digits, "AKIA", 20), ("hex", "0123456789abcdef", "", 24)):
        i = 0
        while i < len(text):
            if text.startswith(head, i) and i + len(head) < len(text) and text[i + len(head)] in ok:
                k = i + len(head)
                while k < len(text) and text[k] in ok:
                    k += 1
                out += [(i, k, kind)] if k - i >= least else []
                i = k
            else:
                i += 1
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_spans_by_brute_force():
    rng, path = random.Random(5), secrets.vocabulary_path()
    parts = ["token", "API_KEY", "secret", " : ", "=", "'", '"', " ", "AKIA", "ABCDEFGHIJKLMNOPQRST", "deadbeefdeadbeef", "0123456789abcdef", "é", "x", "Z9", "\n", "passwd", "abcdef", "-"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert [s for s in secrets.spans(t, path) if s[2] != "random"] == base_spans(t), t


def test_scans_take_linear_time():
    path, began = secrets.vocabulary_path(), time.time()
    for t in ("a" * 10000 + "1b", "1b" + "a" * 10000, "ab" * 5000 + "1b" + "ab" * 5000, "token=abcdef1 " * 20000 + "kQ9xZr7TbW2vLp8NcY5mHs3D", "Ab" * 5000 + "1b"):
        secrets.spans(t, path)
    assert time.time() - began < 10
    assert secrets.spans("kQ9xZr7TbW2vLp8NcY5mHs3D", path, known=frozenset(["kQ9xZr7TbW2vLp8NcY5mHs3D"])) == []


def test_density_by_brute_force():
    rng = random.Random(8)
    lexicon = toxicity.Lexicon(weights={" idiot ": 4.0, " idio": 2.0, " trash ": 3.5, " zor": 1.5, " zorgl": 2.5}, exceptions=("trash can", "idiot proof"))
    for _ in range(500):
        t = " ".join(rng.choices(["Idiot", "1d10t", "idiots", "trash", "can", "zorgly", "zor", "proof", "idiot-proof", "word", "іdіоt", "trash, can"], k=rng.randrange(0, 40)))
        folded = toxicity.fold(t)
        spared = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?= {p} )", folded)]
        best = {}
        for p, w in lexicon.weights.items():
            for i in range(len(folded)):
                if folded.startswith(p, i) and not any(a <= i and min(i + len(p) - 1, i + 1) <= b for a, b in spared):
                    best[i] = max(best.get(i, 0), w)
        assert toxicity.density(t, lexicon) == pytest.approx(100 * sum(best.values()) / max(25, folded.count(" ") - 1))


def test_ids_that_are_texts(spark):
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(200)], "doc_id string, toxic int")
    docs = spark.createDataFrame([(f"d{i}", "quiet words " * 9 + ("zorgly zorgler " if i % 2 else "")) for i in range(200)], "doc_id string, text string")
    assert any(p.startswith(" zorg") for p in toxicity.learn(docs, labels).weights)


def test_shards_keep_all_columns(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i}", "mykey", 77, "mine", 5) for i in range(100)], "doc_id long, text string, key string, size int, shard string, slot int")
    sharding.write_shards(d, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {"key", "size", "shard", "slot", "key_", "size_", "shard_", "slot_"} <= set(got.columns) and got.count() == 100
    assert got.where("key = 'mykey' and size = 77 and shard = 'mine' and slot = 5").count() == 100 and got.select("shard_").distinct().count() == 4


def test_deduplicate_loses_no_text(spark):
    rows = [(1, "T of five words here"), (3, "T of five words here"), (3, "U has another text altogether"), (5, "A alone"), (5, "B alone"), (None, "N without an id"), (None, "N without an id"), (None, "M without an id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("mine"), "wk": F.lit(1)})
    got = simhash.deduplicate(d)
    assert got.columns == d.columns and got.where("fp <> 'mine'").isEmpty()
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[4], rows[5], rows[7]], key=str)


def test_large_groups_are_compared_by_chunks(spark, monkeypatch):
    rng, rows = random.Random(6), []
    base = [f"w{i}" for i in range(200)]
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"another text number {i} of its own") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(r.doc_id for r in simhash.deduplicate(d).collect())
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert sorted(r.doc_id for r in simhash.deduplicate(d).collect()) == whole == [0, *range(100, 120)]
