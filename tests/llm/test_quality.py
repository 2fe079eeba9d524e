"""Quality counts and verdicts by brute force; the order of a cascade changes no verdict."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagemill.llm import quality


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    held = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held)


def texts():
    rng, words = random.Random(8), [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}ä" for i in range(300)]
    clean = " ".join(rng.choices(words, k=120)) + "."
    out = {
        1: None, 2: "", 3: " \t\n\r\x0b", 4: "one", 5: "a b", 6: "a b c", 7: "a b c a b c", 8: "x " * 400, 9: clean, 10: clean.upper(), 11: clean.replace(" ", " | "),
        12: "\n".join(["line of words here"] * 5 + [" "] * 4 + [clean]), 13: "a b a b a b a " + clean, 14: "b c d \x1fe  f " * 20, 15: " ".join(str(rng.random()) for _ in range(90)),
        16: "\n".join(f"- {' '.join(rng.choices(words, k=9))}" for _ in range(12)), 17: "\n".join(f"{' '.join(rng.choices(words, k=9))}..." for _ in range(12)), 18: clean + " Lorem Ipsum", 19: clean.replace(" ", "!! "),
        20: " ".join(rng.choices(words, k=30000)), 21: "x" * 500000, 22: "\U0001f600 " * 60 + clean, 23: "dup\n dup\ndup \ndup\n\n\n" + clean,
    }
    for i in range(100, 140):
        out[i] = " ".join(rng.choices(["a", "b", "c", "d"], k=rng.randrange(1, 90))) + rng.choice(["", " " + clean])
    return out


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, t, "mine", 7, 1) for i, t in texts().items()] + [(None, texts()[9], "mine", 7, 1), (9, texts()[9], "mine", 7, 1)]
    return quality.judge(spark.createDataFrame(rows, "doc_id long, text string, w string, n_words int, extra int").repartition(3)).cache()


def test_counts_by_brute_force(judged):
    rows = judged.collect()
    assert len(rows) == len(texts()) + 2
    for r in rows:
        want = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.extra == 1


def test_verdicts(judged):
    got = {r.doc_id: r for r in judged.collect()}
    assert {i for i in range(1, 24) if got[i].kept} == {9, 13, 20, 23}
    # The order of the cascade is measured, so a text that several rules reject may name any of them.
    assert got[18].rejected_by == "placeholder" and got[10].rejected_by == "shouting" and got[11].rejected_by in ("symbols", "letters") and not any(got[i].kept for i in (1, 2, 3, 4, 8))
    assert all((r.rejected_by is None) == r.kept for r in got.values())


def test_order_changes_no_verdict(spark):
    d = quality.counted(spark.createDataFrame(list(texts().items()), "doc_id long, text string"))
    names, seen = list(quality.RULES), set()
    for order in (names, names[::-1]):
        seen.add(tuple(sorted(r.doc_id for r in d.where(quality.cascade(quality.RULES, order).isNull()).collect())))
    assert len(seen) == 1


def test_rejections_per_cost():
    assert quality.ordered({"slow": 10.0, "fast": 1.0, "idle": 0.1}, {0b001: 50, 0b010: 10, 0b011: 10, 0: 30}) == ["fast", "slow", "idle"]
    assert quality.ordered({"a": 1.0, "b": 1.0, "c": 1.0}, {0b011: 50, 0b100: 20, 0b001: 1}) == ["a", "c", "b"]  # b rejects nothing that a leaves


def test_later_rules_are_not_evaluated(spark):
    d = spark.range(5).selectExpr("id", "if(id < 3, 'x', 'y') as text")
    rules = {"first": "text = 'x'", "then": "if(text = 'x', raise_error('evaluated'), 'z') = 'y'"}
    assert d.where(quality.cascade(rules, ["first", "then"]).isNull()).count() == 2


def test_long_texts_of_one_kind(spark):
    """Runs without a letter, of line ends, of spaces or of dots take time in proportion to their length under every rule."""
    n = 200_000
    texts = ["0" * n, "\n" * n, " " * n + "x", "." * n + "x", "!" * n, "- \n" * n, "\n \n" * n + "-", "... " * n, "a" * n + "0" * n, "#" * n]
    d = quality.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    began = time.time()
    d.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in quality.RULES.items())).collect()
    assert time.time() - began < 60


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
