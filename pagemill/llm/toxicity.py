"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, store, text_batches

#: Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {c: None for c in "​‌‍⁠﻿­"})

#: Insults with their weights, and phrases in which they are none.
INSULTS = {"idiot": 4.0, "idiots": 4.0, "moron": 4.0, "morons": 4.0, "loser": 4.0, "losers": 4.0, "scum": 4.0, "stupid": 3.5, "pathetic": 3.5,
           "worthless": 3.5, "disgusting": 3.5, "trash": 3.5, "clown": 3.5, "imbecile": 4.0, "vermin": 3.5, "filth": 3.5}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "idiot proof", "sore loser", "stupid simple", "class clown", "pond scum")

_GAP = re.compile(r"[\W_]+")
#: The same folding for texts of Latin-1 only: a letter or digit becomes what FOLD makes of it, all else a gap; soft hyphens go.
LATIN = bytes(ord(FOLD.get(i) or chr(i)) if (FOLD.get(i) or chr(i)).isalnum() else 32 for i in range(256))


def fold(text: str | None) -> str:
    """Lower case, look-alikes and substituted digits as letters, words between single spaces."""
    low = (text or "").lower()
    try:
        return " " + b" ".join(low.encode("latin-1").translate(LATIN, b"\xad").split()).decode("latin-1") + " "
    except UnicodeEncodeError:
        return " " + _GAP.sub(" ", low.translate(FOLD)).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Patterns with weights (" stem" fits word starts, " word " whole words), exception phrases, and the logistic scale."""

    weights: dict = field(default_factory=lambda: {f" {w} ": x for w, x in INSULTS.items()})
    exceptions: tuple = EXCEPTIONS
    bias: float = -4.0
    slope: float = 2.5

    def __hash__(self):
        return hash((tuple(self.weights.items()), self.exceptions, self.bias, self.slope))


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon):
    a = ahocorasick.Automaton()
    for p, w in lexicon.weights.items():
        a.add_word(p, (len(p), w))
    for p in lexicon.exceptions:
        a.add_word(f" {p} ", (len(p) + 2, None))
    if len(a):
        a.make_automaton()
    return a


def density(text: str | None, lexicon: Lexicon) -> float:
    """Sum of the weights of matches outside exception phrases, per 100 words (short texts count as 25 words)."""
    return _density(text, _automaton(lexicon))


def _density(text: str | None, a) -> float:
    folded = fold(text)
    if not len(a):
        return 0.0
    found = [(end - n + 1, end, w) for end, (n, w) in a.iter(folded)]
    if not found:
        return 0.0
    best: dict[int, float] = {}
    reach = -1  # where the exception phrases that begin here or before end
    for s, e, w in sorted(found, key=lambda f: (f[0], f[2] is not None)):
        if w is None:
            reach = max(reach, e)
        elif min(e, s + 1) > reach:
            best[s] = max(best.get(s, 0.0), w)
    return 100 * sum(best.values()) / max(25, folded.count(" ") - 1)


def score_texts(texts, lexicon: Lexicon) -> np.ndarray:
    a = _automaton(lexicon)  # looked up once: that hashes the whole lexicon
    x = np.array([_density(t, a) for t in texts], dtype="f8")
    return 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * np.log1p(x), -30, 30)))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1. Null and empty texts have no match: they get the score of density 0."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(score_texts(t, lexicon))

    text_batches(docs.sparkSession)
    return docs.withColumn(out, scored(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row must not be learnt from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


STEMS = range(4, 9)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For a bounded sample: (pattern, label, texts, places) and under '' (label, texts, words)."""
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    places: tuple[Counter, Counter] = (Counter(), Counter())
    for pdf in batches:
        for t, y in zip(pdf["text"], pdf["y"], strict=True):
            own: Counter = Counter()
            ws = fold(t).split()
            for w, n in Counter(ws).items():
                own[f" {w} "] += n
                for k in STEMS:
                    if len(w) >= k:
                        own[f" {w[:k]}"] += n
            docs[y].update(own.keys())
            places[y].update(own)
            docs[y][""] += 1
            places[y][""] += len(ws)
    for y in (0, 1):
        keys = list(docs[y])
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            yield pd.DataFrame({"pattern": part, "y": y, "texts": [docs[y][k] for k in part], "places": [places[y][k] for k in part]})


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 5000) -> Lexicon:
    """The fixed insults plus word stems and words that toxic texts use far more often, and the logistic scale.

    Learns from at most max_toxic and max_clean labelled rows (a bounded sample, by a hash of doc_id) whose doc_id
    is not held out; doc_id, lang, source and the labels are no inputs of a score. Rows with null doc_id, label or
    conflicting labels teach nothing. With no toxic or no clean row the fixed lexicon and scale are returned. Every
    pattern that passes the tests is kept: that bounded sample alone bounds them.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y1")).where("y = y1").select("doc_id", "y")
    )
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    ids = taken[0].unionByName(taken[1]).toPandas()  # at most max_toxic + max_clean rows
    if not len(ids) or ids["y"].nunique() < 2:
        return Lexicon()
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame(list(ids.itertuples(index=False, name=None)), known.schema))  # ids of any type
    text_batches(spark)
    sample = store(docs.select("doc_id", "text").join(few, "doc_id").select("text", "y"), "labelled")
    counts = store(
        sample.mapInPandas(_counted, "pattern string, y int, texts long, places long")
        .groupBy("pattern")
        .agg(*(F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for y in (0, 1) for c in ("texts", "places"))),
        "stems",
    )
    base = counts.where("pattern = ''").first()
    if base is None or not base["places0"] or not base["places1"]:
        return Lexicon()
    least = max(3, math.ceil(0.004 * base["texts1"]))
    frequent = counts.where((F.col("pattern") != "") & (F.col("texts1") >= least)).withColumn("g2", g2(base["texts1"], base["texts0"]))
    sure = 2 * math.log(max(2, frequent.count()))  # so that chance alone is expected to pass about one pattern of all tried
    rate1, rate0 = (F.col("places1") + 0.1) / base["places1"], (F.col("places0") + 0.5) / base["places0"]
    rows = (
        frequent.where(F.col("g2") >= sure).withColumn("w", F.log(rate1 / rate0)).where("w >= 1.8").collect()
    )
    lexicon = Lexicon(weights={f" {w} ": x for w, x in INSULTS.items()} | chosen(rows))
    seen = sample.select("y", _density_udf(lexicon)(F.col("text")).alias("x")).toPandas()  # two numbers of each sampled row
    weight = {y: total[y] / max(1, (seen["y"] == y).sum()) for y in (0, 1)}
    bias, slope = _logistic(np.log1p(seen["x"].to_numpy("f8")), seen["y"].to_numpy("f8"), seen["y"].map(weight).to_numpy("f8"))
    return Lexicon(lexicon.weights, lexicon.exceptions, bias, slope)


def g2(n1: int, n0: int) -> Column:
    """Log-likelihood ratio statistic of texts1 of n1 toxic against texts0 of n0 clean texts."""
    k1, k0 = F.col("texts1"), F.col("texts0")
    p, x = (k1 + k0) / F.lit(n1 + n0), F.lit(0.0)
    for k, n in ((k1, n1), (k0, n0), (F.lit(n1) - k1, n1), (F.lit(n0) - k0, n0)):
        q = p if k is k1 or k is k0 else 1 - p
        x = x + F.when(k > 0, k * F.log(k / (q * n))).otherwise(0.0)
    return 2 * x


def chosen(rows) -> dict[str, float]:
    """Of stems that are prefixes of each other, those whose weight no shorter one reaches but for 15 %."""
    best: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["pattern"]), r["pattern"])):
        p, w = r["pattern"], r["w"]
        if not any(best.get(p[:k], 0) >= 0.85 * w for k in range(5, len(p))):
            best[p] = w
    return dict(sorted(best.items()))


def _density_udf(lexicon: Lexicon):
    @F.pandas_udf("double")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([density(x, lexicon) for x in t])

    return f


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Bias and slope of a ridge logistic regression of one feature."""
    A, b, p = np.stack([np.ones_like(x), x], 1), np.zeros(2), np.diag([0.0, ridge])
    for _ in range(60):
        m = 1 / (1 + np.exp(-np.clip(A @ b, -30, 30)))
        g = A.T @ (w * (y - m)) - p @ b
        H = (A * (w * m * (1 - m))[:, None]).T @ A + p + 1e-6 * np.eye(2)
        step = np.linalg.solve(H, g)
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(0.0, b[1]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Every row of docs with held_out, score and predicted (columns of these names are replaced).

    Null, empty and wordless texts get the score of density 0; a null doc_id is held out; repeated rows are scored
    each; an empty table gives none.
    """
    scored = score(docs.drop("held_out", "score", "predicted"), learn(docs, labels))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def query(spark, sf_dir: str) -> DataFrame:
    """op4: classify() of the whole table documents, learnt from labels; odd rows as defined there."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
