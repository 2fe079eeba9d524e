"""License scans: ordered signature rules behind a keyword prefilter; contained detections of no higher priority are dropped.

A text is brought to words, and texts without any keyword go no further. The others are cut into segments of SEGMENT
words with the longest rule's words on both sides, so that a text of any length is many bounded rows. In a segment a
rule's expression is only tried where its keyword stands; a detection belongs to the segment in which it starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, meet, store, text_key, words
from .license_rules import LONGEST, RULES, SCORES

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Words of a segment that are its own.
SEGMENT = 256
#: Every rule and base phrase fits only texts with one of these words, or with one of these phrases; other texts go no further.
GATE = """license licence licenses licences licensed licenced unlicense spdx hereby apache asl gpl gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 bsd redistribution
    mpl cddl zlib wtfpl unencumbered odbl eupl cecill evil commons cc0 cc creativecommons domain proprietary rights""".split()
PHRASES = ("under mit",)


def rules() -> list[tuple]:
    """(number, label, priority, score, keyword, regular expression) in order; base phrases come first, with priority 100."""
    out = [(label, 100, p, p) for p, label in BASE]
    for line in RULES.strip().split("\n"):
        label, priority, keyword, rx = line.split(" | ")
        out.append((label, int(priority), keyword, rx))
    return [(i, label, p, SCORES[p], k, f"(?<= )(?:{rx})(?= )") for i, (label, p, k, rx) in enumerate(out)]


def segments(texts: DataFrame) -> DataFrame:
    """(doc_id, dk, first, lead, norm) of texts(doc_id, dk, w): segments as words between single spaces; lead words of the one before come first."""
    at = F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(SEGMENT)))
    s = texts.where("size(w) > 0").select("doc_id", "dk", "w", at.alias("first")).withColumn("lead", F.least("first", F.lit(LONGEST)))
    own = F.slice("w", F.col("first") - F.col("lead") + 1, F.col("lead") + SEGMENT + LONGEST)
    return s.select("doc_id", "dk", "first", "lead", F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")).alias("norm"))


def detections(segs: DataFrame) -> DataFrame:
    """(doc_id, dk, first, lead, rule, label, priority, score, start, end) of all matches in segments; places are words of the segment."""
    every = rules()
    fits = F.array_compact(F.array(*(F.when(F.contains("norm", F.lit(k)) & F.rlike("norm", F.lit(rx)), F.lit(i)) for i, _, _, _, k, rx in every)))
    met = segs.withColumn("rule", F.explode(fits))
    names = ("label", "priority", "score", "rx")
    table = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, (r[1], r[2], r[3], r[5]), strict=True))) for r in every))
    met = met.withColumn("r", F.get(table, F.col("rule"))).select("doc_id", "dk", "first", "lead", "norm", "rule", "r.*")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    met = met.withColumns({"m": F.transform(F.regexp_extract_all("norm", F.col("rx"), F.lit(0)), spaces), "p": F.transform(F.split("norm", F.col("rx"), -1), spaces)})
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + x)
    spans = F.transform("m", lambda n, i: F.struct((total("p", i + 1) + total("m", i) - 1).alias("start"), (total("p", i + 1) + total("m", i) + n).alias("end")))
    return met.select("doc_id", "dk", "first", "lead", "rule", "label", "priority", "score", F.explode(spans).alias("s")).select("doc_id", "dk", "first", "lead", "rule", "label", "priority", "score", "s.*")


def beats(x, y):
    """Whether detection x drops y: it contains it and has a higher priority, or the same and is longer, or equal and comes first."""
    inside = (x["start"] <= y["start"]) & (x["end"] >= y["end"])
    longer = (x["end"] - x["start"]) > (y["end"] - y["start"])
    same = (x["end"] - x["start"]) == (y["end"] - y["start"])
    wins = (x["priority"] > y["priority"]) | ((x["priority"] == y["priority"]) & (longer | (same & (x["rule"] < y["rule"]))))
    # A longer name says more than the shorter one in it, whatever their priorities; base phrases always stay.
    return inside & (x["rule"] != y["rule"]) & (wins | longer) & (y["priority"] < 100)


def kept(found: DataFrame) -> DataFrame:
    """(doc_id, dk, label, priority, score, word) of the detections that no other one beats; word is the place in the text."""
    one = F.struct("rule", "label", "priority", "score", "start", "end")
    per = found.groupBy("doc_id", "dk", "first", "lead").agg(F.collect_list(one).alias("all"))  # of one segment: bounded
    stay = F.filter("all", lambda y: (y["start"] >= F.col("lead")) & (y["start"] < F.col("lead") + SEGMENT) & ~F.exists("all", lambda x: beats(x, y)))
    out = per.select("doc_id", "dk", "first", "lead", F.explode(stay).alias("y"))
    return out.select("doc_id", "dk", "y.label", "y.priority", "y.score", (F.col("first") + F.col("y.start") - F.col("lead")).cast("long").alias("word"))


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs(doc_id, text): counts and places of base phrases, base_labels, labels, score.

    Null, empty and wordless texts have no labels and score 0. Rows with equal id and text get equal results; an empty
    table gives none.
    """
    rid = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
    d = docs.select("doc_id", text_key(F.col("text")).alias("dk"), words(F.col("text")).alias("w"))
    d = d.withColumn("gate", F.arrays_overlap("w", F.array(*map(F.lit, GATE))) | F.exists(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(F.array_join("w", " "), p)))
    d = store(d.select("doc_id", "dk", F.size("w").cast("long").alias("n_words"), F.when(F.col("gate"), F.col("w")).alias("w")), "words")
    found = store(detections(segments(d.where("w is not null").select(rid.alias("doc_id"), "dk", "w"))).distinct(), "detections")
    base = F.col("priority") == 100
    per = kept(found).groupBy("doc_id", "dk").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("word"))).alias("first_word"), F.max(F.when(base, F.col("word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("bl"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("l"), F.max("score").alias("s"),
    ).withColumnRenamed("doc_id", "rid")
    out = meet(d.select("doc_id", rid.alias("rid"), "dk", "n_words"), store(per, "labels"), ["rid", "dk"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("bl", F.lit("")).alias("base_labels"), F.coalesce("l", F.lit("")).alias("labels"), F.coalesce("s", F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: scan() of the whole table documents; odd rows as defined there."""
    return scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
