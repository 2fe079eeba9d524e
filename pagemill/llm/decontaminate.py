"""Benchmark decontamination over a distributed positional inverted index of the training texts.

The index holds a posting (document, place) for every place of a term that some window of test words is looked up by:
its two rarest. The rarest term's postings, shifted by its place in the item, are intersected with the equally shifted
postings of the next rarest, up to `slop` places apart; what is left is compared word by word. Equal words are an exact
occurrence; a window of which all but one word in five stand there is a near one. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, load, meet, store, text_key, words

WINDOW, SLOP = 10, 2


def row_id(doc_id: str = "doc_id") -> Column:
    """A document id that equals itself where it is null."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00"))


def test_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, tk, at, term) of every word of every item, and n, the item's words."""
    w = benchmark.select("item_id", text_key(F.col("text")).alias("tk"), words(F.col("text")).alias("w")).distinct()
    return w.select("item_id", "tk", F.size("w").alias("n"), F.posexplode("w").alias("at", "term"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): places in docs of each of the stored terms(term) that occurs; counted before anything is exchanged."""
    return meet(docs.select(F.explode(words(F.col("text"))).alias("term")), terms, ["term"], "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, dk, term, pos) of the stored terms(term), by document, and one (term null, pos = words) a row of docs."""
    w = docs.select("doc_id", text_key(F.col("text")).alias("dk"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    # The place before the first stands for the number of words.
    every = w.select("doc_id", "dk", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "term"), "n")
    hit = meet(every, terms.select("term", F.lit(True).alias("known")), ["term"], "left").where("known or pos = 0")
    return hit.select("doc_id", "dk", F.when(F.col("pos") > 0, F.col("term")).alias("term"), F.when(F.col("pos") > 0, F.col("pos") - 1).otherwise(F.col("n")).alias("pos"))


def windows(terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows with their words, how many distinct ones a near occurrence needs, and their two rarest terms that occur, with places.

    (ik, item_id, start, len, words, need, ta, oa, tb, ob): ik stands for the item and its text, o counts from start.
    Windows of which too few terms occur anywhere are left out: nothing can match them.
    """
    t = terms.join(counts, "term", "left").withColumn("ik", F.xxhash64(row_id("item_id"), "tk"))
    last = F.greatest(F.lit(0), F.col("n") - window)
    starts = t.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.least("at", last))))
    g = starts.groupBy("ik", "item_id", "start", F.least("n", F.lit(window)).alias("len")).agg(
        F.sort_array(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "term", F.expr("at - start").alias("o"))))).alias("r"), F.array_sort(F.collect_list(F.struct("at", "term"))).alias("w")
    )
    g = g.withColumn("words", F.col("w.term")).withColumn("need", F.size(F.array_distinct("words")) - F.expr("len div 5"))
    g = g.where((F.size("r") > 0) & (F.size(F.array_distinct("r.term")) >= F.col("need")))
    g = g.withColumns({"a": F.col("r")[0], "b": F.element_at("r", F.least(F.lit(2), F.size("r")))})
    return g.select("ik", "item_id", "start", "len", "words", "need", *(F.col(f"{x}.{y}").alias(z) for x, y, z in (("a", "term", "ta"), ("a", "o", "oa"), ("b", "term", "tb"), ("b", "o", "ob"))))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(index, found): found has (doc_id, dk, item_id, pos, len, exact), the places of docs where a window of an item occurs.

    A near occurrence (exact is false) has the window's rarest term in its place, the next rarest at most `slop` words
    from its own, and all but len / 5 of the window's distinct words among the len + 2 slop words around it.
    """
    terms = store(test_terms(benchmark), "terms")
    counts = store(term_counts(docs, store(terms.select("term").distinct(), "vocabulary")), "counts")
    wins = store(windows(terms, counts, window), "windows")
    rare = wins.select(F.explode(F.array("ta", "tb")).alias("term")).distinct()
    index = store(build_index(docs, store(rare, "rare")), "index")
    # An alignment is item place 0's place in a document: windows that share a term's place share its postings.
    first, second = (
        meet(index.where("term is not null"), store(wins.select(F.col(t).alias("term"), "ik", (F.col("start") + F.col(o)).alias("at")).distinct(), "lists"), ["term"]).withColumn("al", F.col("pos") - F.col("at"))
        for t, o in (("ta", "oa"), ("tb", "ob"))
    )
    # Only a hash of the second list's alignments is exchanged; what it lets through wrongly fails the comparison below.
    shifts = F.explode(F.array(*(F.col("al") + d for d in range(-slop, slop + 1))))
    near = first.select("doc_id", "dk", "ik", "at", "al", shifts.alias("by")).withColumn("k", F.xxhash64("doc_id", "dk", "ik", "by"))
    both = near.join(second.select(F.xxhash64("doc_id", "dk", "ik", "al").alias("k")), "k", "left_semi").select(row_id().alias("rid"), "doc_id", "dk", "ik", "at", "al").distinct()
    own = store(wins.select("ik", (F.col("start") + F.col("oa")).alias("at"), "start", "len"), "own")
    both = store(meet(both, own, ["ik", "at"]).select("rid", "doc_id", "dk", "ik", "start", "len", (F.col("al") + F.col("start")).alias("pos")), "candidates")
    # The words of the few documents that are left, of each of which only the spans around candidates go on.
    some = store(both.select("rid", "dk").distinct(), "candidate_documents")
    texts = meet(docs.select(row_id().alias("rid"), text_key(F.col("text")).alias("dk"), "text"), some, ["rid", "dk"], "left_semi")
    texts = texts.dropDuplicates(["rid", "dk"]).select("rid", "dk", words(F.col("text")).alias("w"))
    each = both.groupBy("rid", "doc_id", "dk").agg(F.collect_set(F.struct("ik", "start", "len", "pos")).alias("c"))
    begin = lambda c: F.greatest(F.lit(0), c["pos"] - slop)
    cut = F.transform("c", lambda c: F.struct(c["ik"].alias("ik"), c["start"].alias("start"), c["pos"].alias("pos"), (c["pos"] - begin(c)).alias("lead"), F.slice("w", begin(c) + 1, c["len"] + 2 * slop).alias("span")))
    cut = texts.join(each, ["rid", "dk"]).select("doc_id", "dk", F.explode(cut).alias("c")).select("doc_id", "dk", "c.*")
    met = meet(cut, wins, ["ik", "start"])
    exact = (F.col("pos") >= 0) & (F.slice("span", F.greatest(F.lit(0), F.col("lead")) + 1, F.col("len")) == F.col("words"))
    enough = F.size(F.array_intersect("words", "span")) >= F.col("need")
    beside = F.arrays_overlap(F.array(*(F.get("span", F.col("lead") + F.col("ob") + d) for d in range(-slop, slop + 1))), F.array("tb"))
    met = met.select("doc_id", "dk", "item_id", "pos", "len", exact.alias("exact"), (enough & F.coalesce(beside, F.lit(False))).alias("near"))
    return index, met.where("exact or near").drop("near")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Every row of docs with n_words, n_hit (words within an exact occurrence), n_items, items_sha256, contaminated, n_near and near_items.

    near_items lists the n_near items with an exact or near occurrence, comma-joined. Null, empty and wordless texts
    have no words and are clean, as is everything against an empty benchmark. Rows with equal id and text get equal
    results; items of equal id count once, but each of their texts is searched. Items without an id mark words and
    documents, but no id of theirs is counted or listed.
    """
    index, found = occurrences(docs, benchmark, window, slop)
    found = store(found.withColumn("rid", row_id()), "found")
    end = F.col("pos") + F.col("len")
    by = Window.partitionBy("rid", "dk").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.where("exact").select("rid", "dk", "pos", "len").distinct().withColumn("reached", F.coalesce(F.max(end).over(by), F.lit(0)))
    hits = spans.groupBy("rid", "dk").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("pos", "reached"))).alias("n_hit"))
    name = F.col("item_id").cast("string")
    items = found.groupBy("rid", "dk").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), name))).alias("items"), F.array_sort(F.collect_set(name)).alias("near"))
    per = store(items.join(hits, ["rid", "dk"], "left"), "contaminated")
    rows = index.where("term is null").select("doc_id", row_id().alias("rid"), "dk", F.col("pos").cast("long").alias("n_words"))
    out = meet(rows, per, ["rid", "dk"], "left")
    none = F.array().cast("array<string>")
    n_hit, listed, near = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", none), F.coalesce("near", none)
    return out.select(
        "doc_id", "dk", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.size(near).cast("long").alias("n_near"), F.array_join(near, ",").alias("near_items"),
    )


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = 5) -> DataFrame:
    """(doc_id, item_id, pos, len, exact): places where a window of an item stands word for word or nearly, as occurrences() defines it."""
    return occurrences(docs, benchmark, slop=slop)[1].drop("dk").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an exact occurrence of a benchmark window; null and wordless texts stay, repeated rows alike."""
    _, found = occurrences(docs, benchmark, slop=0)  # near occurrences do not count here, so postings are not shifted
    rid, dk = fresh("rid", docs.columns), fresh("dk", docs.columns)
    bad = store(found.where("exact").select(row_id().alias(rid), F.col("dk").alias(dk)).distinct(), "contaminated")
    keyed = docs.withColumns({rid: row_id(), dk: text_key(F.col("text"))})
    return meet(keyed, bad, [rid, dk], "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: contamination() of the whole table documents against benchmark; rows as defined there, none for an empty table."""
    return contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")).drop("dk")


_W = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents), b AS (SELECT DISTINCT item_id, {_W} AS w FROM benchmark),
wins AS (SELECT *, row_number() OVER () AS wid FROM (SELECT item_id, list_slice(w, s, s + least(len(w), 10) - 1) AS q
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT len(q) AS n FROM wins),
cuts AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, item_id, p, n FROM cuts JOIN wins ON list_slice(w, p, p + n - 1) = q),
per AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY doc_id),
places AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d), df AS (SELECT term, count(*) AS n FROM places GROUP BY 1),
r AS (SELECT wid, df.n AS n, term, o, row_number() OVER (PARTITION BY wid ORDER BY df.n, term, o) AS i, count(*) OVER (PARTITION BY wid) AS c FROM (SELECT wid, unnest(q) AS term, unnest(range(len(q))) AS o FROM wins) JOIN df USING (term)),
pair AS (SELECT wid, item_id, q, a.term AS ta, a.o AS oa, z.term AS tz, z.o AS oz, len(list_distinct(q)) - len(q) // 5 AS need FROM wins JOIN r a USING (wid) JOIN r z USING (wid) WHERE a.i = 1 AND z.i = least(2, z.c)),
spans AS (SELECT doc_id, item_id, q, need, tz, list_slice(w, greatest(p - oa - 2, 0) + 1, greatest(p - oa - 2, 0) + len(q) + 4) AS span,
          list_slice(w, greatest(p - oa + oz - 2, 0) + 1, greatest(p - oa + oz + 2, -1) + 1) AS beside FROM pair JOIN places ON places.term = ta JOIN d USING (doc_id)),
near AS (SELECT doc_id, item_id FROM spans WHERE len(list_intersect(list_distinct(q), span)) >= need AND list_contains(beside, tz) UNION SELECT doc_id, item_id FROM hits),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS near_items FROM near GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)
"""
