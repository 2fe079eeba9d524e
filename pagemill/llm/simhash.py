"""SimHash near-duplicates: fingerprints linked at few differing bits, candidates pruned by a ring of segments.

Pigeonring: cut the 64 bits into BITS + 1 segments in a ring. If two fingerprints differ in at most BITS bits, some
chain of consecutive segments keeps, at every length, within its proportional budget BITS / (BITS + 1) a segment:
its first segment is equal and its first two differ in at most one bit together. So pairs meet under a key of one
exact segment and the next with at most one flipped bit, and only pairs that meet are checked on all 64 bits.

At a similarity of 0.8 two fingerprints differ in 10 bits or so and in up to RADIUS, too many for segments to be keys:
there deduplicate() brings texts together by minima of their shingles, the ring prunes the pairs, then all 64 bits
are checked, and the shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, load, meet, store, text_batches, text_key

BITS = 4
SEGMENTS = BITS + 1
#: Fingerprints of more than one in HEAVY of all rows are joined by broadcast.
HEAVY = 10_000
EDGES = [round(i * 64 / SEGMENTS) for i in range(SEGMENTS + 1)]

#: Near copies: words of a shingle, least Jaccard similarity, and differing bits beyond which no pair is that similar (but for 1 in 10^6 or so).
SHINGLE, LEAST, RADIUS = 5, 0.8, 26
#: Two texts of similarity s share one of BANDS bands of ROWS minima with a chance of 1 - (1 - s^ROWS)^BANDS: 0.999997 at 0.8.
ROWS, BANDS = 4, 24
#: Texts, and bytes of them, of a group that one task compares; larger groups are compared chunk by chunk.
CHUNK, CHUNK_BYTES = 4096, 64 << 20
_rng = np.random.default_rng(7)
_MUL, _ADD = _rng.integers(1, 1 << 63, ROWS * BANDS, dtype="u8") | np.uint64(1), _rng.integers(0, 1 << 63, ROWS * BANDS, dtype="u8")


def fingerprint(text: str | None, n: int = 4) -> int:
    """64 bits; a bit is set if it is in over half the hashes of the text's word n-grams. No words: 0."""
    ws = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not ws:
        return 0
    grams = [b" ".join(ws)] if len(ws) < n else map(b" ".join, zip(*(ws[i:] for i in range(n)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=">u8")
    counts = np.zeros(64, dtype="i8")
    for i in range(0, len(h), 8192):
        counts += np.unpackbits(h[i : i + 8192].view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fp, the fingerprint as a signed long. Null and empty texts get 0."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(np.array([fingerprint(x) for x in t], dtype="u8").view("i8"))

    return docs.withColumn("fp", of(F.col(text)))


def _mask(lo: int, hi: int) -> np.uint64:
    return np.uint64(((1 << (hi - lo)) - 1) << lo)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys under which a fingerprint meets others: per segment its own, and one for each set bit of the next segment."""
    for pdf in batches:
        for fp in np.array_split(pdf["fp"].to_numpy("i8").view("u8"), max(1, len(pdf) // 4096)):
            for i in range(SEGMENTS):
                j = (i + 1) % SEGMENTS
                pair = fp & (_mask(EDGES[i], EDGES[i + 1]) | _mask(EDGES[j], EDGES[j + 1]))
                at, keys = [np.arange(len(fp))], [pair]
                for b in range(EDGES[j], EDGES[j + 1]):
                    has = np.flatnonzero(fp & np.uint64(1 << b))
                    at.append(has)
                    keys.append(pair[has] ^ np.uint64(1 << b))
                yield pd.DataFrame({"seg": np.int8(i), "key": np.concatenate(keys).view("i8"), "fp": fp[np.concatenate(at)].view("i8")})


def _within_ring(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether the differing bits x admit a chain of the bits + 1 segments that keeps within its budgets at every length."""
    n = bits + 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    d = np.stack([np.bitwise_count(x & _mask(edges[i], edges[i + 1])).astype("i4") for i in range(n)], -1)
    d = np.concatenate([d, d], -1)
    ok = np.zeros(x.shape, bool)
    for i in range(n):
        total = np.cumsum(d[..., i : i + n], -1)
        ok |= (total * n <= bits * np.arange(1, n + 1)).all(-1)
    return ok


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a run's links join: at most one fewer than its fingerprints, however many pairs are near."""
    left, out = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = left ^ queue[0]
            near = _within_ring(x)
            near[near] = np.bitwise_count(x[near]) <= BITS
            top = queue.pop(0)
            queue += list(left[near])
            out += [(top, y) for y in left[near]]
            left = left[~near]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by seg and key: the links within each run of equal keys."""
    rest = None

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        seg, key, fp = pdf["seg"].to_numpy(), pdf["key"].to_numpy("i8"), pdf["fp"].to_numpy("i8").view("u8")
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        x = fp[two] ^ fp[two + 1]
        near = (x != 0) & _within_ring(x)
        near[near] = np.bitwise_count(x[near]) <= BITS
        a, b = [fp[two][near]], [fp[two + 1][near]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if pairs := _forest(np.unique(fp[s : s + n])):
                p = np.array(pairs, dtype="u8")
                a.append(p[:, 0])
                b.append(p[:, 1])
        return pd.DataFrame({"a": np.concatenate(a).view("i8"), "b": np.concatenate(b).view("i8")})

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf.iloc[-1]
        same = (pdf["key"].to_numpy() == last["key"]) & (pdf["seg"].to_numpy() == last["seg"])
        rest, done = pdf[same], pdf[~same]
        if len(done):
            yield linked(done.reset_index(drop=True))
    if rest is not None and len(rest):
        yield linked(rest.reset_index(drop=True))


def links(fps: DataFrame) -> DataFrame:
    """Links a, b that connect what all pairs of distinct fingerprints at BITS or fewer differing bits connect."""
    keyed = fps.select("fp").distinct().mapInPandas(_keys, "seg byte, key long, fp long")
    return keyed.repartition("seg", "key").sortWithinPartitions("seg", "key").mapInPandas(_links, "a long, b long").distinct()


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links; ids that are null take no part in that minimum, and
    it is null only where a whole component has none. Repeated rows get equal results. An empty table gives none.
    """
    own = store(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    reps = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    parts = connected_components(links(own))
    linked = parts.select(F.col("node").alias("fp"), "component").join(reps, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("fp", "least")
    by_fp = store(reps.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"), "by_fingerprint")
    # Fewer than HEAVY (a fixed number) fingerprints can each hold over one in HEAVY of all rows: these are broadcast, so no task gets all their copies.
    heavy = F.broadcast(by_fp.where(F.col("n") > own.count() / HEAVY))
    rest = own.join(heavy.select("fp"), "fp", "left_anti").join(by_fp, "fp")
    return own.join(heavy, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # ASCII letters and ASCII white space only, as for fingerprints


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of SHINGLE words; of all its words if they are fewer; none without words."""
    ws = _words(text)
    grams = ([b" ".join(ws)] if ws else []) if len(ws) < SHINGLE else map(b" ".join, zip(*(ws[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), dtype="u8"))


def bands(text: str | None) -> list[int]:
    """Hashes of the BANDS groups of minima, as signed longs; none without words."""
    h = shingles(text)
    if not len(h):
        return []
    low = np.full(ROWS * BANDS, np.iinfo("u8").max, dtype="u8")
    for i in range(0, len(h), 1024):
        # The product's high bits depend on all bits of the hash, its low ones on few: the shift folds them.
        x = h[i : i + 1024, None] * _MUL + _ADD
        np.minimum(low, ((x ^ (x >> np.uint64(31))) * _MUL).min(axis=0), out=low)
    own = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(own[b].tobytes(), seed=b) for b in range(BANDS)], dtype="u8").view("i8").tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, tk, wk, keys, bytes): the key of the text, of its words, the bands, and the text's bytes."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("wk long, keys array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in batches:
            wk = np.array([xxhash.xxh3_64_intdigest(b" ".join(_words(x))) for x in t], dtype="u8").view("i8")
            yield pd.DataFrame({"wk": wk, "keys": pd.Series([bands(x) for x in t], dtype=object)})

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
    return docs.select("doc_id", text_key(F.col("text")).alias("tk"), of(F.col("text")).alias("s"), size).select("doc_id", "tk", "s.wk", "s.keys", "bytes")


def _set_fingerprint(h: np.ndarray) -> int:
    bits = np.unpackbits(h.astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(bits * 2 > len(h)).tobytes(), "big")


def _confirm(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join what all pairs of these texts at LEAST or more join: at most one fewer than the texts."""
    sets = [shingles(t) for t in pdf["text"]]
    wk, sizes, out = pdf["wk"].to_numpy("i8"), np.array([len(x) for x in sets]), []
    fps, left = np.array([_set_fingerprint(x) for x in sets], dtype="u8"), np.arange(len(sets))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            top = queue.pop()
            x = fps[left] ^ fps[top]
            # No set of under 0.8 or over 1.25 times the size can be similar enough.
            near = (np.minimum(sizes[left], sizes[top]) >= LEAST * np.maximum(sizes[left], sizes[top])) & _within_ring(x, RADIUS)
            near &= np.bitwise_count(x) <= RADIUS
            for i in np.flatnonzero(near):
                common = len(np.intersect1d(sets[top], sets[left[i]], assume_unique=True))
                near[i] = common >= LEAST * (sizes[top] + sizes[left[i]] - common)
            queue += left[near].tolist()
            out += [(wk[top], wk[y]) for y in left[near]]
            left = left[~near]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) over reps(wk, first, keys, bytes) that connect what all found pairs at LEAST or more connect; docs hold the texts."""
    keyed = store(reps.select(F.explode("keys").alias("key"), "wk"), "bands")
    least = keyed.groupBy("key").agg(F.min("wk").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = keyed.join(least, "key").where("wk <> least").select(F.col("least").alias("a"), F.col("wk").alias("b")).distinct()
    groups = store(connected_components(edges).withColumnRenamed("node", "wk"), "groups")
    held = groups.join(reps.select("wk", "bytes"), "wk").groupBy("component").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).alias("chunks"))
    sizes = store(held.where("chunks > 1"), "large")
    some = meet(groups, sizes, ["component"], "left").join(reps.select("wk", "first"), "wk").select("component", F.coalesce("chunks", F.lit(1)).alias("chunks"), "wk", _rid("first.doc_id").alias("rid"), "first.tk")
    # Only texts with a candidate are exchanged, once a pair of chunks of their group.
    met = meet(docs.select(_rid("doc_id").alias("rid"), text_key(F.col("text")).alias("tk"), "text"), store(some, "candidates"), ["rid", "tk"])
    met = met.dropDuplicates(["component", "wk"]).withColumn("chunk", F.pmod(F.xxhash64("wk"), F.col("chunks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "wk", "text")
    return met.groupBy("component", "i", "j").applyInPandas(_confirm, "a long, b long")


def _rid(doc_id: str):
    """A document id that equals itself where it is null."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each group of near copies keeps one: that of its smallest doc_id, then text key; null ids come last.

    Groups are connected by similarities of LEAST or more of the sets of shingles of SHINGLE words; rows without words
    (null, empty) are one group. Equal ids alone make no copies; of rows of equal id and text one stays. Other columns
    are kept as they are. An empty table gives none.
    """
    own = store(_keyed(docs), "keyed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    reps = store(own.groupBy("wk").agg(F.min(first).alias("first"), F.first("keys").alias("keys"), F.max("bytes").alias("bytes"), F.count("*").alias("n")), "words")
    parts = connected_components(near_links(docs, reps)).withColumnRenamed("node", "wk")
    near = store(parts.join(reps.select("wk", "first"), "wk"), "near")
    heads = near.groupBy("component").agg(F.min("first").alias("head"))
    losers = store(near.join(heads, "component").where("first <> head").select("wk").distinct(), "losers")
    # What goes: rows whose words are kept elsewhere, and of words of several rows all but the first. All else needs no look at its group.
    twins = store(reps.where("n > 1").select("wk", "first"), "twins")
    lost = meet(own, losers, ["wk"], "left_semi").select("doc_id", "tk")
    other = meet(own, twins, ["wk"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk")))).select("doc_id", "tk")
    on = [fresh("rid", docs.columns), fresh("tk", docs.columns)]
    keys = lambda df: df.select(_rid("doc_id").alias(on[0]), F.col("tk").alias(on[1]))
    gone = store(keys(lost.unionByName(other)).distinct(), "copies")
    out = meet(docs.withColumns({on[0]: _rid("doc_id"), on[1]: text_key(F.col("text"))}), gone, on, "left_anti")
    repeated = store(keys(own).groupBy(*on).count().where("count > 1").drop("count"), "repeated")
    if not repeated.isEmpty():  # rows of equal id and text: only these are exchanged
        some = meet(out, repeated, on, "left_semi").dropDuplicates(on)
        out = meet(out, repeated, on, "left_anti").unionByName(some)
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: components() of the whole table documents; null and empty texts have fingerprint zero and are linked by it."""
    found = components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
