"""Nearest neighbours by shifted space-filling curves, and an exact check of what their windows left out.

Every curve turns the vectors by its own random rotation, keeps a few coordinates, shifts them and orders them along
a Hilbert curve. Each order is cut into cells of equal shares of the rows by the quantiles of its keys, so that Spark
range-partitions it by cell without a sort of the whole. A query meets the rows of the cells around its own: they
travel as codes of 4 bits a component, a shortlist by the codes is merged over the curves, and reranked by the vectors
themselves. Equal vectors are one row until the end, so copies crowd nothing out.

Windows miss neighbours where lengths differ much, or where rows lie closer than a cell or a step of the codes. So the
scores found are floors: a query then meets the vectors of every run of the first curve whose centre, radius and
longest vector allow an inner product at or above its floor, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, meet, store

CURVES, DIMS, LEVELS = 16, 6, 4
#: Cells of a curve in a block, which is what one task scores; rows of a block at most, beyond which its rows are dealt over several tasks; cells of a curve at least and at most.
BLOCK_CELLS, BLOCK_ROWS, CELLS = 16, 16_384, (256, 65_536)
#: Share of all rows on each side of a query that a curve's window holds, and rows that it holds at least.
WINDOW, WINDOW_ROWS = 0.03, 256
#: Rows that go on from all windows of a query to the exact scores, and from one window to these, for each one asked for.
SHORTLIST, FROM_WINDOW = 3, 1.5
#: Numbers in the vectors of a run, or in the queries that meet it at once, in the exact check; copies of queries, and scores, that a task holds at once.
RUN_NUMBERS, COPIES, SCORES = 1 << 20, 1 << 16, 1 << 21


def hilbert(x: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Places on the Hilbert curve of points x (n, dims) with whole coordinates below 2^levels."""
    x = x.T.astype("i8")
    top = 1 << (levels - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(levels - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on a curve; its rotation and shift follow from its number alone.

    A coordinate is brought to even shares of its range by the distribution it has for vectors without direction.
    """
    d = unit.shape[1]
    rng = np.random.default_rng(7919 + curve)
    dims, cells = min(DIMS, d), 1 << LEVELS
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims]
    share = 1 / (1 + np.exp(-1.702 * np.sqrt(d) * (unit @ turn)))
    return hilbert(np.clip(np.floor(share * cells + rng.uniform(-0.5, 0.5, dims)), 0, cells - 1))


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 4 bits a component, two to a byte, and the length of a step: v is about (code - 7.5) * step."""
    step = np.maximum(np.abs(v).max(axis=1), 1e-300) / 7.5
    n = np.clip(np.floor(v / step[:, None] + 8), 0, 15).astype("u1")
    if n.shape[1] % 2:
        n = np.concatenate([n, np.full((len(n), 1), 8, "u1")], axis=1)
    return n[:, ::2] << 4 | n[:, 1::2], step


def decoded(packed: np.ndarray, step: np.ndarray, d: int) -> np.ndarray:
    n = np.empty((len(packed), packed.shape[1] * 2), "f4")
    n[:, ::2], n[:, 1::2] = packed >> 4, packed & 15
    return (n[:, :d] - np.float32(7.5)) * step[:, None].astype("f4")


def units(v: np.ndarray) -> np.ndarray:
    """Vectors of length one, whatever the size of their numbers."""
    most = np.abs(v).max(axis=1, keepdims=True)
    return v / most / np.linalg.norm(v / most, axis=1, keepdims=True)


def slack(d: int, q: np.ndarray, longest: float | np.ndarray) -> np.ndarray:
    """More than what rounding can change in an inner product of d components."""
    return d * 2.0**-50 * np.linalg.norm(q, axis=1) * longest


def checked(q: np.ndarray, floor: np.ndarray, v: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and v, and inner products, of the k best rows of v for each query, none below its floor; ties by `least`."""
    out = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
    longest = np.linalg.norm(v, axis=1).max()
    for a in range(0, len(q), max(1, SCORES // len(v))):
        some = q[a : a + max(1, SCORES // len(v))]
        s, low = some @ v.T, floor[a : a + len(some)]
        if len(v) > k:
            low = np.maximum(low, np.partition(s, len(v) - k, axis=1)[:, len(v) - k])
        i, j = np.nonzero(~(s < (low - slack(v.shape[1], some, longest))[:, None]))
        score = np.zeros(len(i))
        for c in range(v.shape[1]):  # summed in the order of the components, as the shortlist's scores are
            score += some[i, c] * v[j, c]
        order = np.lexsort((least[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        out.append((i[best] + a, j[best], score[best]))
    return tuple(map(np.concatenate, zip(*out)))


def usable(v: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, window: float = WINDOW, block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by `every`. Rows with a null vec_id, and vectors that are null,
    zero, not finite, or not of the commonest length (ties: the shorter), take no part. Of repeated ids with equal
    vectors one counts. Ties go to the smaller vec_id. An empty table gives no rows. A window holds
    WINDOW_ROWS on each side at least, so a small table is met whole. The exact check makes the result that of brute
    force; windows decide what it has to read.
    """
    spark = vectors.sparkSession
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    length = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = length["d"]
    good = good.where(F.size("embedding") == d).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).withColumns({"rep": F.xxhash64("v"), "check": F.xxhash64("v", F.lit(1))})
    # A row per distinct vector; copies are collapsed before anything is exchanged. Two hashes of 64 bits stand for a vector.
    reps = store(good.groupBy("rep", "check").agg(F.first("v").alias("v"), F.min("vec_id").alias("least")).drop("check"), "vectors")
    # The smallest k + 1 ids of a vector are all that any query can be given.
    ids = good.groupBy("rep", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("vec_id"))).where(F.col("n") <= k + 1)  # at most 64 (k + 1) ids a vector go on
    members = store(few.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")), "members")
    asked = store(ids.where(F.pmod("vec_id", F.lit(every)) == 0), "asked")
    asking = store(asked.select("rep").distinct().withColumn("asks", F.lit(True)), "asking")
    n = members.count()
    least, most = CELLS
    cells = int(min(most, max(least, 1 << int(np.ceil(np.log2(max(1, n * BLOCK_CELLS / block)))))))
    reach = int(max(window, WINDOW_ROWS / max(1, n)) * cells)
    deal = max(1, int(np.ceil(n * BLOCK_CELLS / cells / block)))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_numpy()).astype("f8")
            unit = units(v)
            packed, step = codes(v)
            own = pd.DataFrame({"rep": pdf["rep"], "asks": pdf["asks"], "code": [x.tobytes() for x in packed], "step": step.astype("f4")})
            for c in range(curves):
                yield own.assign(curve=np.int8(c), key=curve_keys(unit, c))

    ordered = meet(reps.drop("least"), asking, ["rep"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    ordered = store(ordered.mapInPandas(keyed, "rep long, asks boolean, code binary, step float, curve byte, key int"), "curves")
    # At most CURVES x CELLS numbers, from all rows.
    cuts = {r["curve"]: np.array(r["q"], "i8") for r in ordered.groupBy("curve").agg(F.percentile_approx("key", [i / cells for i in range(1, cells)], 4 * cells).alias("q")).collect()}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the block of their cell, and queries in every block that their window touches; equal keys are dealt over the cells that share them."""
        for pdf in batches:
            curve, key, rep = pdf["curve"].to_numpy(), pdf["key"].to_numpy("i8"), pdf["rep"].to_numpy("i8")
            lo, hi = np.zeros(len(pdf), "i8"), np.zeros(len(pdf), "i8")
            for c in np.unique(curve):
                at = curve == c
                lo[at], hi[at] = np.searchsorted(cuts[c], key[at], "left"), np.searchsorted(cuts[c], key[at], "right")
            pdf["cell"] = lo + (rep % (hi - lo + 1))
            pdf["deal"] = (rep >> 20) % deal
            rows = pdf.assign(asks=False, block=pdf["cell"] // BLOCK_CELLS)
            yield rows[["curve", "block", "deal", "asks", "cell", "rep", "code", "step"]]
            q = pdf[pdf["asks"]]
            a, z = np.maximum(0, q["cell"] - reach) // BLOCK_CELLS, np.minimum(cells - 1, q["cell"] + reach) // BLOCK_CELLS
            times = (z - a + 1).to_numpy()
            q = q.loc[q.index.repeat(times)].assign(block=np.repeat(a.to_numpy(), times) + np.concatenate([np.arange(t) for t in times] or [np.zeros(0, "i8")]))
            for part in range(deal):
                yield q.assign(deal=part)[["curve", "block", "deal", "asks", "cell", "rep", "code", "step"]]

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        """The shortlist of every query over one block of one curve."""
        asks, want = pdf["asks"].to_numpy(), int(FROM_WINDOW * k)
        v = decoded(np.frombuffer(b"".join(pdf["code"]), "u1").reshape(len(pdf), -1), pdf["step"].to_numpy(), d)
        cell, rep = pdf["cell"].to_numpy(), pdf["rep"].to_numpy("i8")
        q, x, out = np.flatnonzero(asks), np.flatnonzero(~asks), []
        order = np.argsort(cell[x], kind="stable")
        x = x[order]
        for c in np.unique(cell[q]):  # queries of one cell have one window, which is one run of rows
            mine = q[cell[q] == c]
            run = x[np.searchsorted(cell[x], c - reach, "left") : np.searchsorted(cell[x], c + reach, "right")]
            if len(run):
                s = v[mine] @ v[run].T
                best = np.argpartition(-s, want - 1, axis=1)[:, :want] if len(run) > want else np.broadcast_to(np.arange(len(run)), s.shape)
                out.append(pd.DataFrame({"query_rep": np.repeat(rep[mine], best.shape[1]), "rep": rep[run][best].ravel(), "near": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_rep": [], "rep": [], "near": []})

    dealt = ordered.mapInPandas(placed, "curve byte, block long, deal long, asks boolean, cell long, rep long, code binary, step float")
    found = dealt.groupBy("curve", "block", "deal").applyInPandas(scored, "query_rep long, rep long, near float")
    found = found.groupBy("query_rep", "rep").agg(F.max("near").alias("near"))
    short = found.withColumn("n", F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("near"), "rep"))).where(F.col("n") <= SHORTLIST * k).select("query_rep", "rep")
    # Exact scores of the shortlists; the query itself is among them where its vector has copies.
    ask_v = store(meet(reps, asking, ["rep"], "left_semi").select(F.col("rep").alias("query_rep"), F.col("v").alias("q")), "queries")
    short = store(short, "shortlist")
    pairs = meet(short.join(reps, "rep"), ask_v, ["query_rep"])
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = store(pairs.select("query_rep", "rep", dot.alias("score")), "scores")

    # The exact check: runs of the first curve, of about RUN_NUMBERS numbers, that can hold a vector at or above a query's floor.
    wide = max(1, min(BLOCK_CELLS, BLOCK_CELLS * RUN_NUMBERS // (block * d)))
    split = max(1, int(np.ceil(n * wide * d / (cells * RUN_NUMBERS))))
    parts = max(1, int(np.ceil(ask_v.count() * d / RUN_NUMBERS)))

    def in_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v, rep = np.stack(pdf["v"].to_numpy()).astype("f8"), pdf["rep"].to_numpy("i8")
            key = curve_keys(units(v), 0)
            lo, hi = np.searchsorted(cuts[0], key, "left"), np.searchsorted(cuts[0], key, "right")
            run = (lo + rep % (hi - lo + 1)) // wide * split + (rep >> 20) % split
            yield pd.DataFrame({"run": run, "rep": rep, "least": pdf["least"], "v": [x.tobytes() for x in v]})

    def described(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(pdf["v"]), "f8").reshape(len(pdf), d)
        centre = v.mean(axis=0)
        return pd.DataFrame({"run": pdf["run"][:1], "centre": [centre], "radius": [np.linalg.norm(v - centre, axis=1).max()], "longest": [np.linalg.norm(v, axis=1).max()]})

    runs = store(reps.mapInPandas(in_runs, "run long, rep long, least long, v binary"), "runs")
    # A row for each RUN_NUMBERS numbers of the table.
    about = runs.groupBy("run").applyInPandas(described, "run long, centre array<double>, radius double, longest double").toPandas()
    at, centre, radius, longest = about["run"].to_numpy("i8"), np.stack(about["centre"].to_numpy()), about["radius"].to_numpy(), about["longest"].to_numpy()

    def dealt_asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query for each run that can hold a vector at or above its floor."""
        some = max(1, COPIES // len(at))
        for pdf in (b.iloc[a : a + some] for b in batches for a in range(0, len(b), some)):
            q = np.stack(pdf["q"].to_numpy()).astype("f8")
            size = np.linalg.norm(q, axis=1)[:, None]
            most = np.minimum(q @ centre.T + size * radius, size * longest) + slack(d, q, longest.max())[:, None]
            i, j = np.nonzero(~(most < pdf["floor"].to_numpy()[:, None]))
            rep, packed = pdf["query_rep"].to_numpy("i8"), np.array([x.tobytes() for x in q], object)
            yield pd.DataFrame({"run": at[j], "part": (rep[i] >> 8) % parts, "query_rep": rep[i], "floor": pdf["floor"].to_numpy()[i], "q": packed[i]})

    def check(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(rows):
            return pd.DataFrame({"query_rep": [], "rep": [], "score": []})
        q, v = (np.frombuffer(b"".join(x), "f8").reshape(len(x), d) for x in (asks["q"], rows["v"]))
        i, j, score = checked(q, asks["floor"].to_numpy(), v, rows["least"].to_numpy("i8"), k + 1)
        return pd.DataFrame({"query_rep": asks["query_rep"].to_numpy("i8")[i], "rep": rows["rep"].to_numpy("i8")[j], "score": score})

    # The score of a query's last place; without one, nothing is too low.
    floors = exact.groupBy("query_rep").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("floor"))
    asks = ask_v.join(floors, "query_rep", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    asks = asks.mapInPandas(dealt_asks, "run long, part long, query_rep long, floor double, q binary").groupBy("run", "part")
    rows = runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).groupBy("run", "part")
    rest = asks.cogroup(rows).applyInPandas(check, "query_rep long, rep long, score double")
    exact = exact.unionByName(rest).groupBy("query_rep", "rep").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_rep").orderBy(F.desc("score"))
    top = exact.withColumn("n", F.rank().over(by)).where(F.col("n") <= k + 1).drop("n")
    each = asked.withColumnsRenamed({"vec_id": "query_id", "rep": "query_rep"}).join(top, "query_rep")
    each = each.join(members, "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: nearest() over the whole table embeddings; odd rows as defined there."""
    return nearest(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
