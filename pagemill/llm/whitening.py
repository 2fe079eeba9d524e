"""Embedding whitening: a digit-slice GEMM gives the covariance exactly, an eigendecomposition the components.

Vectors become integers, and centred ones too (n times a vector less the sums). A task cuts those into limbs of LIMB
bits and multiplies limbs of a block of BLOCK rows with float64 BLAS: products of 2 * LIMB bits summed over BLOCK rows
stay under 2^53, so they are exact. Limbs are put together as big integers, of which each task gives one per pair of
dimensions, in halves that Spark adds up without loss. The driver gets dimensions^2 / 2 sums, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, store

#: Bits of a limb and rows of a block: 2 * 20 + 12 < 53.
LIMB, BLOCK = 20, 1 << 12
#: Components of a result.
COMPONENTS = 4
#: Big integers travel as high * 2^HALF + low.
HALF = 60
#: An eigenvalue below this share of the trace is none: that direction has no spread.
FLAT = 1e-12


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, x) of vectors(vec_id, embedding) that are whole: x holds floor(256 * entry), each as 8 bytes; beyond a long it ends at the long's ends."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for e in pdf["embedding"]:
                c = np.floor(256 * np.asarray(e, dtype="f8"))
                big = np.abs(c) >= 2.0**63
                x = np.where(big, 0, c).astype("<i8")
                x[big] = np.where(c[big] > 0, np.iinfo("i8").max, np.iinfo("i8").min)
                out.append(x.tobytes())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "dims": pdf["embedding"].map(len), "x": out})

    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = vectors.where(F.col("embedding").isNotNull()).where(~odd).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return whole.mapInPandas(of, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, dims int, x binary")


def _matrix(xs) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype="<i8") for x in xs])


def sums(fit: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension over fit(x)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, low = np.zeros(dims, dtype=object), np.zeros(dims, dtype=object)
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["x"])
                high += (x >> 32).sum(axis=0).astype(object)  # 32 bits each: a batch cannot overflow
                low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pd.DataFrame({"d": range(dims), "s": [Decimal(h * 2**32 + lo) for h, lo in zip(high.tolist(), low.tolist(), strict=True)]})

    rows = fit.select("x").mapInPandas(of, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s")).collect()
    return [int(r.s) for r in sorted(rows, key=lambda r: r.d)]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, as longs if they fit and else as big integers."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, s))
    return n * x - np.array(s, dtype="i8") if most < 2**62 else n * x.astype(object) - np.array(s, dtype=object)


def gram(y: np.ndarray) -> np.ndarray:
    """y^T y of integers, exactly, as big integers."""
    dims = y.shape[1]
    out = np.zeros((dims, dims), dtype=object)
    for i in range(0, len(y), BLOCK):
        rest, limbs = y[i : i + BLOCK], []
        while ((rest != 0) & (rest != -1)).any():
            limbs.append((rest & ((1 << LIMB) - 1)).astype("f8"))
            rest = rest >> LIMB
        if rest.any():  # what is left is -1 where a number was negative: a last limb with that sign
            limbs.append(rest.astype("f8"))
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                if b >= a:
                    p = (left.T @ right).astype("i8").astype(object)
                    out += (p if a == b else p + p.T) * (1 << (LIMB * (a + b)))
    return out


def products(fit: DataFrame, n: int, s: list[int]) -> list[list[int]]:
    """The exact sums of products of centred dimensions, n^2 * n times their covariance."""
    dims = len(s)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims), dtype=object)
        for pdf in batches:
            if len(pdf):
                total += gram(centred(_matrix(pdf["x"]), n, s))
        i, j = np.triu_indices(dims)
        flat = total[i, j].tolist()
        yield pd.DataFrame({"i": i, "j": j, "high": [Decimal(v >> HALF) for v in flat], "low": [Decimal(v & ((1 << HALF) - 1)) for v in flat]})

    rows = fit.select("x").mapInPandas(of, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out = [[0] * dims for _ in range(dims)]
    for r in rows:
        out[r.i][r.j] = out[r.j][r.i] = (int(r.high) << HALF) + int(r.low)
    return out


def components(g: list[list[int]], n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes, eigenvalues, explained) of the covariance g / n^3, largest first; of either sign of an axis that whose largest entry is positive."""
    v = np.array([[float(Fraction(x, n**3)) for x in row] for row in g])
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    e, axes = e[order], axes[:, order]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    trace = float(Fraction(sum(g[i][i] for i in range(len(g))), n**3))
    return axes, e, e / trace if trace > 0 else np.zeros(len(e))


def _project(x: np.ndarray, n: int, s: list[int], axes: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (centred(x, n, s).astype("f8") / n) @ (axes / np.sqrt(e))


def identity_error(fit: DataFrame, n: int, s: list[int], axes: np.ndarray, e: np.ndarray) -> float:
    """The largest entry of the covariance of whitened vectors of fit(x) less the identity."""
    k = len(e)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for pdf in batches:
            if len(pdf):
                w = _project(_matrix(pdf["x"]), n, s, axes, e)
                total, first = total + w.T @ w, first + w.sum(axis=0)
        yield pd.DataFrame([(i, j, total[i, j], first[i]) for i in range(k) for j in range(k)], columns=["i", "j", "p", "m"])

    rows = fit.select("x").mapInPandas(of, "i int, j int, p double, m double").groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("m").alias("m")).collect()
    mean = {r.i: r.m / n for r in rows}
    return max((abs(r.p / n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in rows), default=0.0)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """For each row of vectors(vec_id, embedding) and each of the first components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those with null or non-finite entries give no rows. Others of another length than most of the
    table (of equally many the longer) and empty ones take no part either, as no covariance holds them. Repeated rows,
    and rows without a vec_id, have rows each; equal vectors count once in n and in the covariance. A component without
    spread (all vectors alike, say) has whitened null and is left out of identity_error. A deviation beyond a long is
    null. An empty table gives no rows. Other columns are not read.
    """
    own = store(scaled(vectors.select("vec_id", "embedding")), "scaled")
    lengths = [(r["n"], r["dims"]) for r in own.where("dims > 0").groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()]
    kind = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return own.sparkSession.createDataFrame([], kind)
    dims = lengths[0][1]
    own = own.where(F.col("dims") == dims)
    fit = store(own.select("x").distinct(), "fit")
    n = fit.count()
    s = sums(fit, dims)
    axes, e, explained = components(products(fit, n, s), n, most)
    spread = int((explained > FLAT).sum())
    error = identity_error(fit, n, s, axes[:, :spread], e[:spread])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, k = _matrix(pdf["x"]), len(e)
            y = centred(x, n, s)
            fits = y.dtype != object and int(np.abs(y).max()) ** 2 * dims < 2**63
            far = (y * y).sum(axis=1) if fits else (y.astype(object) ** 2).sum(axis=1)
            w = np.full((len(pdf), k), np.nan)
            w[:, :spread] = _project(x, n, s, axes[:, :spread], e[:spread])
            flat = w.ravel().astype(object)
            flat[np.isnan(w.ravel())] = None
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].repeat(k), "component": np.tile(np.arange(1, k + 1), len(pdf)), "n": n,
                "deviation": pd.array([int(d) if d < 2**63 else None for d in far], dtype="Int64").repeat(k),
                "whitened": flat, "explained": np.tile(explained, len(pdf)), "identity_error": error,
            })

    return own.select("vec_id", "x").mapInPandas(of, kind)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: whiten() of the whole table embeddings."""
    return whiten(load(spark, sf_dir, "embeddings"))
