"""Sharding by histogram sort: exact byte counts below candidate keys, refined until the splitters are good, then one exchange.

The key is a hash of the text, so equal texts are neighbours and stay in one shard. Each round counts the exact bytes
in equal cells of the intervals that still hold a splitter, and keeps the cell it lies in. Groups of equal texts too
heavy for a cell of the tolerated size are placed whole, the heaviest first into the emptiest shard, and leave that
much less for the ordinary rows; a group larger than a shard's share is spread by a hash of text and id instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, load, numbered, store

CELLS = 1024


def _key(*cols: Column) -> Column:
    """A hash from 0 to 2^62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def splitters(keyed: DataFrame, targets: list[float], tolerance: float, rounds: int = 12) -> list[int]:
    """Keys below which about targets[i] bytes of keyed(key, size) lie, each within tolerance bytes where keys allow.

    A round costs one pass over (key, size) and returns at most CELLS counts per open splitter.
    """
    spans, base, done = [(0, 1 << 62)] * len(targets), [0] * len(targets), [None] * len(targets)
    for _ in range(rounds):
        open_spans = sorted({s for s, d in zip(spans, done, strict=True) if d is None})
        if not open_spans:
            break
        cell = F.lit(None).cast("long")
        for n, (lo, hi) in enumerate(open_spans):
            width = max(1, -(-(hi - lo) // CELLS))
            inside = (F.col("key") >= lo) & (F.col("key") < hi)
            cell = F.when(inside, F.expr(f"(key - {lo}L) div {width}L + {n * CELLS}L")).otherwise(cell)
        counts = {r["cell"]: r["b"] for r in keyed.select(cell.alias("cell"), "size").where("cell is not null").groupBy("cell").agg(F.sum("size").alias("b")).collect()}
        for i, t in enumerate(targets):
            if done[i] is not None:
                continue
            lo, hi = spans[i]
            n, width, below = open_spans.index((lo, hi)), max(1, -(-(hi - lo) // CELLS)), base[i]
            for k in range(CELLS):
                b = counts.get(n * CELLS + k, 0)
                if below + b >= t or k == CELLS - 1:
                    a, z = lo + k * width, min(hi, lo + (k + 1) * width)
                    if abs(below - t) <= tolerance or z - a <= 1:
                        done[i] = a if abs(below - t) <= abs(below + b - t) else z
                    elif abs(below + b - t) <= tolerance:
                        done[i] = z
                    spans[i], base[i] = (a, z), below
                    break
                below += b
    return [d if d is not None else s[0] for d, s in zip(done, spans, strict=True)]


def assign(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """docs(doc_id, text, ...) with three columns after its own: size, key and shard; shards differ by about `tolerance` of their mean size.

    size is the UTF-8 bytes of the text plus 1; a null text counts as an empty one and shares its group. Repeated
    rows count each. With fewer or larger texts than the tolerance allows, each splitter takes the nearer side. All
    columns of docs stay: where one has the name of a new column, the new one gets underscores after it. An empty
    table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    size, key, shard, fixed = (fresh(n, docs.columns) for n in ("size", "key", "shard", "fixed"))
    with_size = docs.withColumns({size: F.octet_length(text).cast("long") + 1, key: _key(text)})
    narrow = store(with_size.select("doc_id", F.col(key).alias("key"), F.col(size).alias("size")), "sizes")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    slack = max(1.0, tolerance * share)
    # At most shards / tolerance groups can be that heavy.
    heavy = narrow.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > slack / 2) & (F.col("n") > 1))
    groups = sorted(((r["b"], r["key"]) for r in heavy.collect()), reverse=True)
    spread, load, placed = [k for b, k in groups if b > share], [0.0] * shards, {}
    for b, k in groups:
        if b <= share:
            s = min(range(shards), key=lambda i: (load[i], i))
            if load[s] + b > share:
                continue  # no room: it stays among the ordinary rows
            load[s] += b
            placed[k] = s
    spark = docs.sparkSession
    special = spark.createDataFrame([(k, -1) for k in spread] + list(placed.items()), "special_key long, special_fixed int")

    def marked(df: DataFrame, key: str, fixed: str) -> DataFrame:
        d = df.join(F.broadcast(special), F.col(key) == F.col("special_key"), "left").select(*df.columns, F.col("special_fixed").alias(fixed))
        return d.withColumn(key, F.when(F.col(fixed) == -1, _key(key, "doc_id")).otherwise(F.col(key)))

    light = marked(narrow, "key", "fixed").where("fixed is null or fixed < 0").select("key", "size")
    room, targets = [share - x for x in load], []
    for r in room[:-1]:
        targets.append((targets[-1] if targets else 0) + r)
    cuts = splitters(light, targets, slack / 2)
    below = sum((F.when(F.col(key) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    out = marked(with_size, key, fixed).withColumn(shard, F.when(F.col(fixed) >= 0, F.col(fixed)).otherwise(below).cast("int"))
    return out.select(*docs.columns, size, key, shard)


def slots(assigned: DataFrame) -> DataFrame:
    """Rows of an assigned table, whose last two columns are key and shard, exchanged once into their order, with slot, gapless from 0 in each shard."""
    key, shard = assigned.columns[-2:]
    return numbered(assigned, [shard], [key, "doc_id"], fresh("slot", assigned.columns), "placed", few_groups=True)


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """All columns of docs, one folder per shard, in slot order within each file."""
    assigned = assign(docs, shards)
    slots(assigned).write.partitionBy(assigned.columns[-1]).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the whole table documents under the law `bytes`; odd rows as assign() defines."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    slim = assign(docs).select("doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), "key", "shard")
    return slots(slim).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
