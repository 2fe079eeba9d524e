"""What several operators share: scratch tables, tables of the test data, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of what this does not match, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset a local session gets a temporary folder; on a cluster, whose executors could not read that, this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jdir.get() if jdir.isDefined() else None
    if not path:
        if not (m := spark.conf.get("spark.master", "")).startswith("local") or m.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a text batch that goes to Python at once: texts have no bound, so few of them may fill a worker's memory.
TEXT_BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session for columns of whole texts; a smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


#: A table of at most so many bytes, as JSON, is broadcast; beyond it the same join shuffles.
MOST_BROADCAST = 32 << 20
#: Partitions over which that shuffle deals the rows of one key.
SALTS = 16


def small_enough(table: DataFrame) -> bool:
    """Whether a stored table is small enough to broadcast, by the measured bytes of all its rows."""
    return (table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= MOST_BROADCAST


def meet(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """big joined to a stored table by equal columns; how is inner, left, left_semi or left_anti.

    small is broadcast if its bytes allow. Beyond that the rows of big are dealt over SALTS partitions a key, each of
    which gets a copy of small's rows of that key: a key that a third of big's rows hold, null included, is split.
    """
    if small_enough(small):
        return big.join(F.broadcast(small), on, how)
    salt = next(f"salt{'_' * i}" for i in range(99) if f"salt{'_' * i}" not in (*big.columns, *small.columns))
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(*[c for c, t in big.dtypes if not t.startswith("map")], F.spark_partition_id()), F.lit(SALTS)))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [*on, salt], how).drop(salt)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    parts = F.split(ascii_lower(F.coalesce(c, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def fresh(name: str, taken: list[str]) -> str:
    """name, with as many underscores after it as make it new."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_key(c: Column) -> Column:
    """With the document id, tells rows apart: rows with equal id and text get equal results."""
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, name: str, few_groups: bool = False) -> DataFrame:
    """df with `out`, the place of a row in its group, gapless from 0, after one range exchange by group and order.

    A group may fill many partitions: the place is the group's rows in partitions before plus the place in its own.
    The order must tell rows apart as far as it matters. few_groups: their number is bounded, so the counts (one row
    per group and partition) are broadcast.
    """
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = store(placed.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    runs = placed.groupBy(*group, "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before_", F.coalesce(F.sum("n_").over(earlier), F.lit(0))).drop("n_")
    joined = placed.join(F.broadcast(runs) if few_groups else runs, [*group, "part_"])
    return joined.withColumn(out, F.col("before_") + F.col("at_") - F.col("first_")).drop("part_", "at_", "first_", "before_")


#: A node with over one in HUBS of all edges is joined by broadcast.
HUBS = 500


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reachable.

    Alternates large-star and small-star steps: edges never multiply, a hub's neighbours are never gathered
    in one row, and the rounds grow with the logarithm of the longest chain. Each round is written to the
    shared folder, which cuts its lineage.
    """

    def star(e: DataFrame, large: bool, edges_now: int) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # Fewer than 2 * HUBS nodes can each have over one in HUBS of all edges: these are broadcast, so no task gets all neighbours of one.
        hubs = F.broadcast(low.where(F.col("n") > edges_now / HUBS).drop("n"))
        j = both.join(hubs, "a").unionByName(both.join(hubs.select("a"), "a", "left_anti").join(low.drop("n"), "a"))
        if large:
            return j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = low.where("a <> m").select("a", F.col("m").alias("b"))
        return j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(own).distinct()

    def seen(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = seen(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        grown = store(star(e, True, before[0]), "large")
        e = store(star(grown, False, grown.count()), "edges")
        now = seen(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
