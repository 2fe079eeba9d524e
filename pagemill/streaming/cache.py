"""The page cache as a stream: a keyed state holds the last write of every page; each micro-batch adds only the pages it changed.

Many batches are compacted: the pages as of a batch become one table, and the batches up to it go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T

KEY = ["document_id", "page"]
ROW = "document_id long, page string, payload double"
#: Batches that may stand beside the last compaction.
MOST_BATCHES = 16


def cache_stream(spark: SparkSession, source: str, folder: str, schema, files_at_once: int = 2) -> DataFrame:
    """(document_id, page, payload) after all events in the Parquet files of source, in the order (ts, event_id).

    The state lives in the query's checkpoint under `folder`, so a stream that is started again goes on where it ended
    and an event counts once. A batch writes its changed pages under its number: repeated, it writes the same. No
    events give an empty table.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    order = F.struct("ts", "event_id")
    last = events.groupBy(F.col("user_id").alias("document_id"), F.col("event_type").alias("page")).agg(F.max_by("value", order).alias("payload"))
    updates = f"{folder}/updates"

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    last.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return compacted(spark, folder)


def _table(spark: SparkSession, path: str, number: str) -> DataFrame:
    """Rows under path, a folder for each number; none where it is missing or holds no file."""
    fs, at = _files(spark, path)
    if not fs.exists(at) or not any(s.isDirectory() for s in fs.listStatus(at)):
        return spark.createDataFrame([], f"{ROW}, {number} long")
    return spark.read.schema(f"{ROW}, {number} long").parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, finished: bool = False) -> list[int]:
    """Numbers of the folders under path; of those written to the end only, if finished."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
    done = [n for n in names if not finished or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return sorted(int(n.getName().split("=")[1]) for n in done)


def compacted(spark: SparkSession, folder: str, most: int = MOST_BATCHES) -> DataFrame:
    """(document_id, page, payload) of the last compaction and the batches since, which become a new compaction if they are more than `most`.

    Run again after it broke off it starts from what was whole: a compaction counts once its table is finished, and
    what it replaces goes after that. Results of earlier runs are read anew then.
    """
    updates, whole = f"{folder}/updates", f"{folder}/whole"
    upto = max(_numbers(spark, whole, finished=True), default=-1)
    old = _table(spark, whole, "upto").where(F.col("upto") == upto).select(*KEY, "payload", F.col("upto").alias("batch"))
    new = _table(spark, updates, "batch").where(F.col("batch") > upto)
    last = old.unionByName(new).groupBy(*KEY).agg(F.max_by("payload", "batch").alias("payload"))
    since = [n for n in _numbers(spark, updates) if n > upto]
    if len(since) <= most:
        return last
    last.write.mode("overwrite").parquet(f"{whole}/upto={since[-1]}")
    for path, name, numbers in ((updates, "batch", [n for n in _numbers(spark, updates) if n <= since[-1]]), (whole, "upto", [n for n in _numbers(spark, whole) if n < since[-1]])):
        for n in numbers:
            fs, at = _files(spark, f"{path}/{name}={n}")
            fs.delete(at, True)
    return compacted(spark, folder, most)


def _query(spark, sf_dir):
    """The events in several files, so that the state passes through several batches."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{shared}/cache-{uuid.uuid4().hex}"
    events = T.table(spark, sf_dir, "events")
    events.repartition(6, "event_id").write.parquet(f"{folder}/events")
    return cache_stream(spark, f"{folder}/events", f"{folder}/state", events.schema)


Q = {"ocr_cache_stream": _query}
O = {"ocr_cache_stream": T.oracle("log", "SELECT document_id, page, arg_max(payload, (ts, event_id)) AS payload FROM log GROUP BY ALL")}
