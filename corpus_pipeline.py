"""From raw documents to packed training sequences: STAGES, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, packing, secrets, simhash, toxicity
from pagemill.llm.common import fresh, load, scratch_dir


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; texts that are null or empty stay."""
    out = fresh("toxicity", docs.columns)
    scored = toxicity.score(docs, toxicity.learn(docs, load(spark, sf_dir, "labels")), out=out)
    return scored.where(F.col(out) < 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: that with the smallest doc_id."""
    return simhash.deduplicate(docs).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark, and n_chars follows."""
    out = secrets.redact(docs, secrets.vocabulary_path())
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_spans", secret_spans),
    ("packing", packed),
]

#: No SQL expresses the learnt scores and the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table documents; every stage is written to the shared folder and reread."""
    docs, folder = load(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
