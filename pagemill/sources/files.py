"""Files as rows: content in base64, type by extension, size and name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that a library takes in.
DIALOG = "*.{pdf,png,jpg,jpeg,PDF,PNG,JPG,JPEG}"


def mime(path: Column) -> Column:
    """Type by the extension, in either case."""
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "application/pdf").when(low.endswith(".png"), "image/png").when(low.rlike(r"\.jpe?g$"), "image/jpeg").otherwise("application/octet-stream")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(filepath, name, size, mime_type, data) of a file, or of those of a folder that fit the pattern; raises FileNotFoundError where the path is none. Empty files are left out."""
    reader = spark.read.format("binaryFile")
    try:
        found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"File not found: {path}") from None
    return found.select(F.col("path").alias("filepath"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), mime(F.col("path")).alias("mime_type"), F.base64("content").alias("data"))


def content(data: Column) -> Column:
    """The bytes of a file's data."""
    return F.unbase64(data)
