"""Claims intake as a stream: new files of a landing folder become rows (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.claims import claim_id, kilobytes


def landed_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of uploads: path, size, content hash and a claim id that a rerun repeats."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    ok = paths.suffix(F.col("path")).isin(".jpg", ".jpeg", ".png")
    return stream.where(ok).select("path", "modificationTime", kilobytes(F.col("length")).alias("size_kb"), F.sha2("content", 256).alias("sha256"), claim_id(F.col("path"), 2024).alias("claim_id"))


def first_uploads(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Uploads whose content hasn't been seen within the watermark's delay; state stays bounded by it."""
    return stream.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
