"""Sinks: CSV splits and manifests, nested JSON reports, partitioned predictions, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", "true").csv(path)


def write_splits(df: DataFrame, folder: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """A CSV folder per split with path and label only."""
    for s in splits:
        write_csv(df.where(F.col("split") == s), f"{folder}/{s}", ["path", "label"])


def write_manifest(df: DataFrame, path: str) -> None:
    write_csv(df, path, ["path", "label", "group_id", "old_split"])


def write_report(row: DataFrame, path: str) -> None:
    """A nested report; a report is one row, so one file."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_predictions(df: DataFrame, folder: str) -> None:
    """All predictions, in one folder per kind of error, by a single write."""
    df.write.mode("overwrite").option("header", "true").partitionBy("error_type").csv(folder)


def audit_row(summary: DataFrame, groups: DataFrame, paths: DataFrame, test_locked: bool = True, seed: int = 42) -> DataFrame:
    """Split summaries and the governance flags as one row; ``groups`` and ``paths`` are the checks of their isolation (one row with ``isolated``)."""
    per_split = F.array_sort(F.collect_list(F.struct("split", "images", "fraud", "non_fraud")))
    rows = summary.agg(per_split.alias("splits"))
    flags = groups.select(F.col("isolated").alias("group_isolation_verified")).crossJoin(paths.select(F.col("isolated").alias("path_isolation_verified")))
    return rows.crossJoin(flags).select("splits", F.lit(seed).alias("seed"), F.lit(test_locked).alias("test_locked"), "group_isolation_verified", "path_isolation_verified")


def write_group_audit(numbered_groups: DataFrame, folder: str) -> None:
    """Numbered duplicate groups as a CSV, and their counts by priority, by flag and over all as one nested JSON report.

    No groups give a CSV without rows and a report of zeros.
    """
    flags = ("mixed_label", "cross_split", "train_test", "train_validation", "validation_test")
    write_csv(numbered_groups.orderBy("group_number"), f"{folder}/groups", ["group_number", "group_id", "priority", "images", "fraud", "splits", "labels", *flags])
    by = numbered_groups.groupBy("priority").agg(F.count("*").alias("groups"), F.sum("images").alias("images"))
    by = by.agg(F.array_sort(F.collect_list(F.struct("priority", "groups", "images"))).alias("priorities"))
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long")
    total = numbered_groups.agg(F.struct(F.count("*").alias("groups"), count("images").alias("images"), count("fraud").alias("fraud")).alias("total"), F.struct(*(count(c).alias(c) for c in flags)).alias("flags"))
    write_report(total.crossJoin(by), f"{folder}/report")


def backup(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a folder within the store, keeping the source; an existing target is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs_a, fs_b = a.getFileSystem(conf), b.getFileSystem(conf)
    if fs_b.exists(b):
        raise FileExistsError(target)
    return jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, conf)
