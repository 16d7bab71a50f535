"""Datasets over split tables: rows joined with their images, batches, and a summary of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import numbered
from .images import tensors
from .splits import hash_key

SPLITS = ("train", "validation", "test")
#: Rows of a batch.
BATCH = 32


def split_dataset(samples: DataFrame, split: str) -> DataFrame:
    """The rows of one split: path and label, labels as whole numbers."""
    if split not in SPLITS:
        raise ValueError(f"no split {split}")
    return samples.where(F.col("split") == split).select("path", F.col("label").cast("long").alias("label"))


def create_datasets(samples: DataFrame) -> dict[str, DataFrame]:
    """A dataset by split."""
    return {s: split_dataset(samples, s) for s in SPLITS}


def tensor_dataset(dataset: DataFrame, images: DataFrame, training: bool = False, seed: int = 42) -> DataFrame:
    """(path, label, tensor) of a dataset's rows whose image can be decoded; only training images are augmented."""
    found = tensors(images, training, seed).withColumnRenamed("origin", "path")
    return dataset.join(found, "path")


def batches(dataset: DataFrame, size: int = BATCH, shuffle: bool = False, seed: int = 42, order: str = "path") -> DataFrame:
    """``dataset`` with ``batch`` and ``place`` in it, gapless from 0: by ``order``, or in an order that the seed fixes."""
    key = [hash_key(F.col(order), str(seed)), F.col(order)] if shuffle else [F.col(order)]
    rows = dataset.withColumn("_key", key[0]) if shuffle else dataset
    at = numbered(rows, [F.col("_key"), F.col(order)] if shuffle else key, "_at")
    return at.withColumns({"batch": F.floor(F.col("_at") / size).cast("long"), "place": (F.col("_at") % size).cast("int")}).drop("_at", "_key")


def create_dataloaders(samples: DataFrame, size: int = BATCH, seed: int = 42) -> dict[str, DataFrame]:
    """Batches by split; only training rows are shuffled."""
    return {s: batches(d, size, s == "train", seed) for s, d in create_datasets(samples).items()}


def batch_summary(rows: DataFrame) -> DataFrame:
    """Per batch: its rows, its labels' counts and, where there are tensors, their extremes."""
    seen = [F.min(F.array_min("tensor")).alias("lowest"), F.max(F.array_max("tensor")).alias("highest")] if "tensor" in rows.columns else []
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("fraud"), F.count_if(F.col("label") == 0).alias("non_fraud"), *seen)
