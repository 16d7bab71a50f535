"""Deterministic splits: rows or groups ranked by a hash of their key.

A rank by hash is the same on every run and machine, needs no random state, and
gives exact counts, which Bernoulli sampling does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.workspace import by_merge, numbered


def hash_key(key: Column, salt: str = "") -> Column:
    """The rank that decides: md5 of the salted key's text."""
    return F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary"))


def stratified(df: DataFrame, key: str, label: str, fraction: float, salt: str = "42") -> DataFrame:
    """``df`` with split "validation" for the first round(fraction * n) rows of each label by hash, else "train".

    Hashes are ranked in buckets by their first digits, as many as keep a bucket
    at about a million rows; a label's rows are never sorted in one task, only
    its bucket counts are.
    """
    digits = max(2, math.ceil(math.log(max(1, df.count()) / 1e6, 16)))
    rows = df.withColumn("_h", hash_key(F.col(key), salt)).withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    before = counts.select(label, "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))).join(before, [label, "_b"])
    chosen = F.col("_before") + F.col("_r") <= F.floor(F.col("_all") * F.lit(fraction) + F.lit(0.5))
    return ranked.withColumn("split", F.when(chosen, "validation").otherwise("train")).drop("_h", "_b", "_n", "_r", "_before", "_all")


def assign_groups(df: DataFrame, group: str, parts: list[tuple[str, int | None]], salt: str = "42") -> DataFrame:
    """``df`` with a split by group: hash-ranked groups are cut into ``parts`` of given numbers, the last takes the rest."""
    ids = df.select(group).distinct()
    ranked = numbered(ids.withColumn("_h", hash_key(F.col(group), salt)), [F.col("_h"), F.col(group)], "_r")
    split, at = None, 0
    for name, n in parts[:-1]:
        at += n
        split = F.when(F.col("_r") < at, name) if split is None else split.when(F.col("_r") < at, name)
    return df.join(by_merge(ranked.withColumn("split", split.otherwise(parts[-1][0])).select(group, "split")), group)


def development_split(df: DataFrame, group: str, test: float = 0.15, validation: float = 0.15, salt: str = "42") -> DataFrame:
    """Test groups first, then validation as a share of the whole from the rest: fractions are of groups, rounded up."""
    n = df.select(group).distinct().count()
    n_test = math.ceil(test * n)
    n_validation = math.ceil(validation / (1 - test) * (n - n_test))
    return assign_groups(df, group, [("test", n_test), ("validation", n_validation), ("train", None)], salt)


def three_way_split(df: DataFrame, group: str, train: float = 0.70, salt: str = "42") -> DataFrame:
    """Groups 70/30, and the 30 halved into validation and test; the held-out parts are rounded up."""
    n = df.select(group).distinct().count()
    n_rest = math.ceil((1 - train) * n - 1e-9)
    n_test = math.ceil(n_rest / 2)
    return assign_groups(df, group, [("test", n_test), ("validation", n_rest - n_test), ("train", None)], salt)


def summary(df: DataFrame, group: str | None = None) -> DataFrame:
    """Rows, positives, negatives, share of positives and groups per split, and over all."""
    groups = [F.countDistinct(group).alias("groups")] if group else []
    fraud = F.sum((F.col("label") == 1).cast("long"))
    measures = [F.count("*").alias("images"), fraud.alias("fraud"), (F.count("*") - fraud).alias("non_fraud"), F.try_divide(fraud * F.lit(100.0), F.count("*")).alias("fraud_percent"), *groups]
    return df.groupBy("split").agg(*measures).unionByName(df.agg(F.lit("overall").alias("split"), *measures))


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a random order that the seed fixes."""
    return df.orderBy(F.rand(seed))
