"""Profiles of a labelled collection: class balance, dimensions, exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percentage
from ..plans.workspace import materialise, numbered


def class_name(label: Column) -> Column:
    """Any label that isn't zero is fraud."""
    return F.when(label == 0, "Non-Fraud").otherwise("Fraud")


def class_distribution(df: DataFrame, splits: list[str], labels: list[int]) -> DataFrame:
    """Count by split and label, zero where there is none."""
    grid = df.sparkSession.createDataFrame([(s, c) for s in splits for c in labels], "split string, label int")
    counts = df.groupBy("split", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(counts), ["split", "label"], "left").select("split", "label", class_name(F.col("label")).alias("class_name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_totals(df: DataFrame) -> DataFrame:
    """Counts by split and class, by class, by split and over all, with shares of the split (or all)."""
    sets = df.groupingSets([["split", "label"], ["label"], ["split"], []], "split", "label").agg(F.count("*").alias("n"))
    named = sets.select(F.coalesce("split", F.lit("overall")).alias("split"), F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("class"), "n")
    total = F.max(F.when(F.col("class") == "all", F.col("n"))).over(Window.partitionBy("split"))
    return named.withColumn("percent", percentage(F.col("n"), total))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def class_weights(df: DataFrame) -> DataFrame:
    """total / (classes * count) per label, as a 32-bit float."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row a class
    return counts.select("label", "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).cast("float").cast("double").alias("weight")).orderBy("label")


def label_share(df: DataFrame) -> DataFrame:
    """Rows and share in percent of each label within its split, unrounded."""
    counts = df.groupBy("split", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def duplicate_groups(df: DataFrame, content_hash: Column) -> DataFrame:
    """A row per file whose content hash other files have too: hash, how many have it, path.

    A very common content's paths are rows, never one cell; the join is of two written tables, which
    adaptive execution can split.
    """
    files = materialise(df.select(content_hash.alias("hash"), "path").where("hash is not null"), "hashed")
    counts = materialise(files.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return files.join(counts, "hash").select("hash", "n", "path")


def dimension_stats(df: DataFrame) -> DataFrame:
    """Images, distinct sizes, and the extremes of width and height."""
    return df.agg(F.count("*").alias("images"), F.countDistinct("width", "height").alias("distinct_sizes"), *(f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))))


def top_dimensions(df: DataFrame, n: int = 10, order: str = "doc_id") -> DataFrame:
    """The ``n`` most common sizes; of equally common ones the first seen."""
    by = df.groupBy("width", "height").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return by.orderBy(F.desc("n"), "first_seen").limit(n)


def systematic_sample(df: DataFrame, k: int, order: str) -> DataFrame:
    """Every ``max(n // k, 1)``-th row in order, the first ``k`` of them."""
    step = max(df.count() // k, 1)
    rows = numbered(df, [F.col(order)], "pos")
    return rows.where((F.col("pos") % step == 0) & (F.col("pos") < step * k)).withColumn("sample_no", (F.col("pos") / step).cast("long")).drop("pos")


def head_sanity(df: DataFrame, k: int = 100, order: str = "doc_id") -> DataFrame:
    """Extremes of sizes over the first ``k`` rows of each split; unreadable ones (null width) count toward the ``k``.

    A bucket keeps its own first ``k``, so no task orders a whole split.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(64)))
    some = b.withColumn("_r", F.row_number().over(Window.partitionBy("split", "_b").orderBy(order))).where(F.col("_r") <= k)
    head = some.withColumn("_r", F.row_number().over(Window.partitionBy("split").orderBy(order))).where(F.col("_r") <= k)
    return head.groupBy("split").agg(F.count("*").alias("checked"), F.count("width").alias("readable"), *(f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))))


def mode_sanity(df: DataFrame, k: int = 100, order: str = "path") -> DataFrame:
    """The distinct modes, sorted, over the first ``k`` rows of each split; unreadable ones (null mode) count toward the ``k``."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(64)))
    some = b.withColumn("_r", F.row_number().over(Window.partitionBy("split", "_b").orderBy(order))).where(F.col("_r") <= k)
    head = some.withColumn("_r", F.row_number().over(Window.partitionBy("split").orderBy(order))).where(F.col("_r") <= k)
    return head.groupBy("split").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))


def grid_cells(df: DataFrame, columns: int, number: str = "sample_no") -> DataFrame:
    """Where the k-th item stands in a sheet of so many columns."""
    return df.withColumns({"column": F.col(number) % columns, "row": F.floor(F.col(number) / columns)})


def dedup_first(tables: list[tuple[str, DataFrame]], key: str = "path", order: str = "doc_id") -> DataFrame:
    """The union of tagged tables with one row a key: that of the earliest table, then the earliest row."""
    out = None
    for rank, (tag, df) in enumerate(tables):
        one = df.withColumns({"old_split": F.lit(tag), "_rank": F.lit(rank)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_rank")]
    first = out.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_rank", order)).alias("r"))
    return first.select(key, "r.*")


def report(df: DataFrame, content_hash: Column) -> DataFrame:
    """One nested row: totals, classes by split, sizes and duplicate counts, ready for JSON."""
    classes = class_totals(df).agg(F.array_sort(F.collect_list(F.struct("split", "class", "n", "percent"))).alias("classes"))
    sizes = dimension_stats(df).select(F.struct("*").alias("dimensions"))
    dups = df.select(content_hash.alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").agg(F.struct(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("images")).alias("duplicates"))
    return classes.crossJoin(sizes).crossJoin(dups)
