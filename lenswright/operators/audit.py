"""Leakage audits between the splits of a sample table (path, label, split, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


def missing_columns(df: DataFrame, required: tuple[str, ...] = ("path", "label")) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: tuple[str, ...] = ("path", "label")) -> DataFrame:
    """``df`` if it has the columns, else an error that names the missing ones."""
    if gone := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def keys_by_split(samples: DataFrame, key: Column) -> DataFrame:
    """A row per key with the splits that hold it: one aggregation serves every pair of splits."""
    return samples.select(key.alias("key"), "split").groupBy("key").agg(F.array_sort(F.collect_set("split")).alias("splits"))


def overlap(samples: DataFrame, key: Column, n_samples: int = 5) -> DataFrame:
    """Per pair of splits: how many distinct keys both hold, and the first of them."""
    pairs = F.array(*(F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b")) for a, b in PAIRS))
    shared = keys_by_split(samples, key).where(F.size("splits") > 1)
    found = shared.select("key", F.explode(F.filter(pairs, lambda p: F.array_contains("splits", p["split_a"]) & F.array_contains("splits", p["split_b"]))).alias("p")).select("p.*", "key")
    counts = found.groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))
    top = _first_keys(found, n_samples)
    grid = samples.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    out = grid.join(F.broadcast(counts), ["split_a", "split_b"], "left").join(F.broadcast(top), ["split_a", "split_b"], "left")
    return out.select("split_a", "split_b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.coalesce("examples", F.lit("")).alias("examples"))


def _first_keys(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` least keys of each pair; a hashed bucket keeps its own ``n`` first, so no task sees all keys."""
    bucket = found.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(64)))
    some = bucket.withColumn("r", F.row_number().over(Window.partitionBy("split_a", "split_b", "b").orderBy("key"))).where(F.col("r") <= n)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("split_a", "split_b").orderBy("key"))).where(F.col("r") <= n)
    return best.groupBy("split_a", "split_b").agg(F.array_join(F.array_sort(F.collect_list("key")), "|").alias("examples"))


def hash_overlap(samples: DataFrame, content_hash: Column) -> DataFrame:
    """Per pair of splits and shared content hash: how many files each side has, and its first two paths.

    Paths are dealt to 64 buckets a hash, each of which keeps its first two, so
    a very common file's paths are never gathered.
    """
    each = samples.select(content_hash.alias("hash"), "path", "split").groupBy("hash", "split", "path").agg(F.count("*").alias("n"))
    counts = each.groupBy("hash", "split").agg(F.sum("n").alias("n"))
    bucket = Window.partitionBy("hash", "split", F.pmod(F.xxhash64("path"), F.lit(64))).orderBy("path")
    some = each.where(F.col("path").isNotNull()).withColumn("r", F.row_number().over(bucket)).where("r <= 2").groupBy("hash", "split").agg(F.array_join(F.slice(F.array_sort(F.collect_list("path")), 1, 2), "|").alias("paths"))
    by = counts.join(some, ["hash", "split"], "left").withColumn("paths", F.coalesce("paths", F.lit("")))
    pairs = F.array(*(F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b")) for a, b in PAIRS))
    left = by.select(F.col("hash"), F.explode(F.filter(pairs, lambda p: p["split_a"] == F.col("split"))).alias("p"), F.col("n").alias("files_a"), F.col("paths").alias("paths_a"))
    left = left.select("hash", "p.*", "files_a", "paths_a")
    right = by.select("hash", F.col("split").alias("split_b"), F.col("n").alias("files_b"), F.col("paths").alias("paths_b"))
    return left.join(right, ["hash", "split_b"]).select("split_a", "split_b", "hash", "files_a", "files_b", "paths_a", "paths_b")


def directory_overlap(samples: DataFrame, directory: Column) -> DataFrame:
    """Directories that more than one split uses, with those splits."""
    by = keys_by_split(samples, directory).where(F.size("splits") > 1)
    return by.select(F.col("key").alias("directory"), F.array_join("splits", ",").alias("splits"))


def internal_duplicates(samples: DataFrame, path: Column, filename: Column) -> DataFrame:
    """Per split: rows beyond the first of each path, and of each file name."""
    text = lambda c: F.coalesce(c, F.lit("nan"))
    return samples.groupBy("split").agg((F.count("*") - F.countDistinct(text(path))).alias("duplicate_paths"), (F.count("*") - F.countDistinct(text(filename))).alias("duplicate_filenames"))


def verdict(path_shared: Column, hash_shared: Column, filename_shared: Column, internal: Column, directories: Column) -> Column:
    """LEAKAGE by path or content; else SUSPICIOUS by name, repetition or directory; else PASS."""
    return F.when((path_shared > 0) | (hash_shared > 0), "LEAKAGE").when((filename_shared > 0) | (internal > 0) | (directories > 0), "SUSPICIOUS").otherwise("PASS")


def leakage(samples: DataFrame, path: Column, content_hash: Column, filename: Column, directory: Column) -> DataFrame:
    """One row: keys of each kind that several splits share, rows beyond the first of a path in its split, and the verdict.

    All four kinds of key go through one aggregation, so the samples are read
    and dealt out once; only keys travel.  A null key is a key like any other.
    """
    kinds = {"shared_paths": path, "shared_hashes": content_hash, "shared_filenames": filename, "shared_directories": directory}
    each = samples.select("split", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), k.alias("key")) for n, k in kinds.items()))).alias("k"))
    by = each.groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), F.size(F.collect_set("split")).alias("splits"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    shared = [count((F.col("kind") == n) & (F.col("splits") > 1)).alias(n) for n in kinds]
    out = by.agg(*shared, count(F.when(F.col("kind") == "shared_paths", F.col("n") - F.col("splits"))).alias("internal_duplicates"))
    return out.withColumn("verdict", verdict(*(F.col(c) for c in ("shared_paths", "shared_hashes", "shared_filenames", "internal_duplicates", "shared_directories"))))


def missing(samples: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of ``samples`` whose key no row of ``known`` has."""
    return samples.join(known.select(key).distinct(), key, "left_anti")


def isolated(samples: DataFrame, key: str, raise_on_overlap: bool = True) -> DataFrame:
    """How many keys lie in several splits; with ``raise_on_overlap`` any such key is an error when the row is read."""
    out = keys_by_split(samples, F.col(key)).agg(F.coalesce(F.sum((F.size("splits") > 1).cast("long")), F.lit(0)).alias("shared_keys"), F.count("*").alias("keys"))
    if raise_on_overlap:
        bad = F.concat(F.lit(f"{key} lies in several splits: "), F.col("shared_keys").cast("string"))
        out = out.withColumn("shared_keys", F.when(F.col("shared_keys") > 0, F.raise_error(bad)).otherwise(F.col("shared_keys")))
    return out.withColumn("isolated", F.col("shared_keys") == 0)


def unique_hashes(samples: DataFrame, content_hash: Column) -> DataFrame:
    """Per split: files and distinct contents, exactly."""
    return samples.groupBy("split").agg(F.count("*").alias("files"), F.countDistinct(content_hash).alias("unique_hashes"))


def first_samples(samples: DataFrame, n: int = 20, order: str = "doc_id") -> DataFrame:
    """The first ``n`` rows in order."""
    return samples.orderBy(order).limit(n)
