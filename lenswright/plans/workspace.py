"""Tables that outlive a stage, and numbering without a single task.

Executors can be lost and share no local folders, so such tables are written
below the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_SCOPES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` of the session decides; only where neither it nor
    a checkpoint folder is set (tests, local runs) a temporary one is made; on a
    cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="lenswright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    below = _SCOPES[-1] if _SCOPES else f"{shared_dir(spark)}/lenswright"
    return f"{below}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Work tables written inside go below one folder, which is deleted at the end; results must have been written elsewhere."""
    folder = f"{shared_dir(spark)}/lenswright/scope-{uuid.uuid4().hex[:12]}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is shuffled and merged, never broadcast.

    Spark takes a written table for as large as its compressed files, and rows that are
    exploded from it for no more than those; what it broadcasts on that ground fills the
    driver and every executor.
    """
    return df.hint("merge")


#: Rows that a range has at most (about) where rows are numbered or cumulated in order.
RANGE_ROWS = 1_000_000


def ranges_of(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (a written table) dealt out by ranges of ``order``, as a written table with the range's number in ``name``.

    The number of ranges follows from the number of rows, so a range doesn't grow with the data.
    """
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, at_least, -(-rows.count() // RANGE_ROWS))
    return materialise(rows.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id()), "ranges")


def before_each(sizes: DataFrame, part: str, sums: list[str], down: bool = False, block: int = 1024) -> DataFrame:
    """``sizes`` (a row a range) with each of ``sums`` cumulated over the ranges before (``before_<name>``) and over all (``all_<name>``).

    In two levels: within blocks of ranges, and across blocks from a row a block.
    """
    order = F.desc(part) if down else F.asc(part)
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_block", F.floor(F.col(part) / block))
    rows = rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    across = Window.orderBy(F.desc("_b") if down else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block of ranges
    whole = Window.partitionBy(F.lit(1))
    blocks = sizes.groupBy(F.floor(F.col(part) / block).alias("_b")).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    blocks = blocks.select("_b", *(F.coalesce(F.sum(f"_{c}").over(across), F.lit(0)).alias(f"_before_{c}") for c in sums), *(F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in sums))
    out = rows.join(F.broadcast(blocks), F.col("_block") == F.col("_b")).withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_before_{c}") for c in sums})
    return out.drop("_block", "_b", *(f"_before_{c}" for c in sums))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 by ``order``, without gathering its rows in one task.

    Rows are dealt out by ranges of the sort keys and numbered within a
    range; a table of one row a range has what each adds.
    """
    parts = ranges_of(materialise(df, "rows"), order, "_part")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before_each(sizes, "_part", ["_n"]).select("_part", F.col("before__n").alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_row", row).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_before")


def numbered_as_stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with a gapless number from 0 in the order of its partitions and their rows; nothing is sorted or shuffled."""
    rows = materialise(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = before_each(sizes, "_part", ["_n"]).select("_part", F.col("before__n").alias("_before"))  # a row a partition
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + row).cast("long")).drop("_part", "_before", "_id")


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, wherever they start; once a session's context."""
    context = spark.sparkContext
    if getattr(context, "_lenswright_shipped", False):
        return
    root = Path(__file__).parents[1]
    target = Path(tempfile.mkdtemp(prefix="lenswright-code-")) / "lenswright.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"lenswright/{f.relative_to(root)}")
    context.addPyFile(str(target))
    context._lenswright_shipped = True
