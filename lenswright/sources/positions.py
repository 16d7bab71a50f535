"""Rows by position: a table written in ranges of positions, and seeded permutations of positions without a sort.

A store's rows are numbered gaplessly from 0 as they stand, and written one file
a range.  A position's range is a quotient, so the rows at some positions are
read from the files of their ranges alone.  Shuffled batches follow a permutation
that is computed place by place, in both directions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import numbered, numbered_as_stored
from .sinks import write_report

#: Rows of a range, and of a batch.
RANGE_ROWS, BATCH = 100_000, 32
#: Rounds of the network; the mixing constants keep all products within 62 bits.
ROUNDS, MASK, FIRST, SECOND = 6, (1 << 31) - 1, 0x2C1B3C6D, 0x297A2D39


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 to n - 1 that a seed fixes: a Feistel network over the next power of two, walked until it is inside."""

    n: int
    seed: int = 42

    @property
    def widths(self) -> tuple[int, int]:
        bits = max(2, (self.n - 1).bit_length())
        if bits > 62:
            raise ValueError(f"{self.n} positions")
        return bits // 2, bits - bits // 2

    @property
    def keys(self) -> list[int]:
        return [int.from_bytes(hashlib.sha256(f"{self.seed}:{k}".encode()).digest()[:4], "little") & MASK for k in range(ROUNDS)]

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        high, low = self.widths
        a, b = x >> low, x & ((1 << low) - 1)
        order = list(enumerate(self.keys))
        for k, key in reversed(order) if back else order:
            if k % 2:
                b = b ^ (mixed(a, key) & ((1 << low) - 1))
            else:
                a = a ^ (mixed(b, key) & ((1 << high) - 1))
        return a << low | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64)
        if len(x) and not (0 <= x.min() and x.max() < self.n):
            raise IndexError(f"not all of 0 to {self.n - 1}")
        out = self._pass(x, back)
        while len(outside := np.flatnonzero(out >= self.n)):
            out[outside] = self._pass(out[outside], back)
        return out

    def at(self, places: Iterable[int]) -> np.ndarray:
        """The positions that stand at ``places`` of the shuffled order."""
        return self._walk(np.asarray(places), False)

    def place_of(self, positions: Iterable[int]) -> np.ndarray:
        """Where ``positions`` stand in the shuffled order."""
        return self._walk(np.asarray(positions), True)

    def place(self, position: Column) -> Column:
        """``place_of`` as a column."""

        @F.pandas_udf("long")
        def place(x: pd.Series) -> pd.Series:
            return pd.Series(self.place_of(x.to_numpy()))

        return place(position)


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """31 mixed bits of a half and a round's key."""
    h = (x ^ key) * FIRST & MASK
    h = (h ^ (h >> 15)) * SECOND & MASK
    return h ^ (h >> 13)


@dataclass(frozen=True)
class RowStore:
    """A written table of numbered rows: ``rows`` of them, ``per_range`` in a range."""

    spark: SparkSession
    folder: str
    rows: int
    per_range: int
    schema: str

    @classmethod
    def write(cls, df: DataFrame, folder: str, order: list[Column] | None = None, per_range: int = RANGE_ROWS) -> RowStore:
        """Number the rows of ``df``, by ``order`` or as they stand, and write them by ranges; ``position`` is added."""
        spark = df.sparkSession
        at = numbered(df, order, "position") if order else numbered_as_stored(df, "position")
        n = at.count()
        parts = at.withColumn("range", F.floor(F.col("position") / per_range).cast("long"))
        dealt = parts.repartition(max(1, -(-n // per_range)), "range").sortWithinPartitions("range", "position")
        dealt.write.partitionBy("range").parquet(f"{folder}/rows")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema)
        write_report(spark.createDataFrame([(n, per_range, schema)], "rows long, per_range long, schema string"), f"{folder}/manifest")
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> RowStore:
        found = spark.read.schema("rows long, per_range long, schema string").json(f"{folder}/manifest").first()
        if found is None:
            raise FileNotFoundError(folder)
        return cls(spark, folder, found.rows, found.per_range, found.schema)

    def __len__(self) -> int:
        return self.rows

    def all(self) -> DataFrame:
        """All rows with their positions."""
        if not self.rows:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, range long").parquet(f"{self.folder}/rows").drop("range")

    def at(self, positions: Iterable[int]) -> DataFrame:
        """The rows at some (few) positions, from the files of their ranges alone."""
        positions = sorted({int(p) for p in positions})
        if positions and not 0 <= positions[0] <= positions[-1] < self.rows:
            raise IndexError(f"not all of 0 to {self.rows - 1}")
        if not positions:
            return self.all().where("false")
        ranges = sorted({p // self.per_range for p in positions})
        files = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/rows/range={r}" for r in ranges))
        return files.where(F.col("position").isin(positions))

    def row(self, position: int) -> Row:
        """The row at a position; negative ones count from the end."""
        return self.at([position + self.rows if position < 0 else position]).first()

    def batches(self, size: int = BATCH) -> int:
        return -(-self.rows // size)

    def batch(self, k: int, size: int = BATCH, seed: int | None = None) -> DataFrame:
        """Batch ``k`` with ``place`` in it from 0: of the rows as numbered, or as the seed shuffles them."""
        if not 0 <= k < self.batches(size):
            raise IndexError(f"no batch {k}")
        places = np.arange(k * size, min((k + 1) * size, self.rows))
        positions = places if seed is None else Permutation(self.rows, seed).at(places)
        spots = F.create_map(*(F.lit(int(x)) for pair in zip(positions, places - k * size, strict=True) for x in pair))
        return self.at(positions).withColumn("place", F.element_at(spots, F.col("position").cast("int") if self.rows <= MASK else F.col("position")).cast("int"))

    def batched(self, size: int = BATCH, seed: int | None = None) -> DataFrame:
        """All rows with ``batch`` and ``place`` in it; no sort and no shuffle of rows."""
        at = F.col("position") if seed is None else Permutation(self.rows, seed).place(F.col("position"))
        placed = self.all().withColumn("_at", at)
        return placed.withColumns({"batch": F.floor(F.col("_at") / size).cast("long"), "place": (F.col("_at") % size).cast("int")}).drop("_at")
