"""Best-fit-decreasing packing of tokenised documents into fixed-size sequences.

Best fit needs no more than the number of pieces of each length: pieces of one
length are alike, and so are open bins of one remaining capacity.  The driver
places whole runs of equal pieces with a segment tree over remaining
capacities (4096 leaves, however many documents), which gives the same packing
as placing them one by one; the runs then assign every piece its sequence by
its ordinal within its length, on the executors.

Defined cases: a null text is empty and has the end id only; repeated rows are
packed each; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small_batches, tidy
from .tokens import END_ID, encoder

SEQUENCE = 4096


class CapacityTree:
    """A segment tree over remaining capacities: the tightest open bin in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, some: bool) -> None:
        k = capacity + self.size
        self.some[k] = some
        while k > 1:
            k >>= 1
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        k = least + self.size
        if self.some[k]:
            return least
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def place(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing of ``counts[length]`` pieces a length, by runs of equal pieces.

    A run (length, first, bin, per_bin, offset): from ordinal ``first`` on,
    pieces go ``per_bin`` to a bin from ``bin`` on, beginning at ``offset``.
    Runs of one length are in ascending order of ``first``.  Their number
    depends on the lengths that occur, not on the number of pieces.
    """
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, at = counts[length], 0

        def put(first_bin: int, n: int, room: int, length: int = length) -> int:
            """Fill ``n`` equal bins with what is left; returns how many bins it needed."""
            nonlocal left, at
            per = room // length
            used = min(n, -(-left // per))
            runs.append((length, at, first_bin, per, capacity - room))
            full, rest = divmod(min(left, used * per), per)
            for start, k, r in ((first_bin, full, room - per * length), (first_bin + full, int(rest > 0), room - rest * length)):
                if k and r:
                    open_bins.setdefault(r, []).append((start, k))
                    tree.set(r, True)
            at, left = at + full * per + rest, left - full * per - rest
            return used

        while left:
            room = tree.tightest(length)
            if room is None:
                bins += put(bins, left, capacity)
                continue
            start, n = open_bins[room].pop()
            if not open_bins[room]:
                tree.set(room, False)
            used = put(start, n, room)
            if used < n:
                open_bins.setdefault(room, []).append((start + used, n - used))
                tree.set(room, True)
    return runs


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece; only longer documents are cut."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = e.ids(text, end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), *([part.astype(np.int32)] * with_ids)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(cut, "tokens"), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Assign every piece of ``docs`` a sequence_id and its offset in it, gapless from 0.

    Pieces are numbered within their length by hashed buckets, so that a common
    length is spread over many tasks; the driver sees counts by length only.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, tokenizer, capacity, end, with_ids), "pieces")
    spread = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length at most
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    numbered = (
        bucketed.withColumn("row", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
        .join(before, ["length", "bucket"])
        .withColumn("ordinal", F.col("before") + F.col("row") - 1)
        .drop("bucket", "before", "row")
    )
    runs = np.array(sorted(place(counts, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)  # bounded by the square of the lengths' number
    columns = [c for c in pieces.columns]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, ordinal = b.column("length").to_numpy(), b.column("ordinal").to_numpy()
            r = table[np.searchsorted(keys, length << 44 | ordinal, side="right") - 1]
            k = ordinal - r[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(r[:, 2] + k // np.maximum(r[:, 3], 1)), pa.array(r[:, 4] + k % np.maximum(r[:, 3], 1) * length)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(tidy(assign, "tokens"), schema)
