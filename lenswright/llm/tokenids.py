"""Token-id files: canonical length-limited Huffman codes of global counts.

A folder holds ``codes.bin``, the code length of every id, and shards in
ascending doc_id order.  A shard is a row of blocks that decode independently,
then the documents' ids and token counts.  In a block, checkpoints hold the bit
offset of every 256th token, so decoding walks all checkpoints at once, one
table look-up a step.

Defined cases: a null text is empty and has the end id only; null ids sort
first and repeated ids by their tokens; an empty table gives no shard.
Shards have names of their own and the manifest names those of the tasks that
succeeded, so a rerun task does no harm.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialise, small_batches, tidy, work_path
from .tokens import END_ID, encoder

#: Longest code in bits; 2 to this power must exceed the vocabulary.
LIMIT = 18
#: Tokens of a block, and tokens from one checkpoint to the next.
BLOCK, EVERY = 1 << 20, 256
#: About so many tokens go into a shard.
SHARD_TOKENS = 1 << 24
MAGIC = b"LWHUFF1\n"


# -- codes -----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("the limit is too low for so many ids")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        row = both[sort]
        is_leaf.append(sort < len(leaves))
    lengths, take = np.zeros(len(leaves), np.uint8), 2 * len(leaves) - 2
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
        if not take:
            break
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: by length, then by id, each the one before plus one."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = used[lengths[used] == n]
        code <<= n - last
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), n
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """One block: the bits of ``ids``, and the bit offsets of every ``every``-th of them."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word = at >> 5
    wide = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)  # its bits within this 32-bit word and the next
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    sums = np.add.reduceat(wide, first)  # bits don't overlap: a sum is an or
    out[word[first]] |= sums >> np.uint64(32)
    out[word[first] + 1] |= sums & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::every].astype("<u4")


class Decoder:
    """Table-driven: the next bits of a stream index the id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        size = 1 << self.bits
        self.ids, self.lengths = np.zeros(size, np.uint32), np.ones(size, np.uint8)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.bits - lengths[used].astype(np.int64))
        total = int(spans.sum())
        self.ids[:total] = np.repeat(used, spans)
        self.lengths[:total] = np.repeat(lengths[used], spans)

    def block(self, data: bytes, points: np.ndarray, n: int, every: int = EVERY) -> np.ndarray:
        """The ``n`` ids of a block, all checkpoints decoded side by side."""
        b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at, last = points.astype(np.int64), len(window) - 1
        out, shift = np.empty((min(every, n), len(points)), np.uint32), np.uint32(32 - self.bits)
        for step in range(len(out)):
            key = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[step] = self.ids[key]
            at += self.lengths[key]
        return out.T.reshape(-1)[:n] if len(points) > 1 else out[:, 0][:n]


# -- shards ----------------------------------------------------------------


def write_shard(out: pa.NativeFile, docs: Iterable[tuple[int | None, np.ndarray]], lengths: np.ndarray) -> tuple[int, int]:
    """Write documents in their order; returns their number and that of their tokens."""
    codes, held, n_held = canonical(lengths), [], 0
    doc_ids, sizes, blocks, at = [], [], [], len(MAGIC)
    out.write(MAGIC)

    def flush(least: int) -> None:
        nonlocal held, n_held, at
        if n_held < max(1, least):
            return
        ids, pos = np.concatenate(held), 0
        while len(ids) - pos >= max(1, least):
            part = ids[pos : pos + BLOCK]
            data, points = pack(part, lengths, codes)
            out.write(points.tobytes() + data)
            blocks.append((at, len(part), len(points), len(data)))
            at, pos = at + 4 * len(points) + len(data), pos + len(part)
        held, n_held = [ids[pos:]], len(ids) - pos

    for doc_id, ids in docs:
        doc_ids.append(doc_id)
        sizes.append(len(ids))
        held.append(ids)
        n_held += len(ids)
        flush(BLOCK)
    flush(1)
    null = [k for k, d in enumerate(doc_ids) if d is None]
    foot = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + np.array(blocks, "<i8").tobytes()
    head = json.dumps({"docs": len(doc_ids), "blocks": len(blocks), "null": null}).encode()
    foot = zlib.compress(foot, 1)
    out.write(foot + head + struct.pack("<QQ", len(foot), len(head)) + MAGIC)
    return len(doc_ids), sum(sizes)


def read_shard(f: pa.NativeFile, decoder: Decoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a shard, block after block; only one block and the current document are held."""

    def get(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    size = f.size()
    tail = get(size - 16 - len(MAGIC), 16 + len(MAGIC))
    if tail[16:] != MAGIC:
        raise ValueError("not a whole shard")
    n_foot, n_head = struct.unpack("<QQ", tail[:16])
    head = json.loads(get(size - 16 - len(MAGIC) - n_head, n_head))
    foot = zlib.decompress(get(size - 16 - len(MAGIC) - n_head - n_foot, n_foot))
    d, nulls = head["docs"], set(head["null"])
    doc_ids, sizes = np.frombuffer(foot, "<i8", d), np.frombuffer(foot, "<i8", d, 8 * d)
    held, have, k = [], 0, 0
    for at, n, points, length in np.frombuffer(foot, "<i8", 4 * head["blocks"], 16 * d).reshape(-1, 4).tolist():
        raw = get(at, 4 * points + length)
        held.append(decoder.block(raw[4 * points :], np.frombuffer(raw, "<u4", points), n))
        have += n
        if k < d and have >= sizes[k]:
            ids, pos = np.concatenate(held), 0
            while k < d and pos + sizes[k] <= len(ids):
                yield None if k in nulls else int(doc_ids[k]), ids[pos : pos + sizes[k]]
                pos, k = pos + int(sizes[k]), k + 1
            held, have = [ids[pos:]], len(ids) - pos
    if k != d:
        raise ValueError("the shard has fewer tokens than its documents")


# -- the operator ----------------------------------------------------------


def encode(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token-id files; returns the manifest.

    Manifest: shard long, path, codes (the code file), n_docs, n_tokens, start
    (tokens in the shards before).  Texts are tokenised once, into a compressed
    work table; the ids' counts (at most the vocabulary) come to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or work_path(spark, "token-ids")

    schema = "doc_id long, n long, ids binary, counts binary"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, z = encoder(tokenizer), zstandard.ZstdCompressor(1)
        total = np.zeros(e.size, np.int64)
        for b in batches:
            raw = [e.raw(t, end) for t in b.column(1).to_pylist()]
            total += np.bincount(np.frombuffer(b"".join(raw), e.dtype), minlength=e.size)
            n = np.fromiter(map(len, raw), np.int64, len(raw)) // e.dtype.itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array([z.compress(r) for r in raw], pa.binary()), pa.nulls(len(raw), pa.binary())], names=["doc_id", "n", "ids", "counts"])
        if total.any():  # the partition's own row, after its documents
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((None, pa.int64()), (-1, pa.int64()), (None, pa.binary()), (z.compress(total.astype("<i8").tobytes()), pa.binary()))], names=["doc_id", "n", "ids", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for b in batches:
            for r in b.column(0).to_pylist():
                more = np.frombuffer(z.decompress(r), "<i8")
                total = total + more if len(total) else more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(tokenise, "tokens"), schema)
    path = work_path(spark, "ids")
    table.write.option("compression", "none").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    rows = table.where("counts is not null").select("counts").mapInArrow(tidy(summed, "tokens"), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(encoder(tokenizer).size, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    lengths = code_lengths(counts, limit)
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/codes.bin") as f:
        f.write(lengths.tobytes())
    packed = lengths.tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, z = encoder(tokenizer), zstandard.ZstdDecompressor()
        fs, where = filesystem(folder)
        k = TaskContext.get().partitionId()
        name, found = f"shard-{k:06d}-{uuid.uuid4().hex[:8]}.huf", iter(batches)
        some = next((b for b in found if b.num_rows), None)
        if some is None:
            return

        def each() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in chain([some], found):
                yield from zip(b.column(0).to_pylist(), (np.frombuffer(z.decompress(r), e.dtype) for r in b.column(1).to_pylist()), strict=True)

        with fs.open_output_stream(f"{where}/{name}") as f:
            n, tokens = write_shard(f, each(), np.frombuffer(packed, np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((k, pa.int64()), (f"{folder}/{name}", pa.string()), (n, pa.int64()), (tokens, pa.int64()))], names=["shard", "path", "n_docs", "n_tokens"])

    total = int(counts.sum())
    shards = max(1, -(-total // SHARD_TOKENS), min(spark.sparkContext.defaultParallelism, total >> 20))
    parts = table.where("n >= 0").select("doc_id", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    manifest = materialise(parts.mapInArrow(tidy(write, "tokens"), "shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    found = sorted(manifest.collect())  # one short row a shard
    starts = [0, *accumulate(r.n_tokens for r in found)]
    rows = [(r.shard, r.path, f"{folder}/codes.bin", r.n_docs, r.n_tokens, s) for r, s in zip(found, starts, strict=False)]
    return spark.createDataFrame(rows, "shard long, path string, codes string, n_docs long, n_tokens long, start long")


def decode(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read token-id files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    small_batches(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders: dict[str, Decoder] = {}
        for b in batches:
            for path, codes, start in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                fs, where = filesystem(path)
                if codes not in decoders:
                    with fs.open_input_file(filesystem(codes)[1]) as f:
                        decoders[codes] = Decoder(np.frombuffer(f.read(), np.uint8))
                with fs.open_input_file(where) as f:
                    out, held, at = [], 0, start
                    for doc_id, ids in read_shard(f, decoders[codes]):
                        out.append((doc_id, at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), *([ids.astype(np.int32)] * with_ids)))
                        at, held = at + len(ids), held + len(ids)
                        if held >= 1 << 20 or len(out) >= 10_000:
                            yield as_batch(out)
                            out, held = [], 0
                    if out:
                        yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)])

    parallel = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "codes", "start").repartition(parallel).mapInArrow(tidy(read, "tokens"), schema)


def round_trip_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files, read them back, and digest every document's ids as read."""
    return decode(docs.sparkSession, encode(docs, tokenizer), with_ids=False)
