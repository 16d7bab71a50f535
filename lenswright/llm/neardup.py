"""Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

A document's set is its distinct 5-word shingles; rows with equal sets are one
node.  Every node posts itself under each (coordinate, value) of its MinHash
signature.  Linked nodes agree in at least ``t`` of ``k`` coordinates (but for
a chance below ``MISS``), so

* a node of which fewer than ``t`` coordinate values occur elsewhere is linked
  with nothing; a short signature settles most documents that way, and only
  the rest gets a long one and keeps its full set;
* two linked nodes share one of their ``k - t + 1`` rarest values, the prefix;
  only prefixes are joined, and common values are skipped by every node that
  has rarer ones.

Within a posting list nodes are first held against a hub, a few rounds over,
which joins dense groups without listing their pairs.  Lists that then still
hold several components are written to files as blocks of bounded size, long
lists by bands of set sizes too.  A row of two blocks' places goes to a task,
which maps the blocks, counts agreements and confirms those of ``t``
coordinates; so node data are written once, however many blocks a block is
compared with.  All links are confirmed on full sets, which tasks read from
mapped files, too.

Defined cases: a null text is empty; an empty set is linked with nothing and
its own component; null ids never name a component that has another id;
repeated rows share a component, and each of them is kept where their id names
it (``deduplicate`` keeps one).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .common import filesystem, free_names, kept, materialise, small_batches, stored, text_bytes, tidy, work_path

SHINGLE = 5
#: Coordinates of the short and the long signature, and the chance that a link at the threshold goes unseen in one of them.
SHORT, LONG, MISS = 32, 128, 1e-6
#: Rounds of holding posting lists against hubs, and nodes of a block in the comparison after them (about).
HUB_ROUNDS, BLOCK = 2, 1024
#: Postings that a task writes, and blocks that a task compares (about).
WRITE_ROWS, COMPARE_BLOCKS = 50_000, 64
#: Tables of up to so many short rows are broadcast.
BROADCAST_ROWS = 200_000
#: Words whose hashes a worker remembers, and the longest of them.
WORDS, LONGEST = 100_000, 64

_M = (1 << 64) - 1


def matches_needed(k: int, share: float, miss: float = MISS) -> int:
    """The most of ``k`` coordinates that sets of similarity ``share`` agree in, but for a chance of ``miss``."""
    tail, t = 0.0, 0
    while tail <= miss and t <= k:
        tail += comb(k, t) * share**t * (1 - share) ** (k - t)
        t += 1
    return max(1, t - 1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % k, seed) | 1 for k in range(n)], np.uint64)


_FOLD = _constants(SHINGLE, 1)
_XOR, _MULTIPLY = _constants(max(SHORT, LONG), 2), _constants(max(SHORT, LONG), 3)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    memory = kept("shingles", "words", _Hashes)
    w = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    if n < 1:
        return _mix(np.array([(sum(int(x) * int(_FOLD[k]) for k, x in enumerate(w)) + len(w)) & _M], np.uint64))
    h = w[:n] * _FOLD[0]
    for k in range(1, SHINGLE):
        h += w[k : n + k] * _FOLD[k]
    return np.unique(_mix(h))


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """MinHash: the least value of each of ``k`` hash functions, as 32 bits."""
    out = np.full(k, _M, np.uint64)
    for at in range(0, len(hashes), 2048):
        out = np.minimum(out, ((hashes[at : at + 2048, None] ^ _XOR[:k]) * _MULTIPLY[:k]).min(0))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _lists(rows: list[np.ndarray], k: int) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(flat, pa.int32()))


def sketch(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: k1, k2 (the row's name), doc_id, node (null: empty set), n, short signature."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, signatures = [], [], []
            for text in b.column(3).to_pylist():
                s = shingle_set(text)
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                signatures.append(signature(s, SHORT))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), _lists(signatures, SHORT)], names=["k1", "k2", "doc_id", "node", "n", "sig"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(tidy(work, "shingles"), "k1 long, k2 long, doc_id long, node binary, n long, sig array<int>")


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, node): a row per coordinate of column ``sig``; the key holds coordinate and value."""
    each = nodes.select("node", F.posexplode("sig").alias("at", "value"))
    return each.select(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), "node")


def _shared(postings: DataFrame) -> DataFrame:
    """(key, n) of the keys under which more than one node is posted."""
    return postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def likely_linked(sketches: DataFrame, t: int) -> DataFrame:
    """The nodes of which at least ``t`` short coordinates have company, each with the name of one of its rows."""
    rows = sketches.where("node is not null")
    nodes = rows.groupBy("node").agg(F.min_by(F.struct("k1", "k2"), "k1").alias("row"), F.first("sig").alias("sig"))
    nodes = materialise(nodes, "nodes")
    postings = _postings(nodes)
    shared = materialise(_shared(postings), "shared")  # written, so that adaptive execution can split a common value's postings
    company = postings.join(shared, "key", "left_semi").groupBy("node").agg(F.count("*").alias("shared")).where(F.col("shared") >= t)
    return materialise(nodes.join(company, "node").select("node", F.col("row.k1").alias("r1"), F.col("row.k2").alias("r2")), "likely")


def full_sets(docs: DataFrame, likely: DataFrame, folder: str) -> DataFrame:
    """(node, n, file, at, low, sig) of the likely nodes: where long signature and full set stand, the signature's low bytes, and itself.

    Sets are written once, to files below ``folder`` that are mapped into
    memory where pairs are confirmed, so they are never shuffled.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, where = filesystem(folder)
                fs.create_dir(where, recursive=True)
                name = uuid.uuid4()
                out = fs.open_output_stream(f"{where}/{name.hex}")
            nodes, sizes, places, sigs = b.column(0), [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text)
                sig = signature(s, LONG)
                out.write(sig.tobytes() + s.tobytes())
                sizes.append(len(s))
                places.append(at)
                sigs.append(sig)
                at += sig.nbytes + s.nbytes
            yield pa.RecordBatch.from_arrays(
                [nodes, pa.array(sizes, pa.int64()), pa.array([name.bytes] * len(sizes), pa.binary()), pa.array(places, pa.int64()), pa.array([s.astype(np.uint8).tobytes() for s in sigs], pa.binary()), _lists(sigs, LONG)],
                names=["node", "n", "file", "at", "low", "sig"],
            )
        if out is not None:
            out.close()

    rows = docs.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit(1), "doc_id").alias("r2"), text_bytes().alias("body"))
    few = likely.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(likely) if few else likely, ["r1", "r2"]).select("node", "body").mapInArrow(tidy(work, "shingles"), "node binary, n long, file binary, at long, low binary, sig array<int>")
    table = materialise(found, "sets")
    repeated = table.groupBy("node").count().where("count > 1").limit(1).count()
    return materialise(table.dropDuplicates(["node"]), "sets") if repeated else table


def _set_of(folder: str, file: bytes, at: int, n: int) -> np.ndarray:
    return stored(f"{folder}/{file.hex()}", at + 4 * LONG, 8 * n).view(np.uint64)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted full sets meet the threshold."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def prefixes(sets: DataFrame, t: int) -> DataFrame:
    """(key, node, weight): the posting lists of the prefixes; weight says how central a node is."""
    postings = _postings(sets)
    shared = materialise(_shared(postings), "shared")
    ranked = postings.join(shared, "key").groupBy("node").agg(F.count("*").alias("shared"), F.sum("n").alias("weight"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    ranked = ranked.where(F.col("shared") >= t)
    rare = F.slice("keys", 1, F.greatest(F.lit(0), F.col("shared") - (t - 1)).cast("int"))  # unshared values rank first
    return materialise(ranked.select("node", "weight", F.explode(rare).alias("k")).select("k.key", "node", "weight"), "prefixes")


def confirm(pairs: DataFrame, sets: DataFrame, folder: str, percent: int, t: int) -> DataFrame:
    """The (a, b) of ``pairs`` that agree in ``t`` coordinates and whose full sets meet the threshold."""
    small_batches(pairs.sparkSession)
    side = lambda c: sets.select(F.col("node").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("n", "file", "at", "low")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [np.frombuffer(b"".join(b.column(f"low_{c}").to_pylist()), np.uint8).reshape(-1, LONG) for c in "ab"]
            keep = (low[0] == low[1]).sum(1) >= t
            where = [list(zip(*(b.column(f"{n}_{c}").to_pylist() for n in ("file", "at", "n")), strict=True)) for c in "ab"]
            for k in np.flatnonzero(keep):
                keep[k] = _linked(_set_of(folder, *where[0][k]), _set_of(folder, *where[1][k]), percent)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    full = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return materialise(full.mapInArrow(tidy(work), "a binary, b binary"), "links")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("label", F.coalesce("comp", "node")).drop("comp")


def _across(postings: DataFrame) -> DataFrame:
    """The posting lists that hold more than one label."""
    open_keys = postings.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return postings.join(materialise(open_keys, "open-keys"), "key", "left_semi")


def _posted(t: int) -> np.dtype:
    """A posting in a block's file: names as two words each, the low bytes of its signature, its prefix's coordinates and their values."""
    return np.dtype([("node", "<u8", 2), ("label", "<u8", 2), ("file", "<u8", 2), ("at", "<i8"), ("n", "<i8"), ("low", "<u8", LONG // 8), ("mask", "u1", LONG // 8), ("values", "<i4", LONG - t + 1)])


def _write_blocks(postings: DataFrame, sets: DataFrame, percent: int, t: int, folder: str) -> DataFrame:
    """Posting lists as blocks in files: (key, band, part, rows, file, at, lo, hi), the last two the block's least and greatest label.

    A list of more than ``BLOCK`` nodes is cut by bands of set sizes, of which
    linked nodes lie in the same or in neighbouring ones, and bands by hash.
    """
    posted = _posted(t)
    keys = postings.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    about = sets.select("node", "n", "file", "at", "low", F.floor(F.log("n") / (1.0001 * log(100 / percent) + 1e-9)).cast("int").alias("size")).join(keys, "node")
    placed = materialise(postings.select("key", "node", "label").join(about, "node"), "postings")
    per = placed.groupBy("key", "size").agg(F.count("*").alias("c"))
    long = materialise(per.withColumn("total", F.sum("c").over(Window.partitionBy("key"))).where(F.col("total") > BLOCK).select("key", "size", "c"), "long-lists")
    few = long.count() <= BROADCAST_ROWS
    cut = placed.join(F.broadcast(long) if few else long, ["key", "size"], "left")
    cut = cut.withColumn("band", F.when(F.col("c").isNull(), F.lit(-1)).otherwise(F.col("size"))).withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK)).cast("int"), F.lit(0)))
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // WRITE_ROWS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, end, current, rows = None, 0, None, []  # current: a block's name, begin, and label bounds so far
        words = lambda c: np.frombuffer(b"".join(c.to_pylist()), "<u8").reshape(len(c), -1)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, where = filesystem(folder)
                fs.create_dir(where, recursive=True)
                name = uuid.uuid4()
                out = fs.open_output_stream(f"{where}/{name.hex}")
            r = np.zeros(b.num_rows, posted)
            for f in ("node", "label", "file", "low"):
                r[f] = words(b.column(f))
            for f in ("at", "n"):
                r[f] = b.column(f).to_numpy()
            held = b.column("keys")
            flat, sizes = held.flatten().to_numpy(), np.diff(held.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            bits = np.zeros((b.num_rows, LONG), bool)
            bits[row, flat >> 32] = True
            r["mask"] = np.packbits(bits, axis=1)
            r["values"][row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (flat & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            out.write(r.tobytes())
            spot = np.stack([b.column(c).to_numpy() for c in ("key", "band", "part")], 1)
            label = b.column("label").to_pylist()
            starts = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]).any(1)]).tolist()
            for x, y in zip(starts, [*starts[1:], b.num_rows], strict=True):
                own, lo, hi = tuple(spot[x].tolist()), min(label[x:y]), max(label[x:y])
                if current is not None and current[0] == own:
                    current[2:] = [min(lo, current[2]), max(hi, current[3]), current[4] + y - x]
                    continue
                if current is not None:
                    rows.append(current)
                current = [own, end + x * posted.itemsize, lo, hi, y - x]
            end += r.nbytes
        if out is not None:
            out.close()
            rows.append(current)
            columns = [*zip(*(c[0] for c in rows), strict=True), *list(zip(*(c[1:] for c in rows), strict=True))]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array([name.bytes] * len(rows), pa.binary())], names=["key", "band", "part", "at", "lo", "hi", "rows", "file"])

    schema = "key long, band int, part int, at long, lo binary, hi binary, rows long, file binary"
    dealt = cut.select("key", "band", "part", "node", "label", "file", "low", "at", "n", "keys").repartition(tasks, "key", "band", "part").sortWithinPartitions("key", "band", "part")
    return materialise(dealt.mapInArrow(tidy(work), schema), "blocks")


def _disagreements(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In how many low bytes each of ``rows`` differs from ``x``, eight at a time."""
    v = rows ^ x
    sevens = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count((((v & sevens) + sevens) | v) & ~sevens).sum(1, dtype=np.int64)


def _prefix_values(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By node and coordinate: whether the prefix holds it, and its value there."""
    held = np.unpackbits(block["mask"], axis=1).astype(bool)
    values = np.zeros(held.shape, np.int32)
    values[held] = block["values"][np.arange(block["values"].shape[1]) < held.sum(1)[:, None]]
    return held, values


class _Joined(dict):
    """Labels that a task has joined so far, by union and find."""

    def __missing__(self, label: int) -> int:
        return label

    def find(self, label: int) -> int:
        while (up := self[label]) != label:
            self[label] = self[up]
            label = up
        return label


def _compare(a: np.ndarray, b: np.ndarray | None, coordinate: int, folder: str, percent: int, t: int, joined: _Joined) -> list[tuple[bytes, bytes]]:
    """Links between nodes of different labels in block ``a``, or (given ``b``) between the blocks, as many as join what they join.

    Nodes of the main label are not compared with each other.  A pair is
    looked at where it meets under the least coordinate that both prefixes
    hold, and not once its labels have been joined.
    """
    names = a["label"][:, 0] if b is None else np.concatenate([a["label"][:, 0], b["label"][:, 0]])
    kinds, at = np.unique(names, return_inverse=True)
    tops = [joined.find(k) for k in kinds.tolist()]
    if len(set(tops)) < 2:
        return []
    label = np.unique(np.array(tops, np.uint64), return_inverse=True)[1][at]
    both = a if b is None else np.concatenate([a, b])
    n, low, cut = both["n"], both["low"], len(a)
    main, out = int(np.bincount(label).argmax()), []
    order, prefix = np.arange(len(both)), None
    for x in np.flatnonzero(label != main).tolist():
        ok = (label != label[x]) & ((label == main) | (order > x)) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if b is not None:
            ok &= (order < cut) != (x < cut)
        near = np.flatnonzero(ok)
        if not len(near):
            continue
        agree = LONG - _disagreements(low[near], low[x])
        near, agree = near[agree >= t], agree[agree >= t]
        if not len(near):
            continue
        prefix = prefix or _prefix_values(both)
        shared = prefix[0][near] & prefix[0][x] & (prefix[1][near] == prefix[1][x])
        here = shared.argmax(1) == coordinate
        for y in near[here][np.argsort(-agree[here], kind="stable")].tolist():
            lx, ly = joined.find(int(names[x])), joined.find(int(names[y]))
            if lx == ly:
                continue
            sets = [_set_of(folder, both["file"][z].tobytes(), int(both["at"][z]), int(n[z])) for z in (x, y)]
            if _linked(*sets, percent):
                joined[lx] = ly
                out.append((both["node"][x].tobytes(), both["node"][y].tobytes()))
    return out


def _blocks(postings: DataFrame, sets: DataFrame, folder: str, percent: int, t: int) -> DataFrame:
    """Links (a, b) between different labels that meet in a posting list; agreements are confirmed in place, so only links leave a task."""
    spark = postings.sparkSession
    lists = work_path(spark, "list-files")
    blocks = _write_blocks(postings, sets, percent, t, lists)
    posted = _posted(t)
    side = lambda c: blocks.where("band >= 0").select("key", *(F.col(n).alias(f"{n}_{c}") for n in ("band", "part", "file", "at", "rows", "lo", "hi")))
    after = (F.col("band_b") == F.col("band_a") + 1) | (F.col("band_b") == F.col("band_a")) & (F.col("part_b") > F.col("part_a"))
    several = ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))
    cross = side("a").join(side("b"), "key").where(after & several).select("key", "file_a", "at_a", "rows_a", "file_b", "at_b", "rows_b")
    alone = blocks.where("lo != hi").select("key", F.col("file").alias("file_a"), F.col("at").alias("at_a"), F.col("rows").alias("rows_a"), F.lit(None).cast("binary").alias("file_b"), F.lit(None).cast("long").alias("at_b"), F.lit(0).cast("long").alias("rows_b"))
    pairs = materialise(alone.unionByName(cross), "block-pairs")
    cost = pairs.agg(F.sum(F.col("rows_a").cast("double") * F.greatest("rows_a", "rows_b")).alias("c")).first().c or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(cost / (COMPARE_BLOCKS * BLOCK**2)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda file, at, rows: stored(f"{lists}/{file.hex()}", at, rows * posted.itemsize).view(posted)
        joined = _Joined()
        for b in batches:
            out = []
            for key, fa, at_a, ra, fb, at_b, rb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += _compare(load(fa, at_a, ra), None if fb is None else load(fb, at_b, rb), key >> 32, folder, percent, t, joined)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return materialise(pairs.repartition(tasks).sortWithinPartitions("file_a", "at_a").mapInArrow(tidy(work), "a binary, b binary"), "links")


def linked_components(docs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame | None:
    """(node, comp) of all nodes that are linked with another; None if there is none."""
    share = percent / 100
    t_short, t_long = matches_needed(SHORT, share), matches_needed(LONG, share)
    likely = likely_linked(sketches, t_short)
    if likely.isEmpty():
        return None
    folder = work_path(docs.sparkSession, "set-files")
    sets = full_sets(docs, likely, folder)
    postings = prefixes(sets, t_long)
    links, labels, hubs = None, None, None
    for _ in range(HUB_ROUNDS):
        current = _across(_labelled(postings, labels))
        current = materialise(current, "open-lists")
        free = current
        if hubs is not None:  # lists choose the next hub among what no earlier hub has joined
            named = _labelled(hubs, labels).select("key", "label").distinct()
            free = current.join(named, ["key", "label"], "left_anti")
        chosen = materialise(free.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("node")), "hubs")
        if chosen.isEmpty():
            break
        hub = _labelled(chosen, labels).select("key", F.col("node").alias("a"), F.col("label").alias("hub_label"))
        pairs = current.join(hub, "key").where(F.col("label") != F.col("hub_label")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        found = confirm(pairs, sets, folder, percent, t_long)
        links = found if links is None else links.unionByName(found)
        hubs = chosen if hubs is None else hubs.unionByName(chosen)
        labels = materialise(components(links), "labels")
    rest = materialise(_across(_labelled(postings, labels)), "open-lists")
    if not rest.isEmpty():
        found = _blocks(rest, sets, folder, percent, t_long)
        links = found if links is None else links.unionByName(found)
        labels = materialise(components(links), "labels")
    return labels


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """k1, k2, doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Rows are linked where 100 * intersection >= ``percent`` * union of their sets.
    """
    sketches = materialise(sketch(docs), "sketches")
    labels = linked_components(docs, sketches, percent)
    rows = sketches.select("k1", "k2", "doc_id", "node", "n")
    rows = rows.withColumn("comp", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = materialise(rows, "components")
    named = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"))
    out = rows.join(materialise(named, "named"), "comp", "left")  # of two written tables, so that a common component can be split
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    first = F.col("comp").isNull() | ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")))
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id."""
    found = materialise(near_duplicates(docs, percent), "near-duplicates")
    d1, d2 = free_names(docs, "d1", "d2")
    k1, k2 = F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id")
    gone = found.where("not first").select(F.col("k1").alias(d1), F.col("k2").alias(d2)).distinct()
    gone = materialise(gone, "dropped")
    kept_rows = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, (k1 == F.col(d1)) & (k2 == F.col(d2)), "left_anti")
    repeated = found.where("first and n_shingles > 0").groupBy("k1", "k2").count().where("count > 1").limit(1).count()
    if repeated:
        words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
        full = kept_rows.where(words > 0).withColumns({d1: k1, d2: k2}).dropDuplicates([d1, d2]).drop(d1, d2)
        kept_rows = full.unionByName(kept_rows.where(words == 0))
    return kept_rows
