"""An exact join on the Jaccard similarity of word n-grams, by size-banded tiles of bitmap signatures.

A document's set is its distinct 5-word shingles, as hashes; rows with equal sets
are one node.  Linked nodes of ``percent`` or more share hashes at the low end
of their sorted sets: if each posts its lowest ``n - ceil(percent * n / 100) + e``,
the one whose posted part ends first has ``e`` of them in common with the other.

* Nodes of which fewer posted hashes occur elsewhere than any link would need
  are linked with nothing; one pass over the texts settles most of them.
* The others keep bitmap and full set in files.  Their posting lists take
  hashes of the most common ones last (any one order for all nodes is exact,
  so how many of those are known only matters for speed).  Dense groups are
  first joined through one node of each list.
* Lists that still hold several components are cut into tiles: long ones by
  bands of set sizes, of which linked nodes lie in the same or in neighbouring
  ones, and bands by hash.  In a tile, every pair's bitmaps are compared: bits
  that differ bound the overlap from above.  What stays is confirmed by
  intersecting the sorted full sets.

Bitmaps hold the parity of the hashes that fall on a bit, so one of twice the
width folds onto the narrower of its neighbour.

Defined cases: doc_id is taken as a long; a null text is empty; an empty set
is linked with nothing and its own component; null ids never name a component that
has another id; repeated rows share a component; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import filesystem, materialise, small_batches, stored, text_bytes, tidy, work_path
from .neardup import shingle_set

#: One more posted hash for so many in a set, so that chance company links nothing.
SLACK = 16
#: Nodes of a tile's side (about), and the widest bitmap in bits.
BLOCK, MOST_BITS = 1024, 1 << 15
#: Lists longer than ``HOT`` have their hash taken last, for the ``HOT_HASHES`` most common ones; rounds of finding them.
HOT, HOT_HASHES, HOT_ROUNDS = 64, 1 << 18, 3
#: Hashes of a node whose lists are joined first.
FEW = 4
#: Tables of up to so many short rows are broadcast.
BROADCAST_ROWS = 200_000
#: Pairs that one task compares (about).
TASK_PAIRS = 50_000_000


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set that it is linked with."""
    return -(-percent * n // 100)


def bits(n: int) -> int:
    """The width of the bitmap of a set of ``n``."""
    return min(MOST_BITS, max(64, 1 << (2 * n - 1).bit_length()))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes on each bit, as words."""
    width = bits(len(hashes))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of words) at a width of ``words``."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def possible(differ: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of together ``both`` elements may be linked if so many bits differ."""
    most = (both - differ) // 2
    return 100 * most >= percent * (both - most)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))


def _longs(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """One pass over whole texts: rid (the row's number), k1, k2, doc_id, node (null: empty set), n, posted hashes."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, posted = [], [], []
            for text in b.column(3).to_pylist():
                s = shingle_set(text)
                n = len(s)
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                sizes.append(n)
                posted.append(s[: n - needed(n, percent) + 1 + n // SLACK] if n else s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), _longs(posted)], names=["k1", "k2", "doc_id", "node", "n", "posted"])

    found = _bodies(docs).mapInArrow(tidy(work, "shingles"), "k1 long, k2 long, doc_id long, node binary, n long, posted array<long>")
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()), "sketches")


def _equal(sketches: DataFrame) -> DataFrame:
    """(node, num) of sets that several rows have: the node's name is its least row."""
    several = sketches.where("node is not null").groupBy("node").agg(F.min("rid").alias("num"), F.count("*").alias("c")).where("c > 1").select("node", "num")
    return materialise(several, "equal")


def _shared(postings: DataFrame) -> DataFrame:
    """(key, df) of the hashes that more than one node posts."""
    return postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")


def likely_linked(sketches: DataFrame, equal: DataFrame, percent: int) -> DataFrame:
    """(num, k1, k2) of the nodes that have as much company as a link needs."""
    copies = materialise(sketches.select("node", "rid").join(_small(equal), "node").where("rid != num").select("rid"), "copies")
    nodes = sketches.where("node is not null").join(_small(copies), "rid", "left_anti")
    postings = nodes.select(F.col("rid").alias("num"), "n", F.explode("posted").alias("key"))
    shared = materialise(_shared(postings), "shared")
    company = postings.join(shared.select("key"), "key", "left_semi").groupBy("num").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    enough = materialise(company.where(F.col("c") > F.floor(F.ceil(F.col("n") * percent / 100) / SLACK)).select("num"), "enough")
    return materialise(nodes.select(F.col("rid").alias("num"), "k1", "k2").join(_small(enough), "num", "left_semi"), "likely")


def full_sets(docs: DataFrame, likely: DataFrame, folder: str) -> DataFrame:
    """(num, n, file, at) of the likely nodes: where bitmap and full set stand in files below ``folder``, which are mapped into memory."""
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
            sizes, places = [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text)
                m = bitmap(s)
                out.write(m.tobytes() + s.tobytes())
                sizes.append(len(s))
                places.append(at)
                at += m.nbytes + s.nbytes
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array([name.bytes] * len(sizes), pa.binary()), pa.array(places, pa.int64())], names=["num", "n", "file", "at"])
        if out is not None:
            out.close()

    found = _bodies(docs).join(_small(likely), ["k1", "k2"]).select("num", "body").mapInArrow(tidy(work, "shingles"), "num long, n long, file binary, at long")
    table = materialise(found, "sets")
    repeated = table.groupBy("num").count().where("count > 1").limit(1).count()  # a row that stands there twice
    return materialise(table.dropDuplicates(["num"]), "sets") if repeated else table


def _map_of(folder: str, file: bytes, at: int, n: int) -> np.ndarray:
    return stored(f"{folder}/{file.hex()}", at, bits(n) // 8).view(np.uint64)


def _set_of(folder: str, file: bytes, at: int, n: int) -> np.ndarray:
    return stored(f"{folder}/{file.hex()}", at + bits(n) // 8, 8 * n).view(np.uint64)


def _posted(sets: DataFrame, folder: str, percent: int, hot: np.ndarray) -> DataFrame:
    """(num, keys): the hashes by which each node is listed, the lowest of its set with the ``hot`` ones (sorted) last."""
    known = sets.sparkSession.sparkContext.broadcast(hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = known.value
        for b in batches:
            keys = []
            for file, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
                s = _set_of(folder, file, at, n)
                if len(last):
                    common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.concatenate([s[~common], s[common]])
                keys.append(s[: n - needed(n, percent) + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), _longs(keys)], names=["num", "keys"])

    return sets.select("num", "file", "at", "n").mapInArrow(tidy(work), "num long, keys array<long>")


def listed(sets: DataFrame, folder: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(num, keys) of the likely nodes, and (key, df) of the keys that several of them have."""
    hot = np.zeros(0, np.uint64)
    for last in [False] * HOT_ROUNDS + [True]:
        keys = materialise(_posted(sets, folder, percent, hot), "keys")
        shared = materialise(_shared(keys.select("num", F.explode("keys").alias("key"))), "shared")
        if last or len(hot) >= HOT_HASHES:
            break
        most = shared.where(F.col("df") > HOT).orderBy(F.desc("df"), "key").limit(HOT_HASHES - len(hot))
        new = np.setdiff1d(np.array([r.key for r in most.collect()], np.int64).view(np.uint64), hot)
        if not len(new):
            break
        hot = np.union1d(hot, new)
    return keys, shared


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component that a node is known to lie in."""
    if labels is None:
        return rows.withColumn("label", F.col("num"))
    return rows.join(_small(labels.withColumnRenamed("node", "num")), "num", "left").withColumn("label", F.coalesce("comp", "num")).drop("comp")


def _open(postings: DataFrame) -> DataFrame:
    """The lists that hold more than one component, both sides of the join written, so that a long list can be split."""
    postings = materialise(postings, "postings")
    several = postings.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return materialise(postings.join(_small(materialise(several, "open-keys")), "key", "left_semi"), "open-lists")


def confirm(pairs: DataFrame, sets: DataFrame, folder: str, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose bitmaps allow a link and whose sets have it."""
    side = lambda c: sets.select(F.col("num").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("n", "file", "at")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [zip(*(b.column(f"{c}_{s}").to_pylist() for c in ("file", "at", "n")), strict=True) for s in "ab"]
            keep = [_linked(folder, x, y, percent) for x, y in zip(*places, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return materialise(full.mapInArrow(tidy(work), "a long, b long"), "links")


def _linked(folder: str, x: tuple[bytes, int, int], y: tuple[bytes, int, int], percent: int, mapped: bool = True) -> bool:
    """Whether two stored sets (file, place, size) are linked, by their bitmaps first."""
    both = x[2] + y[2]
    if mapped:
        a, b = _map_of(folder, *x), _map_of(folder, *y)
        words = min(len(a), len(b))
        if not possible(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum(dtype=np.int64), both, percent):
            return False
    o = overlap(_set_of(folder, *x), _set_of(folder, *y))
    return 100 * o >= percent * (both - o)


class _Joined(dict):
    """Components that a task has joined so far, by union and find."""

    def __missing__(self, label: int) -> int:
        return label

    def find(self, label: int) -> int:
        while (up := self[label]) != label:
            self[label] = self[up]
            label = up
        return label


def tile_links(num: np.ndarray, label: np.ndarray, n: np.ndarray, place: list[tuple[bytes, int, int]], side: np.ndarray, folder: str, percent: int, joined: _Joined | None) -> list[tuple[int, int]]:
    """Links in a tile: between its two sides, or (all on one side) among its nodes.

    Given ``joined``, only as many as join different components; else all.
    """
    by = np.argsort(n, kind="stable")
    num, label, n, side, place = num[by], label[by], n[by], side[by], [place[k] for k in by.tolist()]
    if joined is None:
        label = np.arange(len(num))
    else:
        label = np.array([joined.find(x) for x in label.tolist()])
    kinds, at = np.unique(label, return_inverse=True)
    if len(kinds) < 2:
        return []
    main = kinds[np.bincount(at).argmax()] if joined is not None else -1
    crossing = side.min() != side.max()
    words = np.array([bits(k) // 64 for k in n.tolist()])
    maps = {w: np.stack([_map_of(folder, *place[k]) for k in np.flatnonzero(words == w).tolist()]) for w in np.unique(words).tolist()}
    first = {w: int(np.searchsorted(words, w)) for w in maps}  # sizes ascend, and so do widths
    folded: dict[tuple[int, int], np.ndarray] = {}
    low, high = np.searchsorted(n, -(-percent * n // 100)), np.searchsorted(n, 100 * n // percent, "right")
    out = []
    for x in np.flatnonzero(label != main).tolist():
        w = int(words[x])
        for other in [v for v in (w // 2, w, 2 * w) if v in maps]:
            begin = first[other]
            lo, hi = max(int(low[x]), begin), min(int(high[x]), begin + len(maps[other]))
            if lo >= hi:
                continue
            narrow = min(w, other)
            if (other, narrow) not in folded:
                folded[other, narrow] = fold(maps[other], narrow)
            mine = fold(maps[w][x - first[w]], narrow)
            y = np.arange(lo, hi)
            ok = (label[lo:hi] != label[x]) & ((label[lo:hi] == main) | (y > x))
            if crossing:
                ok &= side[lo:hi] != side[x]
            y = y[ok]
            if not len(y):
                continue
            differ = np.bitwise_count(folded[other, narrow][y - begin] ^ mine).sum(1, dtype=np.int64)
            for k in y[possible(differ, n[y] + n[x], percent)].tolist():
                if joined is not None:
                    a, b = joined.find(int(label[x])), joined.find(int(label[k]))
                    if a == b:
                        continue
                if _linked(folder, place[x], place[k], percent, mapped=False):
                    out.append((int(num[x]), int(num[k])))
                    if joined is not None:
                        joined[a] = b
    return out


def tiles(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, band_a, part_a, band_b, part_b, side, num, label, n, file, at): each list's nodes by tile.

    Lists of up to ``BLOCK`` nodes are a tile; longer ones are cut by bands of
    sizes, and bands by hash, and a node goes into the tiles of its part with every
    part of its own band and the bands beside it.
    """
    band = F.floor(F.log("n") / (1.0001 * log(100 / percent) + 1e-9)).cast("int")
    placed = materialise(lists.select("key", "num", "label").join(_small(sets), "num").withColumn("band", band), "placed")
    per = materialise(placed.groupBy("key", "band").agg(F.count("*").alias("c")), "bands")
    long = per.groupBy("key").agg(F.sum("c").alias("total")).where(F.col("total") > BLOCK).select("key")
    parts = per.join(long, "key", "left_semi").select("key", "band", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    beside = lambda by, name: parts.select("key", (F.col("band") + by).alias("band"), F.col("parts").alias(name))
    cut = materialise(parts.join(beside(1, "below"), ["key", "band"], "left").join(beside(-1, "above"), ["key", "band"], "left"), "cut-lists")
    rows = placed.join(_small(cut), ["key", "band"], "left").withColumn("part", F.pmod(F.xxhash64("num"), F.coalesce("parts", F.lit(1))).cast("int"))
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda a, p, b, q, s: F.struct(a.alias("band_a"), p.alias("part_a"), b.alias("band_b"), q.alias("part_b"), F.lit(s).alias("side"))
    own, mine, zero = F.col("band"), F.col("part"), F.lit(0)
    within = F.transform(numbers("parts"), lambda q: F.when(q < mine, tile(own, q, own, mine, 1)).when(q > mine, tile(own, mine, own, q, 0)).otherwise(tile(own, mine, own, mine, 0)))
    lower = F.transform(numbers("below"), lambda q: tile(own - 1, q, own, mine, 1))
    upper = F.transform(numbers("above"), lambda q: tile(own, mine, own + 1, q, 0))
    whole = F.array(tile(F.lit(-1), zero, F.lit(-1), zero, 0))
    places = F.when(F.col("parts").isNull(), whole).otherwise(F.concat(within, lower, upper))
    return rows.withColumn("tile", F.explode(places)).select("key", "tile.*", "num", "label", "n", "file", "at")


def compare(lists: DataFrame, sets: DataFrame, folder: str, percent: int, all_links: bool = False) -> DataFrame:
    """The links (a, b) of nodes that meet in a list: such as join components, or all of them."""
    spark = lists.sparkSession
    rows = materialise(tiles(lists, sets, percent), "tiles")
    spot = ["key", "band_a", "part_a", "band_b", "part_b"]
    cost = rows.groupBy(*spot).agg(F.count("*").alias("c")).agg(F.sum(F.col("c").cast("double") ** 2).alias("cost")).first().cost or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(cost / TASK_PAIRS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = None if all_links else _Joined()
        held: list[tuple[np.ndarray, ...]] = []
        at: tuple[int, ...] | None = None

        def close() -> list[tuple[int, int]]:
            num, label, n, side, file, begin = (np.concatenate(c) for c in zip(*held, strict=True))
            if len(num) < 2:
                return []
            return tile_links(num, label, n, list(zip(file.tolist(), begin.tolist(), n.tolist(), strict=True)), side, folder, percent, joined)

        def batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            spots = np.stack([b.column(c).to_numpy() for c in spot], 1)
            columns = [*(b.column(c).to_numpy() for c in ("num", "label", "n", "side")), np.array(b.column("file").to_pylist(), object), b.column("at").to_numpy()]
            starts = np.flatnonzero(np.r_[True, (spots[1:] != spots[:-1]).any(1)]).tolist()
            links: list[tuple[int, int]] = []
            for x, y in zip(starts, [*starts[1:], b.num_rows], strict=True):
                here = tuple(spots[x].tolist())
                if here != at and held:
                    links += close()
                    held.clear()
                at = here
                held.append(tuple(c[x:y] for c in columns))
            yield batch(links)
        if held:
            yield batch(close())

    dealt = rows.repartition(tasks, *spot).sortWithinPartitions(*spot)
    return materialise(dealt.mapInArrow(tidy(work), "a long, b long"), "links")


def _postings(keys: DataFrame, shared: DataFrame, few: int | None = None) -> DataFrame:
    """(key, num) of all shared keys, or of those among a node's first ``few``."""
    each = keys.select("num", F.explode(F.slice("keys", 1, few) if few else "keys").alias("key"))
    return materialise(each, "postings").join(shared.select("key"), "key", "left_semi")


def linked_components(docs: DataFrame, sketches: DataFrame, equal: DataFrame, percent: int) -> DataFrame | None:
    """(node, comp) of all nodes that are linked with another; None if there is none."""
    likely = likely_linked(sketches, equal, percent)
    if likely.isEmpty():
        return None
    folder = work_path(docs.sparkSession, "set-files")
    sets = full_sets(docs, likely, folder)
    keys, shared = listed(sets, folder, percent)
    links, labels = None, None
    for few in (FEW, None):
        current = _open(_labelled(_postings(keys, shared, few), labels))
        hubs = materialise(current.groupBy("key").agg(F.max(F.struct("num", "label")).alias("hub")), "hubs")
        if hubs.isEmpty():
            continue
        pairs = current.join(_small(hubs), "key").where(F.col("label") != F.col("hub.label")).select(F.least("num", "hub.num").alias("a"), F.greatest("num", "hub.num").alias("b")).distinct()
        found = confirm(pairs, sets, folder, percent)
        links = found if links is None else links.unionByName(found)
        labels = materialise(components(links), "labels")
    rest = _open(_labelled(_postings(keys, shared), labels))
    if not rest.isEmpty():
        links_here = compare(rest, sets, folder, percent)
        links = links_here if links is None else links.unionByName(links_here)
        labels = materialise(components(links), "labels")
    return labels


def _named(sketches: DataFrame, equal: DataFrame) -> DataFrame:
    """The rows of ``sketches`` with their node's number."""
    return sketches.select("rid", "doc_id", "node", "n").join(_small(equal), "node", "left").withColumn("num", F.when(F.col("node").isNotNull(), F.coalesce("num", "rid")))


def similar(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``, where 100 * intersection >= ``percent`` * union links two."""
    sketches = sketch(docs, percent)
    equal = _equal(sketches)
    labels = linked_components(docs, sketches, equal, percent)
    rows = _named(sketches, equal)
    if labels is None:
        rows = rows.withColumn("comp", F.col("num"))
    else:
        rows = rows.join(_small(labels.withColumnRenamed("node", "num")), "num", "left").withColumn("comp", F.coalesce("comp", "num"))
    rows = materialise(rows.select("doc_id", "n", "comp"), "components")
    least = materialise(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    out = rows.join(_small(least), "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def join(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The join itself: (doc_id, n_shingles, num) of each row, equal sets under one number (null: empty), and all links (a, b) between numbers."""
    sketches = sketch(docs, percent)
    equal = _equal(sketches)
    rows = _named(sketches, equal).select("doc_id", F.col("n").alias("n_shingles"), "num")
    likely = likely_linked(sketches, equal, percent)
    folder = work_path(docs.sparkSession, "set-files")
    sets = full_sets(docs, likely, folder)
    keys, shared = listed(sets, folder, percent)
    return rows, compare(_labelled(_postings(keys, shared), None), sets, folder, percent, all_links=True).distinct()
