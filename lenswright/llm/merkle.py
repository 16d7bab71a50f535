"""A Merkle manifest of a dataset: a tree for each source, and one over the sources.

Rows are dealt out by ranges of (source, doc_id), digests only, so a common source is
cut wherever a range ends.  Each range's task builds what it can and holds the
rest as a sparse forest: unresolved nodes by tree, level and index.  Forests form
a monoid.  Their sum is the union of their nodes, in which every run of
siblings that is complete (the tree's size says how many it has) gives way to its
parent, and a source's root to a leaf of the tree over the sources.  A tree of
reductions adds neighbouring forests, so that what a task holds is
the two rims of its range: at most fifteen nodes a level and rim.

Runs that no single range holds are kept as they are completed.  For proofs,
each range is given those above it, builds its own again, and reads off the
siblings on every row's path.

Defined cases: doc_id and n_chars are integers, others null; null fields have their own encoding, null sources and ids come
first; repeated rows are leaves like others, equal ids stand by their digests;
an empty table has an empty manifest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.workspace import numbered
from .common import ascii_lower, id_crc32, materialise, tidy

#: Siblings of a run.
ARITY = 16
#: Rows of a range (about), and forests that are added in one task.
RANGE_ROWS, FAN = 100_000, 32
#: Tables of up to so many short rows are broadcast.
BROADCAST_ROWS = 200_000
#: The tree over the sources; sources' trees count from 0.
TOP = -1

Node = tuple[int, int, int]  # tree, level, index


def h(*digests: bytes) -> bytes:
    """sha256 of what is given, in hex digits."""
    return sha256(b"".join(digests)).hexdigest().encode()


def width(size: int, level: int) -> int:
    """The nodes of a level of a tree with ``size`` leaves."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


class Forest:
    """Unresolved nodes of a part of the dataset.

    ``trees`` is the number of sources; a node comes with its tree's size.
    ``done`` has the runs completed here, by tree, level and number of the run.
    """

    def __init__(self, trees: int) -> None:
        self.trees = trees
        self.sizes: dict[int, int] = {TOP: trees}
        self.open: dict[Node, dict[int, bytes]] = {}
        self.done: dict[Node, list[bytes]] = {}

    def add(self, tree: int, size: int, level: int, index: int, digest: bytes) -> None:
        """Put in a node; complete runs give way to their parents."""
        while True:
            if tree != TOP:
                self.sizes[tree] = size
            wide = width(size, level)
            if wide == 1 and tree != TOP:  # a source's root is a leaf above
                self.sizes.pop(tree, None)
                tree, size, level, index = TOP, self.trees, 0, tree
                continue
            run = index // ARITY
            held = self.open.setdefault((tree, level, run), {})
            held[index] = digest
            if wide == 1 or len(held) < min(ARITY, wide - run * ARITY):
                return
            del self.open[tree, level, run]
            siblings = [held[k] for k in sorted(held)]
            self.done[tree, level, run] = siblings
            level, index, digest = level + 1, run, h(*siblings)

    def nodes(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        """The unresolved nodes: tree, its size, level, index, digest."""
        for (tree, level, _), held in self.open.items():
            for index, digest in held.items():
                yield tree, self.sizes[tree], level, index, digest


def path(tree: int, size: int, level: int, index: int, trees: int) -> Iterator[tuple[Node, int]]:
    """The runs on a node's way to the root, each with the place that the way takes in it."""
    while True:
        if width(size, level) == 1:
            if tree == TOP:
                return
            tree, size, level, index = TOP, trees, 0, tree
            continue
        yield (tree, level, index // ARITY), index % ARITY
        level, index = level + 1, index // ARITY


def _field(c: Column) -> Column:
    """A field as leaves hash it."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """A row's digest, given what stands for its text."""
    return F.sha2(F.concat(_field(F.col("doc_id").cast("long")), _field(F.col("source")), _field(F.col("lang")), _field(F.col("n_chars").cast("long")), _field(text)), 256)


def _placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (source, doc_id, leaf, ...) with range, tree, size and index, and the number of trees."""
    spark = rows.sparkSession
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # so that ranges can cut repeated rows, too
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = materialise(rows.repartitionByRange(ranges, F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("tie")).withColumn("part", F.spark_partition_id().cast("long")), "ranges")
    counts = materialise(dealt.groupBy("source", "part").agg(F.count("*").alias("n")), "counts")
    trees = numbered(counts.groupBy("source").agg(F.sum("n").alias("size")), [F.asc_nulls_first("source")], "tree")
    trees = materialise(trees, "trees")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")  # a short row for each range of a source
    places = counts.withColumn("before", before).drop("n").withColumnRenamed("source", "s")
    places = materialise(places.join(trees.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t").withColumnRenamed("part", "p"), "places")
    small = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    row = F.row_number().over(Window.partitionBy("part", "source").orderBy(F.asc_nulls_first("doc_id"), "leaf", "tie"))
    out = dealt.withColumn("row", row).join(small, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return materialise(out.withColumn("index", F.col("before") + F.col("row") - 1).drop("row", "before", "s", "p", "tie"), "placed"), trees.count()


_NODES = "part long, tree long, size long, level int, index long, digest binary, siblings array<binary>"


def _rows(part: int, forest: Forest, runs: bool) -> pa.Table:
    """A forest's unresolved nodes, and (``runs``) what it completed: rows with siblings."""
    rows = [(part, t, s, l, i, d, None) for t, s, l, i, d in forest.nodes()]
    if runs:
        rows += [(part, t, 0, l, r, None, siblings) for (t, l, r), siblings in forest.done.items()]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "tree", "size", "level", "index", "digest", "siblings"])


def _forests(placed: DataFrame, trees: int) -> DataFrame:
    """Every range's unresolved nodes."""

    def build(key: tuple[pa.Scalar, ...], leaves: pa.Table) -> pa.Table:
        forest = Forest(trees)
        for tree, size, index, digest in zip(*(leaves.column(c).to_pylist() for c in ("tree", "size", "index", "leaf")), strict=True):
            forest.add(tree, size, 0, index, digest.encode())
            forest.done.clear()
        return _rows(key[0].as_py(), forest, False)

    return materialise(placed.select("part", "tree", "size", "index", "leaf").groupBy("part").applyInArrow(build, _NODES), "forests")


def tree_reduce(forests: DataFrame, trees: int, fan: int = FAN) -> tuple[DataFrame, DataFrame | None]:
    """The sum of all forests, neighbours first, and the runs that were completed on the way."""

    def merge(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
        forest = Forest(trees)
        for row in zip(*(nodes.column(c).to_pylist() for c in ("tree", "size", "level", "index", "digest")), strict=True):
            forest.add(*row)
        return _rows(key[0].as_py(), forest, True)

    runs, most = None, forests.agg(F.max("part")).first()[0]
    while most:
        neighbours = forests.withColumn("part", F.floor(F.col("part") / fan))
        table = materialise(neighbours.groupBy("part").applyInArrow(merge, _NODES), "forests")
        completed = table.where("siblings is not null").select("tree", "level", F.col("index").alias("run"), "siblings")
        runs = completed if runs is None else runs.unionByName(completed)
        forests, most = table.where("siblings is null"), most // fan
    return forests, runs


def _needed(forests: DataFrame, trees: int) -> DataFrame:
    """(part, tree, level, run): the runs that each range's leaves pass on their way up and that it did not complete."""

    def above(key: tuple[pa.Scalar, ...], nodes: pa.Table) -> pa.Table:
        seen = set()
        for at in zip(*(nodes.column(c).to_pylist() for c in ("tree", "size", "level", "index")), strict=True):
            for run, _ in path(*at, trees):
                if run in seen:
                    break
                seen.add(run)
        columns = list(zip(*seen, strict=True)) or [()] * 3
        types = [pa.int64(), pa.int32(), pa.int64()]
        return pa.table([pa.array([key[0].as_py()] * len(seen), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["part", "tree", "level", "run"])

    return forests.groupBy("part").applyInArrow(above, "part long, tree long, level int, run long")


def manifest(docs: DataFrame, tampered: Column | None = None, found: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``docs``.

    ``tampered`` (a condition on rows) says whose text is ``found`` (a column) when it is
    verified; the manifest itself is of ``docs`` as they are.
    """
    doc = F.col("doc_id").cast("long")
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(found))
    rows = docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(F.col("text")).alias("leaf"), changed.alias("changed"))
    placed, trees = _placed(rows)
    forests = _forests(placed, trees)
    top, runs = tree_reduce(forests, trees)
    root = next((bytes(r.digest) for r in top.select("digest").take(1)), b"")  # all other nodes have been resolved
    if runs is None:  # one range, which holds all
        needed = forests.where("false").select("part", "tree", "level", F.col("index").alias("run"), "siblings")
    else:
        wanted = _needed(forests, trees)
        needed = wanted.join(runs, ["tree", "level", "run"]).select("part", "tree", "level", "run", "siblings")
    needed = materialise(needed, "needed")

    def prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
        forest = Forest(trees)
        columns = [leaves.column(c).to_pylist() for c in ("doc_id", "tree", "size", "index", "leaf", "changed")]
        for _, tree, size, index, digest, _ in zip(*columns, strict=True):
            forest.add(tree, size, 0, index, digest.encode())
        runs = forest.done
        for t, l, r, siblings in zip(*(above.column(c).to_pylist() for c in ("tree", "level", "run", "siblings")), strict=True):
            runs[t, l, r] = siblings
        ways: dict[Node, list[tuple[bytes, bytes]]] = {}  # of a run of leaves: what stands left and right of the way above it

        def way(at: Node, steps: list[tuple[Node, int]]) -> list[tuple[bytes, bytes]]:
            if at not in ways:
                if len(ways) > 64:
                    ways.clear()
                ways[at] = [(b"".join(runs[run][:k]), b"".join(runs[run][k + 1 :])) for run, k in steps]
            return ways[at]

        out: list[list] = [[] for _ in range(7)]
        for doc_id, tree, size, index, digest, other in zip(*columns, strict=True):
            own = digest.encode()
            steps = list(path(tree, size, 0, index, trees))
            if steps:
                (first, k), above_it = steps[0], steps[1:]
                sides = [(b"".join(runs[first][:k]), b"".join(runs[first][k + 1 :])), *way(first, above_it)]
            else:
                sides = []
            up = sum(run[0] != TOP for run, _ in steps)  # 0: the leaf is the source's root itself

            def fold(d: bytes, sides: list[tuple[bytes, bytes]] = sides) -> list[bytes]:
                digests = [d]
                for left, right in sides:
                    digests.append(h(left, digests[-1], right))
                return digests

            honest = fold(own)
            folded = honest[-1] if other is None or other == digest else fold(other.encode())[-1]
            proof = h(*(x for s in sides for x in s))
            for column, v in zip(out, (doc_id, digest, honest[up].decode(), root.decode(), proof.decode(), folded.decode(), folded == root), strict=True):
                column.append(v)
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return placed.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampering(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, verified against rows of which a fifth have their text's A-Z lower-cased."""
    return manifest(docs, F.pmod(id_crc32(), F.lit(5)) == 0, ascii_lower(F.col("text")))
