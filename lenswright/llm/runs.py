"""Periodic runs of words by the Gusfield-Stoye method for tandem repeats.

A run is a stretch of words with smallest period ``q`` that its neighbours do
not extend; squares (a word string twice in a row) with a primitive half are its
atoms: a run of period ``q`` is a maximal row of consecutive starts of squares of
length ``2 q``.  They are found in the method's three steps:

1. The Lempel-Ziv blocks of the string are compared around their borders, by
   longest common extensions to the right and to the left.  That gives squares
   which cover the leftmost occurrence of every square.
2. Each is marked at its place in the suffix tree, if it starts there leftmost.
3. From every mark a walk over suffix links turns the square by a word as long
   as the turned one is in the tree and unmarked.  Then the whole vocabulary of
   squares is marked, and the leaves below a mark are its occurrences.

A batch of documents is one string with a separator of its own after each.
Before that, stretches that no reported run can touch are left out: in a run of
at least ``max(min_length, min_exponent * q)`` words, every word lies in a gram of
``_gram`` words that stands again ``q`` words on, so only words of such grams
stay (an equal hash keeps a stretch too many, never one too few).

Common extensions compare names of stretches of ``2^k`` words, which the prefix
doubling that sorts the suffixes gives anyway.

Defined cases: a null or empty text has no words and no runs; rows are worked
on one by one, so repeated rows and ids, null ids and ties need no rule; other
columns are ignored; an empty table gives an empty one.  Memory is linear in a batch's
repetitive words, or in the longest text's, times the binary logarithm of its longest repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, tidy

#: What a run must have: so many words, and its period so many times.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Repetitive words that are worked on together (a longer text alone).
TOGETHER = 1 << 16

Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def _gram(min_length: int, min_exponent: int) -> int:
    """The longest gram of which every run has a copy a period on."""
    return max(1, min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1)))


def _repetitive(words: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in a gram that occurs twice in ``words``."""
    n = len(words) - gram + 1
    keep = np.zeros(len(words), bool)
    if n < 2:
        return keep
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ (words[k : n + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    at = np.concatenate([order[1:][same], order[:-1][same]])
    if not len(at):
        return keep
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.zeros(n, bool)
    starts[at] = True
    starts = np.flatnonzero(starts)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + gram, -1)
    return np.cumsum(edges[:-1]) > 0


def _names(s: np.ndarray) -> list[np.ndarray]:
    """By ``k``, the rank of the ``2^k`` words from each place on among all such; the last one ranks the suffixes."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    out, n, width = [rank], len(s), 1
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        rank, width = new, 2 * width
        out.append(rank)
    return out


class _Extensions:
    """Longest common extensions of places of a string, many at a time."""

    def __init__(self, names: list[np.ndarray]) -> None:
        self.names, self.n = names, len(names[0])

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and from ``b`` (different places) on."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            ok = np.flatnonzero(np.maximum(a, b) < self.n)
            same = ok[self.names[k][a[ok]] == self.names[k][b[ok]]]
            for x in (a, b, out):
                x[same] += 1 << k
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words that end at ``a`` and at ``b``, both included."""
        a, b, out = a + 1, b + 1, np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            ok = np.flatnonzero(np.minimum(a, b) >= 1 << k)
            same = ok[self.names[k][a[ok] - (1 << k)] == self.names[k][b[ok] - (1 << k)]]
            a[same] -= 1 << k
            b[same] -= 1 << k
            out[same] += 1 << k
        return out


def _smaller_before(values: list[int]) -> list[int]:
    """For each place, the nearest earlier place of a smaller value, or -1."""
    out, stack = [], []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(k)
    return out


def _blocks(order: np.ndarray, extensions: _Extensions) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the string's end: each block is the longest string that began before, or a new word."""
    n = len(order)
    by_rank = order.tolist()
    before = np.array(_smaller_before(by_rank))
    after = n - 1 - np.array(_smaller_before(by_rank[::-1]))[::-1]
    longest = np.zeros(n, np.int64)
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (near < n))
        here = order[has]
        longest[here] = np.maximum(longest[here], extensions.right(here, order[near[has]]))
    steps, at, out = np.maximum(longest, 1).tolist(), 0, []
    while at < n:
        out.append(at)
        at += steps[at]
    return np.array([*out, n])


def _covering(blocks: np.ndarray, extensions: _Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares that cover the leftmost occurrences of all squares."""
    n = extensions.n
    size = np.diff(blocks)
    starts, halves = [], []

    def within(borders: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each border with the periods 1 to its ``most``."""
        h = np.repeat(borders, most)
        return h, np.arange(len(h)) - np.repeat(np.cumsum(most) - most, most) + 1

    # squares that begin in a block and pass its end
    h, k = within(blocks[1:-1], size[:-1])
    q = h - k
    right, left = extensions.right(h, q), extensions.left(h - 1, q - 1)
    start = np.maximum(q - left, q - k + 1)
    ok = (right + left >= k) & (right > 0)
    starts.append(start[ok])
    halves.append(k[ok])
    # squares that begin before a block and have their middle in it
    most = size + np.r_[size[1:], 0]
    h, k = within(blocks[:-1], most)
    q = h + k
    ok = (q < n) & (h > 0)
    h, k, q = h[ok], k[ok], q[ok]
    right, left = extensions.right(h, q), extensions.left(h - 1, q - 1)
    start = np.maximum(h - left, h - k + 1)
    ok = (right + left >= k) & (right > 0)
    starts.append(start[ok])
    halves.append(k[ok])
    start, half = np.concatenate(starts), np.concatenate(halves)
    return _primitive(start, half, extensions)


def _primitive(start: np.ndarray, half: np.ndarray, extensions: _Extensions) -> tuple[np.ndarray, np.ndarray]:
    """The squares whose half is no power of something shorter."""
    keep = np.ones(len(start), bool)
    rest, p = half.copy(), 2
    while (rest > 1).any():
        if p * p > rest.max():  # what is left of each is a prime
            prime = np.where(rest > 1, rest, 1)
            rest = np.ones_like(rest)
        else:
            divides = rest % p == 0
            if not divides.any():
                p += 1
                continue
            prime = np.where(divides, p, 1)
            while (divides := (rest % p == 0) & (rest > 1)).any():
                rest[divides] //= p
            p += 1
        at = np.flatnonzero((prime > 1) & keep)
        short = half[at] // prime[at]
        keep[at] = extensions.right(start[at], start[at] + short) < 2 * half[at] - short
    return start[keep], half[keep]


class _Tree:
    """The suffix tree over sorted suffixes: node ``v`` has the suffixes of ranks ``low[v]`` to ``high[v]``; leaves are 0 to n - 1, by rank."""

    def __init__(self, s: np.ndarray, order: np.ndarray, rank: np.ndarray, extensions: _Extensions) -> None:
        n = len(s)
        common = np.r_[0, extensions.right(order[:-1], order[1:])]  # of each suffix and the one before it
        low, high, depth = list(range(n)), list(range(n)), (n - order).tolist()
        parent, owner = [-1] * n, [0] * n  # owner: of each place of ``common``, the node of that depth around it
        lcp = common.tolist()
        root = n
        low.append(0), high.append(n - 1), depth.append(0), parent.append(-1)
        stack, last = [root], 0  # internal nodes that are open; ``last``: the node that was closed most recently
        for r in range(1, n):
            d = lcp[r]
            last = r - 1
            left = r - 1
            while depth[stack[-1]] > d:
                v = stack.pop()
                parent[last] = v
                high[v] = r - 1
                left, last = low[v], v
            if depth[stack[-1]] == d:
                parent[last] = stack[-1]
            else:
                v = len(low)
                low.append(left), high.append(r - 1), depth.append(d), parent.append(-1)
                parent[last] = v
                stack.append(v)
            owner[r] = stack[-1]
        last = n - 1
        while stack:
            v = stack.pop()
            parent[last] = v
            high[v] = n - 1
            last = v
        self.root, self.n = root, n
        self.low, self.high, self.depth, self.parent = low, high, depth, parent
        self.order, self.s = order.tolist(), s.tolist()
        nodes = np.arange(n + 1, len(low))
        self.links = {root: root}
        if len(nodes):
            a, b = (rank[order[np.array(x)[nodes]] + 1] for x in (low, high))
            self.links |= zip(nodes.tolist(), np.array(owner)[_least(common, np.minimum(a, b) + 1, np.maximum(a, b))].tolist(), strict=True)
        # a child is known by the word that its edge begins with
        up = np.array(parent)
        kids = np.flatnonzero(up >= 0)
        first = s[order[np.array(low)[kids]] + np.array(depth)[up[kids]]]
        self.child = dict(zip(zip(up[kids].tolist(), first.tolist(), strict=True), kids.tolist(), strict=True))
        # the leftmost suffix below each node
        self.leftmost = np.minimum.reduceat(np.r_[order, n], np.stack([low, np.array(high) + 1], 1).ravel())[::2].tolist()

    def turned(self, v: int, at: int, length: int) -> int | None:
        """Below the place of the string of ``length`` words from ``at`` on, which ends on the edge to ``v``: the node of the string turned by a word, if that occurs."""
        depth, order, low, child, s = self.depth, self.order, self.low, self.child, self.s
        u = self.links[self.parent[v]]
        while depth[u] < length - 1:
            u = child[u, s[at + 1 + depth[u]]]
        if depth[u] == length - 1:
            return child.get((u, s[at]))
        return u if s[order[low[u]] + length - 1] == s[at] else None


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of a least value in each range ``a`` to ``b``, both included."""
    n = len(values)
    best = [values * n + np.arange(n)]
    while 2 ** len(best) <= n:
        half = 1 << (len(best) - 1)
        best.append(np.minimum(best[-1][:-half], best[-1][half:]))
    level = np.frexp((b - a + 1).astype(float))[1] - 1
    out = np.zeros(len(a), np.int64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(best[k][a[at]], best[k][b[at] + 1 - (1 << k)])
    return out % n


def _vocabulary(tree: _Tree, rank: np.ndarray, start: np.ndarray, half: np.ndarray) -> list[tuple[int, int]]:
    """(node, length) of all squares, from those that cover them."""
    depth, parent, leftmost, order, low = tree.depth, tree.parent, tree.leftmost, tree.order, tree.low
    by_start: dict[int, list[int]] = {}
    for at, k in sorted(set(zip(start.tolist(), (2 * half).tolist(), strict=True)), key=lambda x: (x[0], -x[1])):
        by_start.setdefault(at, []).append(k)
    marks = set()
    for at, lengths in by_start.items():
        v = int(rank[at])  # up from the leaf, as long as this suffix is the leftmost below
        for length in lengths:
            while depth[parent[v]] >= length and leftmost[parent[v]] == at:
                v = parent[v]
            if depth[parent[v]] >= length:
                break  # this square and all shorter ones stand further left
            marks.add((v, length))
    for v, length in list(marks):
        while (v := tree.turned(v, order[low[v]], length)) is not None and (v, length) not in marks:
            marks.add((v, length))
    return list(marks)


def runs_of(s: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) of the runs of a string whose last word occurs once, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if len(s) < 3:
        return none
    names = _names(s)
    rank = names[-1]
    order = np.argsort(rank)
    extensions = _Extensions(names)
    start, half = _covering(_blocks(order, extensions), extensions)
    if not len(start):
        return none
    tree = _Tree(s, order, rank, extensions)
    marks = np.array(_vocabulary(tree, rank, start, half))
    low, high = np.array(tree.low)[marks[:, 0]], np.array(tree.high)[marks[:, 0]]
    many = high - low + 1
    at = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    period = np.repeat(marks[:, 1] // 2, many)
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    first = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[first[1:] - 1, len(at) - 1]
    found = np.stack([at[first], at[last] - at[first] + 2 * period[first], period[first]], 1)
    found = found[found[:, 1] >= np.maximum(min_length, min_exponent * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of_documents(documents: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """The runs of each of several word strings (of numbers from 0), found in strings of their repetitive stretches."""
    gram = _gram(min_length, min_exponent)
    out = [np.zeros((0, 3), np.int64) for _ in documents]
    pieces: list[tuple[int, int, np.ndarray]] = []  # document, first word's number, words
    held = 0

    def flush() -> None:
        nonlocal held
        if not pieces:
            return
        top = 1 + max(int(w.max()) for _, _, w in pieces)
        s = np.concatenate([x for k, (_, _, w) in enumerate(pieces) for x in (w, [top + k])])
        begins = np.cumsum([0, *(len(w) + 1 for _, _, w in pieces)])
        found = runs_of(s, min_length, min_exponent)
        where = np.searchsorted(begins, found[:, 0], "right") - 1
        owner, first = np.array([d for d, _, _ in pieces]), np.array([f for _, f, _ in pieces])
        found[:, 0] += first[where] - begins[where]
        for d in np.unique(owner[where]).tolist():
            out[d] = np.concatenate([out[d], found[owner[where] == d]])
        pieces.clear()
        held = 0

    for d, words in enumerate(documents):
        keep = _repetitive(words, gram)
        if not keep.any():
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
        if held and held + int(keep.sum()) > TOGETHER:
            flush()
        for a, b in edges.reshape(-1, 2).tolist():
            pieces.append((d, a, words[a:b]))
        held += int(keep.sum())
    flush()
    return [r[np.lexsort((r[:, 2], r[:, 0]))] for r in out]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``words``, made periodic from some word on in a tenth of the documents, by the crc32 of the id as text (null: of the empty text)."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, prepare: Prepare | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed text of each row of ``docs``.

    Words are what white space parts.  In the collapsed text a run keeps its
    first period.  ``prepare`` may change a document's words beforehand.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [t.split() for t in b.column(1).to_pylist()]
            if prepare:
                texts = [prepare(i, t) for i, t in zip(ids, texts, strict=True)]
            numbers: dict[bytes, int] = {}
            strings = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t)) for t in texts]
            runs = runs_of_documents(strings, min_length, min_exponent)
            collapsed = []
            for words, found in zip(texts, runs, strict=True):
                if len(found):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, found[:, 0] + found[:, 2], 1)
                    np.add.at(gone, found[:, 0] + found[:, 1], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                collapsed.append(b" ".join(words))
            every = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            offsets = pa.array(np.cumsum([0, *(len(r) for r in runs)]).astype(np.int32))
            structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(tidy(work, "runs"), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(docs: DataFrame, prepare: Prepare | None = planted) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and hashes of all runs and of the collapsed text."""
    found = find_runs(docs, prepare=prepare)
    greater = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)  # noqa: E731 - of equal ones the earlier
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), greater))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
