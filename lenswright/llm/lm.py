"""Language-model scoring with an Elias-Fano n-gram trie.

The first level holds every training word (a 64-bit hash) in sorted order,
Elias-Fano coded, with its exact count, which base scores need.  The second
holds every word's successors, one sequence a shard: each context's successors
are written as differences from where the last context's end, so the whole is
monotone and Elias-Fano coded with a universe no larger than the sum of the
contexts' spans; a second coded sequence points from each context to where its
successors begin.  A query takes a context's range from the pointers and what
the range counts from out of the sequence, and searches the successor relative
to it, for whole batches at once, on memory-mapped files.  Discounted
probabilities are quantised to a byte, in steps that follow from the most
frequent word.

The model interpolates: P(w | c) = max(n(c, w) - D, 0) / n(c) + D * u(c) / n(c)
* P(w), with u(c) the number of c's distinct successors and P(w) the additive
base model; after an unseen word it is P(w).  An end token closes each text and
is the context of the next text's first word.

Shards hold about ``SHARD_TOKENS`` tokens of contexts each; a more frequent
word is cut into several by ranges of its successors.

Defined cases: a null text is empty and has the end token only; a null doc_id
counts as the empty text for the choice of training rows; repeated rows are
learnt from and scored each; without training rows every token has probability 1
in both models.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, id_crc32, kept, mapped, materialise, small_batches, text_bytes, tidy, work_path

#: What the additive base model adds to each count.
ADD = 0.1
#: The absolute discount of bigram counts.
DISCOUNT = 0.75
#: Tokens of contexts in a shard of pairs, words in a shard of words, tokens gathered before a task sends its counts on.
SHARD_TOKENS, SHARD_WORDS, GATHER = 4_000_000, 1_000_000, 2_000_000
#: Words whose hashes a worker remembers, and the longest of them.
WORDS, LONGEST = 300_000, 64

_ONE = np.uint64(1)


# -- Elias-Fano ------------------------------------------------------------


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The position of the ``rank``-th one (from 0) in each 64-bit word, by halving."""
    at, rank = np.zeros(len(word), np.uint64), rank.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((word >> at) & np.uint64((1 << step) - 1)).astype(np.uint64)
        right = rank >= low
        rank = np.where(right, rank - low, rank)
        at = np.where(right, at + np.uint64(step), at)
    return at.astype(np.int64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with the ones before every 512-bit block for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = before.astype(np.int64)
        self.zeros = np.arange(len(before), dtype=np.int64) * 512 - self.ones
        self.stored = before

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Code sorted ``values`` below ``universe``."""
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        spots = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = n + (universe >> bits) + 2
        raw = np.zeros(-(-size // 512) * 512, np.uint8)
        raw[spots] = 1
        high = np.packbits(raw, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64).reshape(-1, 8).sum(1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            part = values & np.uint64((1 << bits) - 1)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] |= np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((at & 63) + bits > 64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])  # one number at most reaches into a word
        return cls(n, bits, low, high, (np.cumsum(ones) - ones).astype("<u4"))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit positions of the ``k``-th ones or zeros: the block by binary search, then one of its eight words."""
        before = self.ones if one else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        left = k - before[block]
        words = self.high.reshape(-1, 8)[block]
        words = words if one else ~words
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        w = (upto <= left[:, None]).sum(1)
        rows = np.arange(len(k))
        left = left - np.where(w > 0, upto[rows, np.maximum(w - 1, 0)], 0)
        return (block << 9) + (w << 6) + _select_in_word(words[rows, w], left)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
        return both & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where each value stands, -1 if it doesn't: its high bits' bucket, then a search by its low bits."""
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        end = self._select(top, False) - top
        begin = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - np.maximum(top - 1, 0), 0)
        want, hi = x & np.uint64((1 << self.low_bits) - 1), end.copy()
        while len(act := np.flatnonzero(begin < hi)):
            mid = (begin[act] + hi[act]) >> 1
            less = self._low(mid) < want[act]
            begin[act] = np.where(less, mid + 1, begin[act])
            hi[act] = np.where(less, hi[act], mid)
        ok = begin < end
        ok[ok] = self._low(begin[ok]) == want[ok]
        return np.where(ok, begin, -1)

    def arrays(self) -> list[np.ndarray]:
        return [self.low.astype("<u8"), self.high, self.stored]


# -- files -----------------------------------------------------------------


def _save(folder: str, kind: str, meta: dict, arrays: list[np.ndarray]) -> str:
    """Write a level's shard: a JSON line of 4096 bytes, then arrays at multiples of 64."""
    at, spots = 4096, []
    for a in arrays:
        spots.append([at, len(a), a.dtype.str])
        at = -(-(at + a.nbytes) // 64) * 64
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)
    name = f"{kind}-{uuid.uuid4().hex}.bin"
    with fs.open_output_stream(f"{where}/{name}") as f:
        f.write(json.dumps(meta | {"arrays": spots}).encode().ljust(4096))
        done = 4096
        for (start, _, _), a in zip(spots, arrays, strict=True):
            f.write(b"\0" * (start - done) + a.tobytes())
            done = start + a.nbytes
    return f"{folder}/{name}"


def _load(uri: str) -> tuple[dict, list[np.ndarray]]:
    """Map a shard into memory; in a store without files its bytes are fetched."""
    raw = mapped(uri)
    meta = json.loads(bytes(raw[:4096]))
    return meta, [raw[at : at + n * np.dtype(t).itemsize].view(t) for at, n, t in meta["arrays"]]


# -- words -----------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) >> 1
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


def _hashes() -> _Hashes:
    return kept("lm", "words", _Hashes)


#: No word has a line end in it.
END = xxhash.xxh3_64_intdigest(b"\n") >> 1


def token_hashes(text: bytes) -> np.ndarray:
    """The words of a UTF-8 text (only A-Z lowered, only ASCII white space splits) and the end token, as 63-bit hashes."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.int64)
    out[:-1] = np.fromiter(map(_hashes().__getitem__, words), np.int64, len(words))
    out[-1] = END
    return out


def _gathered(texts: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
    """Token arrays of many texts at a time, about ``GATHER`` tokens."""
    held, n = [], 0
    for t in texts:
        held.append(token_hashes(t))
        n += len(held[-1])
        if n >= GATHER:
            yield held
            held, n = [], 0
    if held:
        yield held


# -- the model -------------------------------------------------------------


class Words:
    """The first level: ids are ranks over all shards; counts by id."""

    def __init__(self, shards: list[tuple[int, str]]):
        self.first = [lo for lo, _ in shards]
        self.base, self.tables = [0], []
        for _, uri in shards:
            meta, a = _load(uri)
            self.tables.append((meta, EliasFano(meta["n"], meta["bits"], *a[:3]), a[3]))
            self.base.append(self.base[-1] + meta["n"])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted hashes; id -1 and count 0 where unknown."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes, self.first[1:]) if self.first else []
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(hashes)], strict=True) if self.first else []):
            if a < b:
                meta, h, n = self.tables[k]
                ok = np.flatnonzero((hashes[a:b] >= meta["first"]) & (hashes[a:b] <= meta["last"]))
                at = h.find((hashes[a:b][ok] - meta["first"]).astype(np.uint64))
                ids[a + ok] = np.where(at >= 0, at + self.base[k], -1)
                counts[a + ok] = np.where(at >= 0, n[np.maximum(at, 0)], 0)
        return ids, counts


class Pairs:
    """The second level: successors by context, over shards that begin at given (context, successor) pairs."""

    def __init__(self, shards: list[tuple[int, int, str]], n_words: int):
        self.shards, self.n_words, self.loaded = shards, n_words, {}
        self.starts = np.array([_pair_key(c, w) for c, w, _ in shards], np.uint64)

    def shard(self, k: int) -> tuple[dict, EliasFano, EliasFano, np.ndarray]:
        if k not in self.loaded:
            meta, a = _load(self.shards[k][2])
            self.loaded[k] = (meta, EliasFano(meta["n"], meta["bits"], *a[:3]), EliasFano(meta["contexts"] + 1, meta["pointer_bits"], *a[3:6]), a[6])
        return self.loaded[k]

    def discounted(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The discounted probabilities of pairs sorted by context, then word; 0 where a pair is unknown."""
        out = np.zeros(len(context))
        keys = _pair_key(context, word)
        cuts = np.searchsorted(keys, self.starts[1:]) if len(self.shards) else []
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True) if len(self.shards) else []):
            if a < b:
                meta, pairs, pointers, levels = self.shard(k)
                local = context[a:b] - meta["first"]
                ok = np.flatnonzero((local >= 0) & (local < meta["contexts"]))
                if not meta["n"] or not len(ok):
                    continue
                own, of = np.unique(local[ok], return_inverse=True)
                begin, end = (pointers.access(own + i).astype(np.int64) for i in (0, 1))
                some = end > begin
                origin, last = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
                after = some & (begin > 0)
                origin[after] = pairs.access(begin[after] - 1) + _ONE
                last[some] = pairs.access(end[some] - 1)
                x = origin[of] + word[a:b][ok].astype(np.uint64)
                within = np.flatnonzero(some[of] & (x <= last[of]))  # past its last successor a context's range ends
                at = pairs.find(x[within])
                out[a + ok[within]] = np.where(at >= 0, 10.0 ** (meta["lowest"] / 255 * levels[np.maximum(at, 0)]), 0.0)
        return out

    def successors(self, context: np.ndarray) -> np.ndarray:
        """How many distinct successors sorted contexts have, over all shards that hold some."""
        out = np.zeros(len(context), np.int64)
        if not len(self.shards):
            return out
        last = np.searchsorted(self.starts, _pair_key(context, np.full(len(context), 0xFFFFFFFF)), side="right") - 1
        first = np.maximum(0, np.searchsorted(self.starts, _pair_key(context, np.zeros(len(context), np.int64)), side="right") - 1)
        for k in range(int(first.min(initial=0)), int(last.max(initial=-1)) + 1):
            at = np.flatnonzero((first <= k) & (k <= last))
            if len(at):
                meta, _, pointers, _ = self.shard(k)
                local = context[at] - meta["first"]
                ok = (local >= 0) & (local < meta["contexts"])
                local = local[ok]
                if len(local):
                    out[at[ok]] += (pointers.access(local + 1) - pointers.access(local)).astype(np.int64)
        return out


def _pair_key(context: np.ndarray | int, word: np.ndarray | int) -> np.ndarray:
    return np.asarray(context, np.int64).astype(np.uint64) << np.uint64(32) | np.asarray(word, np.int64).astype(np.uint64)


class Trie:
    """A trained model, opened from its folder."""

    def __init__(self, manifest: str):
        fs, where = filesystem(manifest)
        with fs.open_input_file(where) as f:
            meta = json.loads(f.read())
        self.tokens, self.n_words, self.discount = meta["tokens"], meta["words"], meta["discount"]
        self.words = Words([tuple(s) for s in meta["word_shards"]])
        self.pairs = Pairs([tuple(s) for s in meta.get("pair_shards", [])], self.n_words)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.tokens + ADD * (self.n_words + 1))

    def score(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text's token hashes."""
        flat = np.concatenate(docs)
        begins = np.cumsum([0, *(len(x) for x in docs[:-1])])
        unique, at = np.unique(flat, return_inverse=True)
        ids, counts = self.words.find(unique)
        p = self.base(counts)
        id_, base, known = ids[at], p[at], counts[at] > 0
        end = int(np.searchsorted(unique, END))
        before = np.empty(len(flat), np.int64)
        before[1:] = at[:-1]
        before[begins] = end
        context = ids[before]
        prob = base.copy()
        seen = np.flatnonzero(context >= 0)
        if len(seen):
            contexts, where = np.unique(context[seen], return_inverse=True)
            # a context's count is its own word's
            of = np.zeros(len(contexts), np.int64)
            of[where] = counts[before[seen]]
            share = self.discount * self.pairs.successors(contexts) / np.maximum(of, 1)
            prob[seen] = share[where] * base[seen]
            both = np.flatnonzero(id_[seen] >= 0)
            keys, back = np.unique(_pair_key(context[seen][both], id_[seen][both]), return_inverse=True)
            found = self.pairs.discounted((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            prob[seen[both]] += found[back]
        sums = [np.add.reduceat(x, begins) for x in (known.astype(np.int64), np.log10(base), np.log10(np.minimum(prob, 1.0)))]
        yield from zip((len(x) for x in docs), *(s.tolist() for s in sums), strict=True)


def opened(manifest: str) -> Trie:
    """A worker's model; its levels stay mapped until another operator works there."""
    return kept("lm", manifest, lambda: Trie(manifest))


# -- training --------------------------------------------------------------


def _save_manifest(folder: str, meta: dict) -> str:
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)
    name = f"model-{uuid.uuid4().hex}.json"
    with fs.open_output_stream(f"{where}/{name}") as f:
        f.write(json.dumps(meta).encode())
    return f"{folder}/{name}"


def _word_level(rows: DataFrame, folder: str) -> tuple[list, list]:
    """Count all words and write the first level; returns its shards and where the second's shall begin."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(t for b in batches for t in b.column(0).to_pylist()):
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    words = materialise(rows.mapInArrow(tidy(count, "lm"), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    shards = max(1, -(-words.count() // SHARD_WORDS), spark.sparkContext.defaultParallelism)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        coded = EliasFano.build((h - h[0]).astype(np.uint64), int(h[-1]) - int(h[0]) + 1)
        uri = _save(folder, "words", {"n": len(h), "first": int(h[0]), "last": int(h[-1]), "bits": coded.low_bits}, [*coded.arrays(), n.astype("<u8" if n.max() >> 32 else "<u4")])
        # the pairs' shards: whole words of about SHARD_TOKENS tokens, and pieces of more frequent words
        starts = [(0, 0, 1)]
        for k in _cuts(n):
            pieces = max(1, -(-int(n[k]) // SHARD_TOKENS))
            starts += [(k, p, pieces) for p in range(pieces)]
            if pieces > 1 and k + 1 < len(n):
                starts.append((k + 1, 0, 1))
        starts = sorted(set(starts))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([int(h[0])], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([uri]), pa.array([json.dumps(starts)])], names=["part", "h", "words", "tokens", "uri", "starts"])

    parts = words.repartitionByRange(shards, "h").sortWithinPartitions("h").mapInArrow(tidy(write, "lm"), "part int, h long, words long, tokens long, uri string, starts string")
    found = sorted(materialise(parts, "word-shards").collect())  # a row a shard
    total, base, begins = sum(r.words for r in found), 0, []
    for r in found:
        begins += [(base + k, total * p // pieces) for k, p, pieces in json.loads(r.starts)]
        base += r.words
    return found, begins


def _cuts(n: np.ndarray) -> list[int]:
    """Positions where a new shard of pairs begins: a word past the budget of the last, and any word beyond the budget alone."""
    whole = np.cumsum(n)
    out, at = [int(k) for k in np.flatnonzero(n > SHARD_TOKENS)], 0
    while True:
        k = int(np.searchsorted(whole, (whole[at - 1] if at else 0) + SHARD_TOKENS, side="right"))
        if k >= len(n):
            return sorted(set(out))
        at = max(k, at + 1)
        if at < len(n):
            out.append(at)


def _pair_level(rows: DataFrame, manifest: str, begins: list[tuple[int, int]], folder: str, discount: float) -> list:
    """Count all pairs and write the second level; returns its shards."""
    starts = np.array([c << 32 | w for c, w in begins], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, z = opened(manifest), zstandard.ZstdCompressor(1)
        for held in _gathered(t for b in batches for t in b.column(0).to_pylist()):
            unique, at = np.unique(np.concatenate(held), return_inverse=True)
            ids, _ = trie.words.find(unique)
            id_ = ids[at]
            context = np.empty_like(id_)
            context[1:] = id_[:-1]
            context[np.cumsum([0, *(len(x) for x in held[:-1])])] = ids[np.searchsorted(unique, END)]
            keys, n = np.unique(_pair_key(context, id_), return_counts=True)
            cuts = [*np.searchsorted(keys, starts), len(keys)]
            out = [(k, z.compress(_coded(keys[a:b], n[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "pairs"])

    def merge(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k, z = int(group[0]), zstandard.ZstdDecompressor()
        keys, n = (np.concatenate(x) for x in zip(*(_decoded(z.decompress(b)) for b in part["pairs"]), strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[first], np.add.reduceat(n, first)
        trie = opened(manifest)
        context, word = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        low, high = int(context[0]), int(context[-1])
        counts = _counts_by_id(trie.words, low, high)
        local = context - low
        with np.errstate(divide="ignore"):
            p = np.log10(np.maximum(n - discount, 0) / counts[local])
        lowest = float(min(-1.0, p[np.isfinite(p)].min(initial=0.0)))
        levels = np.where(np.isfinite(p), np.clip(np.rint(p * 255 / lowest), 0, 255), 255).astype(np.uint8)
        ends = np.flatnonzero(np.r_[local[1:] != local[:-1], True])  # a context's last successor, from which the next one's are counted
        origin = np.zeros(len(local), np.uint64)
        origin[ends[:-1] + 1] = word[ends[:-1]] + _ONE
        values = np.cumsum(origin, dtype=np.uint64) + word
        pairs = EliasFano.build(values, int(values[-1]) + 1)
        pointers = EliasFano.build(np.searchsorted(local, np.arange(high - low + 2)).astype(np.uint64), len(keys) + 1)
        meta = {"first": low, "contexts": high - low + 1, "n": len(keys), "bits": pairs.low_bits, "pointer_bits": pointers.low_bits, "lowest": lowest}
        uri = _save(folder, "pairs", meta, [*pairs.arrays(), *pointers.arrays(), levels])
        return pd.DataFrame({"shard": [k], "uri": [uri]})

    found = rows.mapInArrow(tidy(count, "lm"), "shard int, pairs binary").groupBy("shard").applyInPandas(merge, "shard int, uri string")
    return [(begins[r.shard][0], begins[r.shard][1], r.uri) for r in sorted(materialise(found, "pair-shards").collect())]


def _counts_by_id(words: Words, low: int, high: int) -> np.ndarray:
    """The counts of the ids from ``low`` to ``high``."""
    parts = [n[max(0, low - b) : max(0, high + 1 - b)] for b, (_, _, n) in zip(words.base, words.tables, strict=False) if b <= high and b + len(n) > low]
    return np.concatenate(parts).astype(np.float64)


def _coded(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs with counts: contexts by differences, successors as they are, small counts in a byte."""
    context = (keys >> np.uint64(32)).astype(np.uint32)
    small = np.minimum(n, 255).astype(np.uint8)
    large = n[n >= 255].astype("<u8")
    return np.array([len(keys), len(large)], "<u8").tobytes() + np.diff(context, prepend=np.uint32(0)).astype("<u4").tobytes() + (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + small.tobytes() + large.tobytes()


def _decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, many = np.frombuffer(raw, "<u8", 2).astype(int)
    context = np.cumsum(np.frombuffer(raw, "<u4", k, 16), dtype=np.uint64)
    n = np.frombuffer(raw, np.uint8, k, 16 + 8 * k).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<u8", many, 16 + 9 * k).astype(np.int64)
    return context << np.uint64(32) | np.frombuffer(raw, "<u4", k, 16 + 4 * k).astype(np.uint64), n


def train(docs: DataFrame, folder: str | None = None, discount: float = DISCOUNT) -> str:
    """Learn from all of ``docs`` (text); returns the model's manifest file."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or work_path(spark, "trie")
    rows = docs.select(text_bytes().alias("body"))
    found, begins = _word_level(rows, folder)
    meta = {"tokens": sum(r.tokens for r in found), "words": sum(r.words for r in found), "discount": discount, "word_shards": [(r.h, r.uri) for r in found]}
    if meta["words"] >> 32:
        raise ValueError("ids of words must fit 32 bits")
    if not found:
        return _save_manifest(folder, meta)
    return _save_manifest(folder, meta | {"pair_shards": _pair_level(rows, _save_manifest(folder, meta), begins, folder, discount)})


def score(docs: DataFrame, manifest: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text: one pass, no shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc32() % 10 == 0).alias("held_out"), text_bytes().alias("body"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(manifest)
        for b in batches:
            at = 0
            for held in _gathered(iter(b.column(2).to_pylist())):
                n, known, base, own = zip(*trie.score(held), strict=True)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(held)) for k in (0, 1)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([trie.tokens] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at += len(held)

    return rows.mapInArrow(tidy(scored, "lm"), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learn_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 10 is not 0, and score all rows."""
    return score(docs, train(docs.where(id_crc32() % 10 != 0)))
