"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised word windows become a table and a byte map of their
hashes, a literal of bounded size.  Every word window of every document is
hashed in the JVM and looked up there; the few that may be hits are verified
against the windows' words by an equi-join, so hash collisions never count.

Defined cases: a null text has no words; an item of fewer words than a window
is one window, an item without words none; a null item_id counts as no item
but its windows hit; repeated rows get equal results; an empty benchmark
contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, materialise

#: Words of a window.
WINDOW = 10
#: The byte map has so many bytes a window, up to MAP_BYTES; a fuller map only verifies more.
SPARSE, MAP_BYTES = 64, 1 << 23
#: So many windows at most are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: So many names of contaminated rows at most are broadcast.
BROADCAST_ROWS = 200_000

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words: runs of a-z, 0-9 and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _hashed(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(n)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(n, words, items, h): every distinct window, the ids of the items that have it, its words' hashes."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = w.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("x"))
    return each.groupBy("n", F.array_join("x", " ").alias("words")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"), F.first(F.transform("x", lambda v: F.xxhash64(v))).alias("h"))


def _byte_map(windows: DataFrame, lengths: list[int], count: int) -> bytes:
    """A byte for each slot of the hash space: 1 where some window falls."""
    size = 1 << 16
    while size < min(SPARSE * count, MAP_BYTES):
        size *= 2
    marks = bytearray(size)
    for n in lengths:
        slots = windows.where(F.col("n") == n).select(F.pmod(_hashed(F.col("h"), F.lit(0), n), F.lit(size)).cast("int").alias("slot")).distinct()
        for row in slots.toLocalIterator():
            marks[row.slot] = 1
    return bytes(marks)


def scan(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: its name (two hashes of id and text), doc_id, n_words, and the windows that may be hits."""
    sizes = {r.n: r["count"] for r in windows.groupBy("n").count().collect()}  # at most ``window`` rows
    lengths, count = sorted(sizes), sum(sizes.values())
    marks = _byte_map(windows, lengths, count)
    one, size = F.lit(b"\x01"), len(marks)

    def spots(w: Column, table: Column) -> Column:
        def some(h: Column, n: int) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.substring(table, F.pmod(_hashed(h, i, n), F.lit(size)).cast("int") + 1, F.lit(1)) == one)
            found = F.transform(at, lambda i: F.struct(i.cast("int").alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("words")))
            return F.when(F.size(h) >= n, found).otherwise(F.array().cast("array<struct<at:int,n:int,words:string>>"))

        if not lengths:
            return F.array().cast("array<struct<at:int,n:int,words:string>>")
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*(some(h, n) for n in lengths)))

    # bound by ``let``, the map is in the plan once, and not in its text: as a plain literal each mention prints it whole
    whole = let(F.lit(marks), lambda table: let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), spots(w, table).alias("spots"))))
    named = docs.select(*_name(docs), "doc_id", whole.alias("x"))
    return named.select("k1", "k2", "doc_id", "x.n_words", "x.spots")


def _name(docs: DataFrame) -> tuple[Column, Column]:
    return F.xxhash64(docs["doc_id"], docs["text"]).alias("k1"), F.xxhash64(docs["text"], F.lit(1), docs["doc_id"]).alias("k2")


def hits(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """(k1, k2, n_hit, items) of the rows with verified hits; n_hit counts each covered word once."""
    known = windows.select("n", "words", "items")
    if windows.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    found = scanned.select("k1", "k2", F.explode("spots").alias("s")).select("k1", "k2", "s.*").join(known, ["n", "words"])
    grouped = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "at", start,
        lambda a, x: F.struct(F.greatest(a["end"], x["at"] + x["n"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["end"], x["at"]))).alias("n")),
        lambda a: a["n"],
    )
    return grouped.select("k1", "k2", covered.alias("n_hit"), F.array_sort("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as texts) and contaminated of every row of ``docs``."""
    windows = materialise(benchmark_windows(benchmark, window), "windows")
    scanned = materialise(scan(docs, windows, window), "window-scan")
    joined = scanned.select("k1", "k2", "doc_id", "n_words").join(hits(scanned, windows), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    found = contamination(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    windows = materialise(benchmark_windows(benchmark, window), "windows")
    scanned = materialise(scan(docs, windows, window), "window-scan")  # a filter here would go below the scan and do its work twice
    bad1, bad2 = free_names(docs, "bad1", "bad2")
    bad = materialise(hits(scanned, windows).select(F.col("k1").alias(bad1), F.col("k2").alias(bad2)), "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    k1, k2 = F.xxhash64(docs["doc_id"], docs["text"]), F.xxhash64(docs["text"], F.lit(1), docs["doc_id"])
    return docs.join(bad, (k1 == bad[bad1]) & (k2 == bad[bad2]), "left_anti")
