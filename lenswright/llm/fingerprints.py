"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every 5-word shingle is hashed once.  The hash's top bits name a bin, and each
bin keeps its least hash; an empty bin borrows from the first filled bin of its
own fixed random order of bins (optimal densification).  The fingerprint packs
the low-order byte of each of the 128 bins in hex, and likeness corrects the
share of equal bytes for chance agreement.

Defined cases: a null text is empty; a text of fewer than five words is one
shingle; a text without words has the empty fingerprint, which is like itself
(1) and unlike any other (0); the edited text's neighbour is the next row by
descending doc_id (null ids last, equal ids by a hash of their text), after the
last the first; repeated rows count as one in that order and each get its
result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, materialise
from .decontaminate import let

SHINGLE, BINS, BIN_BITS, LOW_BITS = 5, 128, 7, 8


def _orders() -> Column:
    """For bin b and filled bin f, at b * BINS + f: the rank of f in b's order, times BINS, plus f.

    An order is a permutation, the bins in the sequence in which repeated
    hashing of b would first meet them.
    """
    rng, out = random.Random(5), [0] * (BINS * BINS)
    for b in range(BINS):
        for rank, f in enumerate(rng.sample(range(BINS), BINS)):
            out[b * BINS + f] = rank * BINS + f
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<int>")


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def shingle_hashes(text: Column) -> Column:
    """Sorted hashes of a text's shingles, repeated ones included."""
    split = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
        few = F.when(F.size(h) > 0, F.array(F.xxhash64(F.lit(0), h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= SHINGLE, F.sort_array(many)).otherwise(few)

    return let(F.transform(split, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text as a hex string."""

    def least(hs: Column) -> Column:
        return F.filter(hs, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(hs, i - 1))))

    def spread(mins: Column) -> Column:
        orders = _orders()
        by_bin = F.map_from_arrays(F.transform(mins, _bin), mins)

        def value(m: Column, b: Column) -> Column:
            nearest = F.array_min(F.transform(mins, lambda x: F.get(orders, b * BINS + _bin(x)))).bitwiseAND(F.lit(BINS - 1))
            return F.coalesce(F.try_element_at(m, b), F.try_element_at(m, nearest))

        low = let(by_bin, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.lpad(F.hex(value(m, b).bitwiseAND(F.lit((1 << LOW_BITS) - 1))), 2, "0")))
        return F.when(F.size(mins) > 0, F.lower(F.array_join(low, ""))).otherwise(F.lit(""))

    return let(let(shingle_hashes(text), least), spread)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints' shingle sets, 0 to 1."""
    width, chance = LOW_BITS // 4, 2.0**-LOW_BITS
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + (F.substring(a, i * width + 1, F.lit(width)) == F.substring(b, i * width + 1, F.lit(width))).cast("int"))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def named(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) with two hashes that name the row."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(1), "doc_id").alias("k2"), text.alias("text"))


def neighbours(keys: DataFrame) -> DataFrame:
    """(k1, k2, n1, n2): for each distinct key the next by descending doc_id, after the last the first.

    Keys are dealt out by ranges of doc_id; the order is looked up within a
    range, and across its end from a table of one row a range.
    """
    spark = keys.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), "k1", "k2"]
    parts = materialise(keys.select("doc_id", "k1", "k2").distinct().repartitionByRange(ranges, F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id()), "id-ranges")
    w = Window.partitionBy("part").orderBy(*order)
    rows = parts.select("part", "k1", "k2", F.row_number().over(w).alias("row"), F.lead(F.struct("k1", "k2")).over(w).alias("next"))
    heads = rows.where("row = 1").select("part", F.struct("k1", "k2").alias("head"))
    by_part = Window.orderBy("part")  # one short row a range
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(whole)).alias("after"))
    return rows.join(F.broadcast(heads), "part").select("k1", "k2", F.coalesce("next", "after").alias("n")).select("k1", "k2", F.col("n.k1").alias("n1"), F.col("n.k2").alias("n2"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text: one pass, no shuffle."""
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"))


def edited_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they come out.

    Texts are shuffled twice: once by their own name, which serves both sides,
    and the needed beginnings of neighbours once more.
    """
    texts = named(docs)
    prints = materialise(texts.select("doc_id", "k1", "k2", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint")), "fingerprints")
    after = materialise(neighbours(prints), "neighbours")
    if prints.groupBy("k1", "k2").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["k1", "k2"])
    one = prints.select("k1", "k2", "n_chars", "fingerprint").dropDuplicates(["k1", "k2"])
    need = F.floor(F.col("n_chars") / 3).cast("int")
    wanted = after.join(one.select("k1", "k2", need.alias("need")), ["k1", "k2"])
    body = texts.select("k1", "k2", "text")
    begun = body.withColumnsRenamed({"k1": "n1", "k2": "n2"}).join(wanted, ["n1", "n2"]).select("k1", "k2", "need", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("begin"))
    edited = body.join(begun, ["k1", "k2"]).select("k1", "k2", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("need")), "begin").alias("edited"))
    edited = edited.select("k1", "k2", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    next_print = after.join(one.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("fingerprint").alias("next_fingerprint")), ["n1", "n2"]).select("k1", "k2", "next_fingerprint")
    out = prints.join(edited, ["k1", "k2"]).join(next_print, ["k1", "k2"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
