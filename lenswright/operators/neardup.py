"""Perceptual and similarity hashes as BIGINTs, Hamming joins, duplicate groups."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import hamming
from ..plans.workspace import by_merge, materialise, numbered
from .audit import PAIRS
from .components import grouped

BITS = 64


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 60) -> DataFrame:
    """(key, hash): the sign of each bit's balance over a text's distinct words, as a positive BIGINT.

    Words are hashed once; all bits are counted in one aggregation, two counters
    to a sum.  A counter has 30 bits, and no text that fits a cell has so many
    distinct words.
    """
    words = docs.select(key, F.explode(F.array_distinct(F.array_remove(F.split(text, " "), ""))).alias("word"))
    h = words.select(key, F.conv(F.substring(F.md5("word"), 1, bits // 4), 16, 10).cast("bigint").alias("h"))
    both = F.lit(1 | 1 << 30)
    sums = h.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.shiftright("h", k).bitwiseAND(both)).alias(f"b{k}") for k in range(30)))
    counter = lambda k: F.shiftright(f"b{k % 30}", k // 30 * 30).bitwiseAND(F.lit((1 << 30) - 1))
    value = reduce(Column.bitwiseOR, (F.when(counter(k) * 2 > F.col("n"), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(bits)))
    return sums.select(key, value.alias("hash"))


def agreeing_blocks(n: int, k: int) -> int:
    """How many of ``k + r`` blocks to join on: the fewest that give ``n`` random hashes lists of some sixteen."""
    return next((r for r in (1, 2, 3) if BITS * r / (k + r) >= math.log2(max(n, 1)) - 4), 4)


def _block(h: Column, i: int, m: int) -> Column:
    lo, hi = BITS * i // m, BITS * (i + 1) // m
    return F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < BITS else h


def _keys(hashes: DataFrame, name: str, m: int, r: int) -> DataFrame:
    """``hashes``, the hash called ``name``, with blocks: a row for each choice of ``r`` of ``m`` blocks.

    The bits that the blocks hold stand below the number of the choice, in one long;
    it is all of the key, so that rows are short and sorted by it.
    """

    def value(number: int, blocks: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in blocks:
            out = F.shiftleft(out, BITS * (i + 1) // m - BITS * i // m).bitwiseOR(_block(F.col("hash"), i, m))
        return out.bitwiseOR(F.lit(number << r * -(-BITS // m)).cast("long"))

    each = F.array(*(value(n, c) for n, c in enumerate(combinations(range(m), r))))
    others = [c for c in hashes.columns if c != "hash"]
    return hashes.select(*others, F.col("hash").alias(name), F.explode(each).alias("blocks"))


def _meeting(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> int:
    """Rows of the shorter side, in the group ``by`` that has most."""
    side = lambda df, n, m: df.select(*by, F.lit(n).alias("n"), F.lit(m).alias("m"))
    sizes = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return sizes.agg(F.max(F.least("n", "m"))).first()[0] or 0


def _pairs_within(left: DataFrame, right: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of two written tables, equal in ``by``, whose hashes a and b are within ``k``, with their distance and other columns."""
    r = agreeing_blocks(_meeting(left, right, by), k)
    m = k + r
    a, b = _keys(left, "a", m, r), _keys(right, "b", m, r)
    pairs = a.join(by_merge(b), ["blocks", *by]).where(hamming(F.col("a"), F.col("b")) <= k)
    if k:
        agree = F.concat_ws(",", *(F.when(_block(F.col("a").bitwiseXOR(F.col("b")), i, m) == 0, F.lit(str(i))) for i in range(m)))
        choices = F.array(*(F.lit(",".join(map(str, c))) for c in combinations(range(m), r)))
        pairs = pairs.where(F.substring_index(agree, ",", r) == choices[F.shiftrightunsigned("blocks", r * -(-BITS // m)).cast("int")])
    return pairs.drop("blocks").withColumn("distance", hamming(F.col("a"), F.col("b")))


def distinct_pairs(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(a, b, distance) of distinct hashes within Hamming distance ``k``: an equi-join on blocks, then the exact distance.

    Of ``k + r`` blocks at least ``r`` agree; ``r`` grows with the number of
    hashes, so that lists of equal keys stay short.  A pair is kept only from
    the first ``r`` blocks that it agrees in, so no distinct is needed.
    """
    same_side = left is right
    left = materialise(left, "hashes")
    return _pairs_within(left, left if same_side else materialise(right, "hashes"), k).select("a", "b", "distance")


def hamming_pairs(items: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(id_a, id_b, distance) of all pairs of rows of ``items`` (key, hash) within distance ``k``, id_a < id_b."""
    distinct = items.select("hash").distinct()
    near = distinct_pairs(distinct, distinct, k)
    a = items.select(F.col("hash").alias("a"), F.col(key).alias("id_a"))
    b = items.select(F.col("hash").alias("b"), F.col(key).alias("id_b"))
    return near.join(by_merge(a), "a").join(by_merge(b), "b").where("id_a < id_b").select("id_a", "id_b", "distance")


def links(items: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Edges (a, b) that connect what ``hamming_pairs`` connects, without expanding equal hashes into pairs.

    Rows of one hash hang on its least key; near hashes are linked by theirs.
    """
    heads = materialise(items.groupBy("hash").agg(F.min(key).alias("head")), "heads")
    star = items.join(by_merge(heads), "hash").where(F.col(key) != F.col("head")).select(F.col("head").alias("a"), F.col(key).alias("b"))
    distinct = heads.select("hash")
    near = distinct_pairs(distinct, distinct, k).where("a < b")
    head = lambda s: by_merge(heads.select(F.col("hash").alias(s), F.col("head").alias(f"head_{s}")))
    across = near.join(head("a"), "a").join(head("b"), "b")
    return star.unionByName(across.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def groups(items: DataFrame, k: int = 4, key: str = "doc_id", on_null: str = "skip") -> DataFrame:
    """``items`` with group_id: transitive groups of rows within distance ``k``, numbered from 0 by their least key.

    Rows without a hash are skipped, or an error if ``on_null`` is "raise".
    """
    if on_null == "raise":
        items = items.withColumn("hash", F.coalesce("hash", F.raise_error(F.lit("a row has no hash")).cast("bigint")))
    items = items.where(F.col("hash").isNotNull())
    items = materialise(items, "hashed")
    found = materialise(grouped(items, links(items, k, key), key), "groups")
    numbers = numbered(found.groupBy("comp").agg(F.count("*").alias("group_size")), [F.col("comp")], "group_id")
    return found.join(by_merge(numbers), "comp").drop("comp")


def radii(k: int) -> list[int]:
    """The radii that a search within ``k`` grows through: 0, 1, 2, 4 and so on up to ``k``."""
    return [0, *(1 << i for i in range(max(k, 1).bit_length()) if 1 << i < k), *([k] if k else [])]


def nearest(left: DataFrame, right: DataFrame, k: int, key: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``left`` the nearest of ``right``, among rows equal in ``by``, within ``k``: least distance, then least key.

    Each hash of either side is compared once, and a hash of the right side
    stands for its least key.  The radius grows, and hashes that have met a
    neighbour leave before the next one: in dense places, where neighbours are
    close, the wide joins on few bits never see them, and nothing is lost, as
    what is within a smaller radius is nearer.

    Rows without a hash, or with a null in ``by``, have no neighbour; without
    rows on either side there are none.
    """
    heads = materialise(right.groupBy(*by, "hash").agg(F.min(key).alias("right_id")), "heads")
    rest, found = materialise(left.select(*by, "hash").where(F.col("hash").isNotNull()).distinct(), "hashes"), []
    for radius in radii(k):
        best = _pairs_within(rest, heads, radius, by).groupBy(*by, "a").agg(F.min(F.struct("distance", "right_id")).alias("m"))
        found.append(materialise(best.withColumnRenamed("a", "hash"), "nearest"))
        if radius < k:
            rest = materialise(rest.join(by_merge(found[-1]), [*by, "hash"], "left_anti"), "hashes")
    best = reduce(DataFrame.unionByName, found)
    return left.select(*by, F.col(key).alias("left_id"), "hash").join(by_merge(best), [*by, "hash"]).select(*by, "left_id", "m.right_id", "m.distance")


def nearest_across_splits(items: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``nearest`` of each pair of splits of ``items`` (key, hash, split), with split_a and split_b; one search for all pairs."""

    def side(at: int) -> DataFrame:
        """Rows once for each pair of splits that has theirs on this side, with the pair's number."""
        own = F.array_compact(F.array(*(F.when(F.col("split") == p[at], F.lit(n)) for n, p in enumerate(PAIRS))))
        return items.select(key, "hash", F.explode(own).alias("pair"))

    found = nearest(side(0), side(1), k, key, ("pair",))
    names = F.array(*(F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b")) for a, b in PAIRS))[F.col("pair")]
    return found.withColumn("p", names).select("p.*", "left_id", "right_id", "distance")


def strongest(pairs: DataFrame, k: int, n: int) -> DataFrame:
    """The ``n`` nearest of the pairs within ``k``, by distance, then the left key."""
    return pairs.where(F.col("distance") <= k).orderBy("distance", "left_id").limit(n)


def group_info(grouped_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per group of several rows: size, splits, labels, whether either mixes, and its priority."""
    g = grouped_rows.groupBy("group_id").agg(F.count("*").alias("images"), F.sum("label").cast("long").alias("fraud"), F.array_sort(F.collect_set("split")).alias("s"), F.array_sort(F.collect_set("label")).alias("l"), F.min(key).alias("least_id")).where("images > 1")
    both = lambda a, b: F.array_contains("s", a) & F.array_contains("s", b)
    mixed = F.size("l") > 1
    priority = F.when(mixed, 0).when(both("train", "test"), 1).when(both("train", "validation"), 2).when(both("validation", "test"), 3).otherwise(4)
    return g.select(
        "group_id", "images", "fraud", F.array_join("s", ",").alias("splits"), F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("labels"), mixed.alias("mixed_label"), (F.size("s") > 1).alias("cross_split"), priority.cast("int").alias("priority"), "least_id",
        both("train", "validation").alias("train_validation"), both("train", "test").alias("train_test"), both("validation", "test").alias("validation_test"),
    )


def group_stats(grouped_rows: DataFrame) -> DataFrame:
    """Groups, groups of several rows, rows in those, and the largest size."""
    sizes = grouped_rows.groupBy("group_id").agg(F.count("*").alias("n"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    many = F.col("n") > 1
    return sizes.agg(F.count("*").alias("groups"), count(many.cast("long")).alias("duplicate_groups"), count(F.when(many, F.col("n")).otherwise(0)).alias("images_in_duplicates"), F.max("n").alias("largest"))


def priority_sample(info: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` groups by priority, then size, then least key, numbered from 1."""
    order = [F.col("priority"), F.desc("images"), F.col("least_id")]
    return info.orderBy(*order).limit(n).withColumn("group_number", F.row_number().over(Window.orderBy(*order)))


def priority_members(info: DataFrame, grouped_rows: DataFrame, n: int = 50, each: int = 8, key: str = "doc_id") -> DataFrame:
    """The first ``each`` rows, by key, of the first ``n`` groups: group_number, place from 1, key, split, label."""
    first = priority_sample(info, n).select("group_id", "group_number")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(key))
    rows = grouped_rows.join(F.broadcast(first), "group_id").withColumn("place", place).where(F.col("place") <= each)
    return rows.select("group_number", "place", key, "split", "label")


def labelled_pairs(pairs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs (left_id, right_id, distance) with both sides' labels."""
    side = lambda s: labels.select(F.col(key).alias(f"{s}_id"), F.col("label").alias(f"{s}_label"))
    return pairs.join(by_merge(side("left")), "left_id", "left").join(by_merge(side("right")), "right_id", "left").select("left_id", "left_label", "right_id", "right_label", "distance")
