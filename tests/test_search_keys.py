"""Keys of the Hamming searches: one long a row, and as many as the shorter side of a pair of splits needs."""

import random

import pytest
from pyspark.sql import functions as F

from lenswright.operators import neardup
from lenswright.plans import workspace


def near_hashes(n, seed=9):
    rng, out = random.Random(seed), []
    for k in range(n):
        h = rng.getrandbits(64) if k % 3 == 0 else out[-1] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8)))
        out.append(h & (1 << 64) - 1)
    return [h - (1 << 64) if h >> 63 else h for h in out]


def test_a_key_is_one_long(spark):
    items = spark.createDataFrame([(k, h) for k, h in enumerate(near_hashes(5))], "doc_id long, hash long")
    keys = neardup._keys(items, "a", 8, 2)
    assert {t for _, t in keys.dtypes} == {"bigint"}
    assert keys.count() == 5 * 28


def test_blocks_follow_from_the_shorter_side_of_a_pair_of_splits(spark, monkeypatch):
    seen, rule = [], neardup.agreeing_blocks
    monkeypatch.setattr(neardup, "agreeing_blocks", lambda n, k: (seen.append(n), rule(n, k))[1])
    rng = random.Random(2)
    items = spark.createDataFrame([(k, rng.getrandbits(60), "train" if k < 200 else "validation" if k < 230 else "test") for k in range(270)], "doc_id long, hash long, split string")
    assert neardup.nearest_across_splits(workspace.materialise(items, "hashes"), 1).count() == 0
    assert seen == [40, 40]  # train with test; the left side has 430 rows over all pairs


@pytest.mark.parametrize("r", [1, 2, 3, 4])
def test_pairs_within_a_group_by_any_number_of_blocks(spark, monkeypatch, r):
    monkeypatch.setattr(neardup, "agreeing_blocks", lambda n, k: r)
    rows = [(k, h, k % 2) for k, h in enumerate(near_hashes(120))]
    items = workspace.materialise(spark.createDataFrame(rows, "id long, hash long, g int"), "hashes")
    for k in (0, 1, 6):
        got = neardup._pairs_within(items.withColumnRenamed("id", "x"), items.withColumnRenamed("id", "y"), k, ("g",)).select("x", "y", F.col("distance").cast("long"))
        want = sorted((x, y, d) for x, a, g in rows for y, b, e in rows if g == e and (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= k)
        assert sorted(map(tuple, got.collect())) == want
