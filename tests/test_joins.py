"""Joins of sides that grow with the input are merged, however small Spark takes their files to be."""

import random

import pytest
from pyspark.sql import functions as F

from lenswright.operators import components as comp
from lenswright.operators import neardup, splits
from lenswright.plans import workspace


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture(scope="module")
def hashed(spark):
    """300 hashes, of which many are near to another, some are equal."""
    rng, rows = random.Random(3), []
    for k in range(300):
        h = rng.getrandbits(60) if k % 3 == 0 else rows[-1][1]
        rows.append((k, h ^ (1 << rng.randrange(60)) if k % 3 == 1 else h))
    return workspace.materialise(spark.createDataFrame(rows, "doc_id long, hash long"), "hashed"), rows


def near(rows, k):
    return {(a, b, d) for a, x in rows for b, y in rows if a < b and (d := (x ^ y).bit_count()) <= k}


def test_hamming_pairs_are_merged(spark, hashed):
    items, rows = hashed
    distinct = items.select("hash").distinct()
    assert broadcasts(neardup.distinct_pairs(distinct, distinct, 4)) == 0
    pairs = neardup.hamming_pairs(items, 4)
    assert broadcasts(pairs) == 0
    assert {tuple(r) for r in pairs.collect()} == near(rows, 4)


def test_nearest_is_merged(spark, hashed, monkeypatch):
    items, rows = hashed
    plans = []
    monkeypatch.setattr(neardup, "materialise", lambda df, name: (plans.append((name, broadcasts(df))), workspace.materialise(df, name))[1])
    found = neardup.nearest_across_splits(items.withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test")), 4)
    assert not any(n for _, n in plans) and broadcasts(found) == 0
    want = {}
    for a, x in rows:
        best = min(((x ^ y).bit_count(), b) for b, y in rows if b % 2) if a % 2 == 0 else None
        if best and best[0] <= 4:
            want[a] = best
    assert {r.left_id: (r.distance, r.right_id) for r in found.collect()} == want


def test_groups_and_splits_are_merged(spark, hashed, monkeypatch):
    items, rows = hashed
    plans = []
    for module in (neardup, comp):
        monkeypatch.setattr(module, "materialise", lambda df, name: (plans.append((name, broadcasts(df))), workspace.materialise(df, name))[1])
    found = neardup.groups(items, 4)
    assert plans and not any(n for _, n in plans)
    root = {k: k for k, _ in rows}
    while moved := [(a, b) for a, b, _ in near(rows, 4) if root[a] != root[b]]:
        for a, b in moved:
            root[a] = root[b] = min(root[a], root[b])
    number = {r: i for i, r in enumerate(sorted(set(root.values())))}
    assert {r.doc_id: r.group_id for r in found.collect()} == {k: number[r] for k, r in root.items()}
    dev = splits.development_split(workspace.materialise(found, "grouped"), "group_id")
    assert broadcasts(dev) <= 2  # a row a range, a row a block of ranges
    assert dev.count() == 300
