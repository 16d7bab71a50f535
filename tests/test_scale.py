"""Plans that hold where one key has most of the rows: what tasks read is looked up in the status store."""

import random

import pytest
from pyspark.sql import functions as F

from lenswright.operators import components as comp
from lenswright.operators import eda, metrics
from lenswright.plans import workspace


@pytest.fixture
def whole_partitions(spark):
    """Small shuffle partitions stay tasks of their own, and nothing is broadcast unasked."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def stages(spark):
    """The status store, and the stages in it."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    listed = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return store, [listed.apply(i) for i in range(listed.size())]


def shuffle_reads(spark, since):
    """Per stage after ``since``: the records that each task read from shuffles."""
    store, out = stages(spark)[0], {}
    for stage in stages(spark)[1]:
        if stage.stageId() > since:
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            out[stage.stageId()] = [tasks.apply(k).taskMetrics().get().shuffleReadMetrics().recordsRead() for k in range(tasks.size()) if tasks.apply(k).taskMetrics().isDefined()]
    return out


def last_stage(spark):
    return max((s.stageId() for s in stages(spark)[1]), default=-1)


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("heavy", [3, 100_000])
def test_components_with_heavy_nodes(spark, monkeypatch, heavy):
    monkeypatch.setattr(comp, "HEAVY", heavy)
    rng = random.Random(1)
    edges = [(500, k) for k in range(400, 900)] + [(2000 + k, 2001 + k) for k in range(30)] + [(5, 5), (7, 8), (8, 7)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    got = comp.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert comp.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_star_is_no_single_task(spark, whole_partitions, monkeypatch):
    """No task reads more than three times the median of a stage that reads as much as a star has edges."""
    monkeypatch.setattr(comp, "HEAVY", 1000)
    since = last_stage(spark)
    star = spark.range(1, 40_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = comp.components(star.repartition(4))
    assert got.where("comp = 0").count() == 40_001
    read = {k: sorted(v) for k, v in shuffle_reads(spark, since).items() if sum(v) >= 30_000 and len(v) > 1}
    assert read and all(v[-1] <= 3 * max(1, v[len(v) // 2]) for v in read.values()), read


def test_a_common_content_can_be_split(spark, whole_partitions):
    """Of 30,000 files 20,000 are equal: adaptive execution marks the join's skew."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"), F.concat(F.lit("/data/some/long/path/of/a/file/"), F.col("id")).alias("path"))
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = eda.duplicate_groups(df.repartition(8), F.md5(F.col("text").cast("binary")))
        found.write.format("noop").mode("overwrite").save()
        assert found.count() == 20_000
        files = eda.duplicate_groups(df.repartition(8), F.md5(F.col("text").cast("binary")))
        files.collect()
        assert "skew=true" in files._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_ranges_follow_the_rows(spark, monkeypatch):
    """With few partitions set and many rows, no range has more than some rows; numbers and areas stay right."""
    monkeypatch.setattr(workspace, "RANGE_ROWS", 500)
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("k"))
    parts = workspace.ranges_of(workspace.materialise(df, "rows"), [F.col("k")], "part").groupBy("part").count().collect()
    assert len(parts) >= 15 and max(r["count"] for r in parts) <= 1500
    assert [(r.k, r.n) for r in workspace.numbered(df, [F.col("k")], "n").orderBy("n").collect()] == [(k, k) for k in range(10_000)]
    scores = spark.range(6000).select((F.col("id") % 3 == 0).cast("int").alias("label"), ((F.col("id") * 7919 % 5003) / 5003).alias("prob"))
    rows = scores.collect()
    pos, neg = sorted(r.prob for r in rows if r.label), sorted(r.prob for r in rows if not r.label)
    import bisect

    wins = sum(bisect.bisect_left(neg, p) + (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p)) / 2 for p in pos)
    assert metrics.roc_auc(scores).first().roc_auc == pytest.approx(wins / len(pos) / len(neg))


def test_before_each_in_blocks(spark):
    sizes = spark.createDataFrame([(k, k % 5, 1) for k in range(40) if k != 7], "part int, n long, one long")
    got = {r.part: r for r in workspace.before_each(sizes, "part", ["n", "one"], block=4).collect()}
    down = {r.part: r for r in workspace.before_each(sizes, "part", ["n"], down=True, block=4).collect()}
    for k in got:
        assert got[k].before_n == sum(j % 5 for j in range(k) if j != 7) and got[k].before_one == k - (k > 7) and got[k].all_n == 78 and got[k].all_one == 39
        assert down[k].before_n == sum(j % 5 for j in range(k + 1, 40) if j != 7)


@pytest.mark.parametrize("cuts", [2, 5, 4096])
@pytest.mark.parametrize("groups", [0, 10_000])
def test_selection_in_many_steps(spark, monkeypatch, cuts, groups):
    """Few parts a step, crowded and far-off values, null groups, both ways of keeping what is left."""
    monkeypatch.setattr(metrics, "CUTS", cuts)
    monkeypatch.setattr(metrics, "GROUPS", groups)
    rng = random.Random(cuts)
    rows = [(k % 2 or None, rng.choice((0.5, rng.random(), 1e-300, 1e6 * rng.random(), -3.0))) for k in range(60 if cuts == 2 else 301)] + [(1, None), (9, 0.25)]
    got = {r.label: r for r in metrics.describe(spark.createDataFrame(rows, "label int, prob double")).collect()}
    import numpy as np

    for label in (1, None, 9):
        v = [p for x, p in rows if x == label and p is not None]
        assert [got[label].q25, got[label].q50, got[label].q75] == pytest.approx(np.percentile(v, [25, 50, 75]).tolist())
