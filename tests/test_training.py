import numpy as np
import pytest
from pyspark.sql import functions as F

from lenswright.operators import training
from lenswright.plans import workspace
from lenswright.sources.positions import Permutation, RowStore


def rows(n=200, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(y), (rng.normal(size=8) + 2.0 * y * np.r_[1, -1, 0, 0, 0, 0, 0, 0]).tolist()) for y in rng.integers(0, 2, n)]


def table(spark, data):
    return spark.createDataFrame([*data, (1, None), (None, [0.0] * 8)], "label int, embedding array<double>")


def plain_epoch(x, y, p, moments, steps, rate, names, size):
    """One process, batch after batch: each batch's mean loss, and the parameters (Adam with decoupled decay, written out)."""
    losses = []
    for a in range(0, len(y), size):
        xb, yb = x[a : a + size], y[a : a + size]
        z = xb - xb.mean(1, keepdims=True)
        z = z / np.sqrt((z * z).mean(1, keepdims=True) + 1e-6)
        h = z * p["scale"] + p["shift"]
        logit = h @ p["weight"] + p["bias"]
        losses.append(np.mean(np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - yb * logit))
        d = (1 / (1 + np.exp(-logit)) - yb) / len(yb)
        g = {"bias": np.array([d.sum()]), "weight": h.T @ d, "scale": p["weight"] * (z.T @ d), "shift": p["weight"] * d.sum()}
        steps += 1
        for k in names:
            m, v = moments.setdefault(k, (np.zeros_like(g[k]), np.zeros_like(g[k])))
            m, v = 0.9 * m + 0.1 * g[k], 0.999 * v + 0.001 * g[k] ** 2
            moments[k] = m, v
            p[k] = p[k] * (1 - rate * 1e-4) - rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return losses, steps


@pytest.mark.parametrize("workers", [1, 3])
def test_epochs_like_one_process(spark, workers):
    """Loss by step and parameters equal a plain run over the same order, whatever the number of workers."""
    store = training.training_rows(table(spark, rows(150)))
    stored = sorted(store.all().collect(), key=lambda r: r.position)
    assert [r.position for r in stored] == list(range(150))
    x, y = np.array([r.x for r in stored]), np.array([r.y for r in stored])
    head, p, moments, steps = training.Head.new(8), training.Head.new(8).arrays(), {}, 0
    for seed, all_layers in ((1, False), (2, True), (3, True)):
        names = tuple(p) if all_layers else ("weight", "bias")
        log = training.train_one_epoch(store, head, 0.05, all_layers, 32, seed, workers)
        order = Permutation(150, seed).at(range(150))
        want, steps = plain_epoch(x[order], y[order], p, moments, steps, 0.05, names, 32)
        got = [(r.step, r.n, r.loss) for r in training.step_losses(log).orderBy("step").collect()]
        assert [g[:2] for g in got] == [(0, 32), (1, 32), (2, 32), (3, 32), (4, 22)]
        assert [g[2] for g in got] == pytest.approx(want, rel=1e-9)
        assert head.steps == steps
        for k in p:
            assert head.parameters[k] == pytest.approx(p[k].tolist(), rel=1e-8, abs=1e-12)


def test_an_epoch_reads_its_rows_once(spark):
    store = training.training_rows(table(spark, rows(70)))
    plan = store.batched(32, 1).select("batch", "place", "y", "x").repartition(2, "batch", "place").sortWithinPartitions("batch", "place")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    log = training.train_one_epoch(store, training.Head.new(8), 0.1, True, 32, 1, 2)
    assert log.count() == 70 and log.groupBy("step").count().count() == 3


def test_training_learns_and_checkpoints(spark, tmp_path):
    df = table(spark, rows())
    head, history = training.fit_two_stages(spark, df, df, 8, f"file://{tmp_path}", stages=((2, 0.05, False), (1, 0.05, True)))
    assert len(history) == 3 and history[-1]["train_loss"] < history[0]["train_loss"] and max(h["f1"] for h in history) > 0.8
    assert history[0]["train_tn"] + history[0]["train_fp"] + history[0]["train_fn"] + history[0]["train_tp"] == 200
    loaded, metrics_ = training.load_checkpoint(spark, f"file://{tmp_path}/checkpoint")
    assert loaded == head and metrics_["f1"] == max(h["f1"] for h in history)
    assert spark.read.json(f"file://{tmp_path}/metrics").first().best_epoch == metrics_["epoch"]
    assert training.parameter_counts(head, False) == {"total": 25, "trainable": 9}


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float)
    p = {"scale": rng.normal(size=5), "shift": rng.normal(size=5), "weight": rng.normal(size=5), "bias": rng.normal(size=1)}
    _, loss, sums = training.summed(p, x, y)
    for name in p:
        for i in range(len(p[name])):
            up = {**p, name: p[name] + 1e-6 * (np.arange(len(p[name])) == i)}
            assert (training.summed(up, x, y)[1].sum() - loss.sum()) / 1e-6 == pytest.approx(sums[name][i], abs=1e-3)


def test_an_empty_table_leaves_the_head(spark):
    store = training.training_rows(table(spark, []))
    head = training.Head.new(8)
    log = training.train_one_epoch(store, head, 0.1, True)
    assert len(store) == 0 and log.count() == 0 and head == training.Head.new(8)
    assert training.epoch_metrics(log)["train_loss"] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 31, 32, 33, 1000, 4097])
def test_permutations(n):
    for seed in (0, 42):
        p = Permutation(n, seed)
        order = p.at(range(n))
        assert sorted(order.tolist()) == list(range(n))
        assert p.place_of(order).tolist() == list(range(n))
    assert n < 100 or Permutation(n, 1).at(range(n)).tolist() != order.tolist() != list(range(n))
    with pytest.raises(IndexError):
        p.at([n])


def test_permutations_of_many():
    p = Permutation(10**12, 7)
    at = p.at([0, 1, 10**12 - 1])
    assert p.place_of(at).tolist() == [0, 1, 10**12 - 1] and 0 <= at.min() and at.max() < 10**12


def test_store_by_position(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("doc_id"), F.concat(F.lit("t"), "id").alias("a b"), F.array("id").alias("x"))
    store = RowStore.write(df.repartition(5), f"file://{tmp_path}/s", [F.col("doc_id")], per_range=64)
    again = RowStore.open(spark, f"file://{tmp_path}/s")
    assert len(again) == 1000 and again.batches() == 32
    assert [(r.position, r.doc_id) for r in again.all().orderBy("position").collect()] == [(k, k) for k in range(1000)]
    assert again.row(0).doc_id == 0 and again.row(-1).doc_id == 999 and again.row(500)["a b"] == f"t{next(i for i in range(1000) if i * 7919 % 1000 == 500)}"
    assert [r.doc_id for r in again.batch(31).orderBy("place").collect()] == list(range(992, 1000))
    want = Permutation(1000, 9).at(range(64, 96)).tolist()
    one = again.batch(2, seed=9)
    assert [r.doc_id for r in one.orderBy("place").collect()] == want
    assert {int(f.split("range=")[1].split("/")[0]) for f in one.inputFiles()} == {p // 64 for p in want}  # and no other range is read
    whole = {(r.batch, r.place): r.doc_id for r in store.batched(32, 9).collect()}
    assert len(whole) == 1000 and [whole[2, k] for k in range(32)] == want
    assert {(r.batch, r.place, r.doc_id) for r in store.batched(32).collect()} == {(k // 32, k % 32, k) for k in range(1000)}
    for bad in (-1, 32):
        with pytest.raises(IndexError):
            again.batch(bad)
    with pytest.raises(IndexError):
        again.row(1000)
    assert again.at([]).count() == 0


def test_store_as_rows_stand(spark):
    df = spark.range(500).repartition(7)
    store = RowStore.write(df, workspace.work_path(spark, "store"), per_range=100)
    found = store.all().collect()
    assert sorted(r.position for r in found) == list(range(500)) == sorted(r.id for r in found)


def test_sums_over_workers(tmp_path):
    """Workers that meet at every step get one total, and leave at most two steps' files."""
    from concurrent.futures import ThreadPoolExecutor

    def run(k):
        e = training.Exchange(f"file://{tmp_path}/run", k, 3)
        return [e.total(np.array([k + 0.5 * step, 1.0])).tolist() for step in range(20)]

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(run, range(3)))
    assert got[0] == got[1] == got[2] == [[3 + 1.5 * step, 3.0] for step in range(20)]
    assert len(list((tmp_path / "run").iterdir())) <= 6
