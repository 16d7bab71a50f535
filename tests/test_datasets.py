import io
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lenswright.operators import audit, datasets, images, metrics, neardup, splits, training
from lenswright.plans import workspace


def test_rows_without_a_probability_count_nowhere(spark):
    rows = [(1, 0.9), (0, 0.1), (0, 0.5), (1, None), (0, None), (None, 0.7)]
    df = spark.createDataFrame(rows, "label int, prob double")
    one = metrics.metric_bundle(df, 0.5).first()
    assert (one.average_precision, one.roc_auc) == (1.0, 1.0)
    assert (one.tn, one.fp, one.fn, one.tp) == (1, 1, 0, 1)
    at = {round(r.threshold, 2): (r.tn, r.fp, r.fn, r.tp) for r in metrics.threshold_sweep(df).collect()}
    assert at[0.3] == (1, 1, 0, 1) and at[0.8] == (2, 0, 0, 1)
    assert metrics.predictions(df, 0.5).count() == 3
    assert {r["class"]: r.support for r in metrics.classification_report(df).collect()}["Fraud"] == 1
    assert metrics.average_precision(df.where("prob is null")).first().average_precision is None


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1001])
def test_quartiles_like_numpy(spark, n):
    rng = random.Random(n)
    rows = [(k % 2, rng.choice((0.25, rng.random()))) for k in range(n)] + [(0, None), (2, None)]
    got = {r.label: r for r in metrics.describe(spark.createDataFrame(rows, "label int, prob double")).collect()}
    for k in {k % 2 for k in range(n)}:
        v = [p for l, p in rows if l == k and p is not None]
        assert (got[k].n, got[k].lowest, got[k].highest) == (len(v), min(v), max(v))
        assert [got[k].q25, got[k].q50, got[k].q75] == pytest.approx(np.percentile(v, [25, 50, 75]).tolist())
    assert got[2].n == 0 and got[2].q50 is None


@pytest.mark.parametrize("r", [1, 2, 3, 4])
@pytest.mark.parametrize("k", [0, 4, 6])
def test_hamming_joins_on_several_blocks(spark, monkeypatch, r, k):
    monkeypatch.setattr(neardup, "agreeing_blocks", lambda n, k: r)
    rng = random.Random(r)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(0, 8))) for b in base for _ in range(4)]
    h = sorted({struct.unpack("q", struct.pack("Q", x))[0] for x in base + near})
    df = spark.createDataFrame([(x,) for x in h], "hash long")
    got = [(r.a, r.b, r.distance) for r in neardup.distinct_pairs(df, df, k).where("a < b").collect()]
    want = [(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for i, a in enumerate(h) for b in h[i + 1 :]]
    assert sorted(got) == [w for w in sorted(want) if w[2] <= k]


def test_blocks_grow_with_the_hashes():
    assert [neardup.agreeing_blocks(n, 4) for n in (0, 1000, 10**6, 10**9, 10**12)] == [1, 1, 2, 3, 4]


def test_a_common_file_is_never_gathered(spark):
    rows = [(f"/p/{k:05d}", ("train", "test")[k % 2], "same") for k in range(2000)] + [("/q", "train", "own")]
    got = audit.hash_overlap(spark.createDataFrame(rows, "path string, split string, text string"), F.col("text")).collect()
    assert [(r.split_a, r.split_b, r.files_a, r.files_b, r.paths_a, r.paths_b) for r in got] == [("train", "test", 1000, 1000, "/p/00000|/p/00002", "/p/00001|/p/00003")]


def test_batches_and_datasets(spark):
    rows = [(f"/f{k:03d}", k % 3 == 0, ("train", "validation", "test")[k % 3 and 1 + k % 2]) for k in range(100)]
    s = spark.createDataFrame(rows, "path string, label boolean, split string").withColumn("label", F.col("label").cast("int"))
    loaders = datasets.create_dataloaders(s, 8)
    for split, d in loaders.items():
        found = sorted((r.batch, r.place, r.path) for r in d.collect())
        want = [p for p, _, x in rows if x == split]
        assert [f[:2] for f in found] == [(k // 8, k % 8) for k in range(len(want))]
        paths = [f[2] for f in found]
        assert sorted(paths) == want and (paths == want) == (split != "train")
    with pytest.raises(ValueError):
        datasets.split_dataset(s, "other")


def test_pictures():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (40, 20, 3)).astype(np.uint8)
    small = images.thumbnail(rgb, 16, 16)
    assert small.shape == (16, 16, 3) and (small[:, :4] == 255).all() and (small[:, 12:] == 255).all()
    assert (images.thumbnail(rgb, 60, 60)[10:50, 20:40] == rgb).all()
    sheet = images.contact_sheet([rgb] * 5, 2, 16, 16, 8)
    assert sheet.shape == (8 + 3 * 24, 8 + 2 * 24, 3) and (sheet[8:24, 8:24] == small).all()
    boxed = images.with_boxes(rgb, [(2, 3, 10, 30), (-5, -5, 100, 100), (9, 9, 9, 9)], line=1)
    assert (boxed[3, 2:10] == (255, 0, 0)).all() and (boxed[5, 4] == rgb[5, 4]).all() and (boxed[0] == (255, 0, 0)).all()
    a, g = rng.random((3, 5, 5)), rng.random((3, 5, 5))
    assert images.cam_panels(rgb, a, g, True).shape == (40, 60, 3)
    assert (images.cam_panels(rgb, a, g, False)[:, :20] == rgb).all()
    pa_image = images.png(rgb)
    assert pa_image[:8] == b"\x89PNG\r\n\x1a\n" and len(io.BytesIO(pa_image).read()) == len(pa_image)


def test_png_is_read_by_spark(spark, tmp_path):
    rgb = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    (tmp_path / "a.png").write_bytes(images.png(rgb))
    i = spark.read.format("image").load(f"file://{tmp_path}").first().image
    assert (images.to_rgb(bytes(i.data), i.height, i.width, i.nChannels) == rgb).all()


def test_work_tables_of_a_scope_go(spark):
    with workspace.scope(spark) as folder:
        assert workspace.materialise(spark.range(3), "x").count() == 3
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.exists(path)
    assert not fs.exists(path)


def test_many_buckets_split_alike(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    some = {r.doc_id for r in splits.stratified(df, "doc_id", "label", 0.15).where("split = 'validation'").collect()}
    monkeypatch.setattr(splits.math, "ceil", lambda x: 3)
    assert {r.doc_id for r in splits.stratified(df, "doc_id", "label", 0.15).where("split = 'validation'").collect()} == some and len(some) == 46
