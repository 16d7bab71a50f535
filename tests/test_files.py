import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lenswright.operators import images, scoring
from lenswright.sources import files, sinks
from lenswright.streaming import intake


def png(path, a):
    """Write an RGB array as PNG."""
    h, w, _ = a.shape
    raw = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(0)
    smooth = rng.integers(20, 230, (6, 8, 1)).repeat(8, 0).repeat(8, 1).repeat(3, 2)
    for split in ("train", "test"):
        for name in ("Fraud", "Non-Fraud"):
            for k in range(2):
                png(root / split / name / f"{k}.PNG", rng.integers(0, 255, (40, 50, 3)))
    png(root / "train" / "Fraud" / "smooth.png", smooth)
    png(root / "test" / "Fraud" / "smooth2.png", np.clip(smooth + 3, 0, 255))
    (root / "train" / "Fraud" / "broken.jpg").write_bytes(b"no image")
    (root / "train" / "Fraud" / "notes.txt").write_text("x")
    return root


def test_scans(spark, tree):
    assert len(files.image_files(spark, f"file://{tree}").collect()) == 11
    assert files.image_files(spark, f"file://{tree}/none").collect() == []
    rows = files.labelled_files(spark, f"file://{tree}/train").collect()
    assert sorted((r.label, r.class_name) for r in rows) == [(0, "Non-Fraud")] * 2 + [(1, "Fraud")] * 4
    with pytest.raises(FileNotFoundError):
        files.labelled_files(spark, f"file://{tree}")
    records = files.split_class_records(spark, f"file://{tree}").collect()
    assert len(records) == 11 and [r.path.rsplit("/", 1)[1] for r in records if not r.valid] == ["broken.jpg"]
    assert {(r.width, r.height) for r in records} == {(50, 40), (64, 48), (None, None)}
    hashed = files.hashed_files(files.binary_files(spark, f"file://{tree}/train/Fraud")).collect()
    assert len(hashed) == 4 and all(len(r.md5) == 32 and len(r.sha256) == 64 for r in hashed)


def test_perceptual_hashes(spark, tree):
    rows = {r.path.rsplit("/", 2)[1] + r.path.rsplit("/", 1)[1]: r.hash for r in images.with_phash(files.images(spark, f"file://{tree}")).collect()}
    assert rows["Fraudbroken.jpg"] is None
    close = ((rows["Fraudsmooth.png"] ^ rows["Fraudsmooth2.png"]) & (2**64 - 1)).bit_count()
    far = ((rows["Fraudsmooth.png"] ^ rows["Non-Fraud0.PNG"]) & (2**64 - 1)).bit_count()
    assert close <= 4 < far
    with pytest.raises(Exception, match="cannot hash"):
        images.with_phash(files.images(spark, f"file://{tree}"), "raise").collect()


def test_tensors(spark, tree):
    im = files.images(spark, f"file://{tree}/train")
    a = images.tensors(im).collect()
    b, c = images.tensors(im, training=True).collect(), images.tensors(im, training=True).collect()
    assert len(a) == 5 and all(len(r.tensor) == 3 * 224 * 224 for r in a + b)
    assert [r.tensor[:50] for r in b] == [r.tensor[:50] for r in c]
    flat = images.eval_tensor(np.full((30, 30, 3), 128, np.uint8))
    assert np.allclose(flat[0], (128 / 255 - 0.485) / 0.229, atol=1e-5)


def test_pixel_helpers():
    assert images.to_rgb(bytes([1, 2, 3, 9]), 1, 1, 4).tolist() == [[[3, 2, 1]]]
    assert images.to_rgb(bytes([7]), 1, 1, 1).tolist() == [[[7, 7, 7]]]
    with pytest.raises(TypeError):
        images.to_rgb(b"ab", 1, 1, 2)
    cam = images.activation_map(np.array([[[0.0, 1.0]], [[1.0, 0.0]]]), np.array([[[1.0, 1.0]], [[-1.0, -1.0]]]))
    assert cam.tolist() == [[0.0, 1.0]] and images.activation_map(np.ones((1, 2, 2)), -np.ones((1, 2, 2))).max() == 0
    assert images.blend(np.zeros((4, 4, 3)), np.ones((2, 2))).shape == (4, 4, 3)


def test_split_files_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("/a", 1, "train"), ("/b, c", 0, "test")], "path string, label int, split string")
    root = f"file://{tmp_path}"
    sinks.write_splits(df, f"{root}/s")
    assert [tuple(r) for r in files.load_split(spark, f"{root}/s/test", "test").collect()] == [("/b, c", 0, "test")]
    with pytest.raises(FileNotFoundError):
        files.load_split(spark, f"{root}/none", "x")
    sinks.write_csv(df.select("path"), f"{root}/bad")
    with pytest.raises(ValueError, match="label"):
        files.load_split(spark, f"{root}/bad", "x")
    sinks.write_csv(df.select("path", F.lit("many").alias("label")), f"{root}/worse")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.load_split(spark, f"{root}/worse", "x").collect()
    assert sinks.backup(spark, f"{root}/s", f"{root}/copy")
    with pytest.raises(FileExistsError):
        sinks.backup(spark, f"{root}/s", f"{root}/copy")
    sinks.write_report(spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("x")), f"{root}/r.json")
    assert files.json_settings(spark, f"{root}/r.json", "x struct<a: int>").first().x.a == 1


def test_scoring_boundary(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(10)], "doc_id long, x double")

    def load():
        def model(f: pd.DataFrame) -> pd.Series:
            if (f["x"] == 3).any():
                raise ValueError("bad row")
            return f["x"] / 10

        return model

    assert sorted((r.doc_id, r.prob) for r in scoring.score_with(load, rows, ["doc_id"], "drop").collect()) == [(k, k / 10) for k in range(10) if k != 3]
    assert sum(r.prob is None for r in scoring.score_with(load, rows, ["doc_id"]).collect()) == 1
    with pytest.raises(Exception, match="bad row"):
        scoring.score_with(load, rows, ["doc_id"], "raise").collect()


def test_intake_stream(spark, tmp_path):
    for k, body in enumerate((b"a", b"b", b"a")):
        (tmp_path / f"{k}.jpg").write_bytes(body)
    (tmp_path / "x.txt").write_bytes(b"c")
    stream = intake.first_uploads(intake.landed_files(spark, f"file://{tmp_path}"))
    q = stream.writeStream.format("memory").queryName(f"uploads{int(time.time())}").outputMode("append").start()
    q.processAllAvailable()
    name = q.name
    q.stop()
    assert spark.sql(f"select distinct sha256 from {name}").count() == 2 and spark.sql(f"select * from {name}").count() == 2
