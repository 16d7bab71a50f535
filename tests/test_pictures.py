import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lenswright.operators import images, pictures, scoring, training
from lenswright.plans import workspace
from lenswright.sources import file_sink, probe


def walked(data):
    """A probe of bytes, and how many of them it fetched."""
    seen = []

    def read(at, n):
        seen.append(n)
        return data[at : at + n]

    return probe.probe(read, len(data)), sum(seen)


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def a_png(width=300, height=200, depth=8, colour=2, body=b"x" * 100_000):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def a_jpeg(parts=3, marker=0xC2, tail=b"\xff\xd9"):
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, 200, 300, parts) + b"\1\x11\0" * parts
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + segment(0xE1, b"thumb" * 9000) + b"\xff" + segment(marker, frame) + segment(0xC4, b"\0" * 20) + segment(0xDA, b"\0" * 10) + b"\1" * 50_000 + tail


def a_gif(end=b"\x3b"):
    blocks = b"\xff" + b"d" * 255 + b"\x05hello" + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", 300, 200, 0x81, 0, 0) + b"\0" * 12 + b"\x21\xf9\x04" + b"\0" * 4 + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 300, 200, 0) + b"\x08" + blocks + end


def a_webp(kind):
    body = {
        b"VP8 ": b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300, 200) + b"d" * 101,
        b"VP8L": b"\x2f" + struct.pack("<I", 299 | 199 << 14 | 1 << 28) + b"d" * 50,
        b"VP8X": struct.pack("<I", 0x10) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"),
    }[kind]
    parts = kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    if kind == b"VP8X":
        parts += b"VP8L" + struct.pack("<I", 4) + b"data"
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WEBP" + parts


def a_bmp(depth=24):
    rows = (300 * depth + 31) // 32 * 4 * 200
    return b"BM" + struct.pack("<IHHI", 54 + rows, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 300, -200, 1, depth, 0, rows, 0, 0, 0, 0) + b"\0" * rows


def a_tiff(order="<"):
    entry = lambda tag, v: struct.pack(order + "HHII", tag, 4, 1, v)
    entries = [(256, 300), (257, 200), (273, 200), (277, 3), (279, 5000)]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return head + struct.pack(order + "H", len(entries)) + b"".join(entry(*e) for e in entries) + b"\0" * 4 + b"\0" * (5200 - 8 - 2 - 60 - 4)


WHOLE = {
    "png": (a_png(), "PNG", "RGB"), "grey": (a_png(colour=0), "PNG", "L"), "deep": (a_png(depth=16, colour=0), "PNG", "I;16"), "palette": (a_png(colour=3), "PNG", "P"), "alpha": (a_png(colour=6), "PNG", "RGBA"),
    "jpeg": (a_jpeg(), "JPEG", "RGB"), "jpeg-grey": (a_jpeg(1, 0xC0), "JPEG", "L"), "cmyk": (a_jpeg(4), "JPEG", "CMYK"), "gif": (a_gif(), "GIF", "P"),
    "webp": (a_webp(b"VP8 "), "WEBP", "RGB"), "lossless": (a_webp(b"VP8L"), "WEBP", "RGBA"), "extended": (a_webp(b"VP8X"), "WEBP", "RGBA"),
    "bmp": (a_bmp(), "BMP", "RGB"), "bmp-palette": (a_bmp(8), "BMP", "P"), "tiff": (a_tiff(), "TIFF", "RGB"), "tiff-big": (a_tiff(">"), "TIFF", "RGB"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_and_truncated(name):
    data, kind, mode = WHOLE[name]
    found, read = walked(data)
    assert found == (kind, 300, 200, mode, None)
    assert read <= 60_000 and (len(data) < 60_000 or read < len(data) / 2)
    for cut in {len(data) - 1 - k * max(1, len(data) // 40) for k in range(40)} | set(range(1, min(len(data), 70))):
        short, _ = walked(data[:cut])
        assert short.problem is not None and short.width is None, cut


def test_broken_and_unknown():
    bad = bytearray(a_png())
    bad[17] ^= 1
    assert walked(bytes(bad))[0] == ("PNG", None, None, None, "bad checksum")
    assert walked(b"")[0].problem == "empty" and walked(b"no picture at all")[0].problem == "unknown format" and walked(b"\x89PN")[0].problem == "unknown format"
    assert walked(a_png(width=0))[0].problem == "bad header"
    assert walked(a_jpeg(tail=b""))[0].problem == "truncated" and walked(a_gif(b""))[0].problem == "truncated"
    assert walked(b"\xff\xd8\xff\xd9")[0].problem == "no data"
    rng = np.random.default_rng(0)
    for data, *_ in WHOLE.values():
        for _ in range(60):  # no damage crashes a walk or keeps it going
            b = bytearray(data[:6000])
            for at in rng.integers(0, min(len(b), 200), 3):
                b[at] = rng.integers(0, 256)
            walked(bytes(b))


def test_probe_of_tables(spark, tmp_path):
    files = {"a.png": a_png(), "b.jpg": a_png(), "c.JPEG": a_jpeg(), "d.png": b"", "e.gif": a_gif()[:-3], "f.txt": b"text"}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    want = {"a.png": (True, False, "RGB"), "b.jpg": (True, True, "RGB"), "c.JPEG": (True, False, "RGB"), "d.png": (False, False, None), "e.gif": (False, False, None), "f.txt": (False, False, None)}
    content = spark.createDataFrame([*((f"file:{tmp_path}/{n}", bytearray(d)) for n, d in files.items()), ("gone", None)], "path string, content binary")
    by_content = {r.path.rsplit("/", 1)[-1]: r for r in probe.probed(content).collect()}
    paths = spark.createDataFrame([*((f"file:{tmp_path}/{n}",) for n in files), (f"{tmp_path}/gone",), (None,), ("no such:thing",)], "path string")
    by_path = {(r.path or "null").rsplit("/", 1)[-1]: r for r in probe.probed_paths(paths).collect()}
    for found in (by_content, by_path):
        assert {n: (found[n].valid, found[n].renamed, found[n].mode) for n in files} == want
        assert found["gone"].problem == "unreadable" and found["a.png"].bytes == len(files["a.png"])
    assert by_path["null"].problem == by_path["no such:thing"].problem == "unreadable"
    assert probe.valid_only(probe.probed(content)).count() == 3
    assert probe.probed(content.limit(0)).collect() == []


def test_files_are_written_and_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = [(f"d{k % 7}/f{k}.bin", bytearray(os.urandom(k))) for k in range(200)] + [("none", None), ("twice", b"1"), ("twice", b"2"), ("empty", b"")]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(6)
    file_sink.write_files(df.withColumn("extra", F.lit(1)), folder)
    got = file_sink.read_files(spark, folder).collect()
    assert sorted((r.name, bytes(r.content)) for r in got) == sorted((n, bytes(c)) for n, c in rows if c is not None)
    assert all(r.intact and r.sha256 == hashlib.sha256(r.content).hexdigest() and r.bytes == len(r.content) for r in got)
    first = file_sink.written_files(spark, folder).where("name = 'd1/f1.bin'").first().path
    open(first[7:], "wb").write(b"changed")
    assert [r.name for r in file_sink.read_files(spark, folder).where("not intact").collect()] == ["d1/f1.bin"]
    file_sink.write_files(df.where("name = 'twice'"), folder)
    assert file_sink.written_files(spark, folder).count() == 203 + 2
    file_sink.write_files(df.where("name = 'empty'"), folder, "overwrite")
    assert [r.name for r in file_sink.written_files(spark, folder).collect()] == ["empty"]
    file_sink.write_files(df.limit(0), folder, "overwrite")
    assert file_sink.written_files(spark, folder).collect() == [] == file_sink.read_files(spark, folder).collect()


def test_a_repeated_attempt_leaves_nothing(tmp_path, monkeypatch):
    """Two attempts of a task write; only the one that the commit names stays."""
    import pyarrow as pa

    class Context:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    writer = file_sink.FileWriter(f"file://{tmp_path}", False)
    batch = pa.RecordBatch.from_pydict({"name": ["a", "b/c"], "content": [b"1", b"2"]})
    messages = []
    for attempt in (1, 2):
        monkeypatch.setattr(file_sink.TaskContext, "get", staticmethod(lambda a=attempt: Context(a)))
        messages.append(writer.write(iter([batch])))
    other = file_sink.FileWriter(f"file://{tmp_path}", False)
    kept = other.write(iter([batch]))
    other.commit([kept])
    assert len(os.listdir(tmp_path)) == 3  # another write's commit leaves this one alone
    writer.commit([messages[1], None])
    assert sorted(os.listdir(tmp_path)) == sorted([messages[1].folder, kept.folder])
    writer.abort(messages)
    assert os.listdir(tmp_path) == [kept.folder]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("fine", b"1"), ("../out", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="no file can have the name"):
        file_sink.write_files(df, f"file://{tmp_path}/x")
    assert file_sink.written_files(spark, f"file://{tmp_path}/x").collect() == []


def drawn(spark, n):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        a = rng.integers(0, 256, (10 + k % 3, 12, 3)).astype(np.uint8)
        rows.append((k, ("o", a.shape[0], 12, 3, 16, bytearray(a[:, :, ::-1].tobytes())) if k % 5 else None if k else ("o", -1, -1, -1, -1, bytearray())))
    return spark.createDataFrame(rows, "id long, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"), rows


def rgb_of(image):
    return images.to_rgb(bytes(image[5]), image[1], image[2], image[3])


def test_sheets_and_figures_as_files(spark, tmp_path):
    df, rows = drawn(spark, 14)
    placed = pictures.numbered_sheets(df, F.lit("s"), F.col("id"), 6)
    sheets = {r.name: bytes(r.content) for r in pictures.contact_sheets(placed, 3, 2, 16, 16, 2).collect()}
    for k in range(3):
        cells = [rgb_of(i) if i and i[1] > 0 else np.full((1, 1, 3), 255, np.uint8) for _, i in rows[6 * k : 6 * k + 6]]
        assert sheets[f"s-{k:04d}.png"] == images.png(images.contact_sheet(cells, 3, 16, 16, 2))
    assert len(sheets) == 3
    with pytest.raises(Exception, match="no cell"):
        pictures.contact_sheets(placed.withColumn("cell", F.lit(6)), 3, 2).collect()
    box = F.array(F.struct(F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(8.0).alias("y2")))
    claims = df.select(F.col("id").alias("claim_id"), "image").withColumn("boxes", F.when(F.col("claim_id") != 3, box))
    folder = f"file://{tmp_path}/evidence"
    file_sink.write_files(pictures.evidence(claims), folder)
    read = {r.name: bytes(r.content) for r in file_sink.read_files(spark, folder).collect()}
    good = [(k, rgb_of(i)) for k, i in rows if i and i[1] > 0]
    assert read == {f"{k}/original.png": images.png(a) for k, a in good} | {f"{k}/annotated.png": images.png(images.with_boxes(a, [(1, 2, 9, 8)] if k != 3 else [])) for k, a in good}
    paths = {r.claim_id: r for r in pictures.evidence_paths(claims, file_sink.written_files(spark, folder)).collect()}
    assert len(paths) == 14 and {k for k, r in paths.items() if r.original and r.annotated} == {k for k, _ in good} and paths[0].original is None
    rng = np.random.default_rng(2)
    a, g = rng.random((2, 4, 4)).tolist(), rng.random((2, 4, 4)).tolist()
    cam = df.where("id = 1").select("image").crossJoin(spark.createDataFrame([(a, g, True), (a, g, False), (None, g, True)], "activations array<array<array<double>>>, gradients array<array<array<double>>>, fraud boolean"))
    got = [bytes(r.content) for r in pictures.activation_figures(cam, F.col("fraud")).orderBy("name").collect()]
    assert got == [images.png(images.cam_panels(rgb_of(rows[1][1]), np.array(a), np.array(g), f)) for f in (False, True)]


def test_model_files(spark, tmp_path):
    folder = f"file://{tmp_path}/models"
    one, two = scoring.ModelFile.publish(b"3", folder), scoring.ModelFile.publish(b"3", folder)
    assert one == two == scoring.ModelFile.at(one.path) and os.listdir(tmp_path / "models") == [f"{one.sha256}.model"]
    load = lambda content: lambda f: f["x"] * int(content)
    rows = spark.createDataFrame([(k, float(k)) for k in range(20)], "id long, x double")
    assert {r.id: r.prob for r in scoring.score_with_file(one, load, rows, ["id"]).collect()} == {k: 3.0 * k for k in range(20)}
    opened = []
    for _ in range(2):
        one.opened_from_path(lambda path: opened.append(open(path, "rb").read()) or "model")
    assert opened == [b"3"]
    with pytest.raises(FileNotFoundError):
        scoring.ModelFile.at(f"{folder}/none.model")
    open(one.path[7:], "wb").write(b"4")
    with pytest.raises(OSError, match="isn't the model"):
        one.fetch()
    head = training.Head({"scale": [1.0, 2.0], "shift": [0.0, 0.5], "weight": [1.0, -1.0], "bias": [0.25]})
    run = workspace.work_path(spark, "run")
    training.save_checkpoint(spark, head, {"epoch": 3, "f1": 0.5}, f"{run}/checkpoint")
    e = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "id long, embedding array<double>")
    again = scoring.score_with_file(training.publish_checkpoint(spark, f"{run}/checkpoint", run), training.scorer, e, ["id"])
    want = {r.id: r.prob for r in training.predict(e, head).collect()}
    assert {r.id: r.prob for r in again.collect()} == pytest.approx(want)
    with pytest.raises(FileNotFoundError):
        training.publish_checkpoint(spark, f"file://{tmp_path}", run)


def test_images_of_every_kind(spark, tmp_path):
    """Paths, pixel arrays and their shapes: grey is repeated, alpha goes, anything else is an error."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.png(a))
    (tmp_path / "b.png").write_bytes(b"none")
    df = spark.createDataFrame([(f"file:{tmp_path}/a.png",), (f"{tmp_path}/b.png",), (f"{tmp_path}/gone.png",), ("/no/folder/x.png",), (None,)], "p string")
    got = {r.p: r.image for r in images.image_of(df, paths="p").collect()}
    assert len(got) == 5 and [k for k, v in got.items() if v] == [f"file:{tmp_path}/a.png"]
    i = got[f"file:{tmp_path}/a.png"]
    assert (images.to_rgb(bytes(i.data), i.height, i.width, i.nChannels) == a).all()
    assert {r.image for r in images.image_of(df.where("p like '/no%'"), paths="p").collect()} == {None}
    back = lambda i: images.to_rgb(bytes(i.data), i.height, i.width, i.nChannels)
    colour = images.image_of(spark.createDataFrame([(a.tolist(),), (None,)], "x array<array<array<int>>>"), pixels="x").collect()
    assert (back(colour[0].image) == a).all() and colour[1].image is None
    grey = images.image_of(spark.createDataFrame([(a[:, :, 0].tolist(),)], "x array<array<int>>"), pixels="x").first().image
    assert (back(grey) == a[:, :, :1].repeat(3, 2)).all()
    with_alpha = np.concatenate([a, a[:, :, :1]], 2)
    assert (back(images.image_of(spark.createDataFrame([(with_alpha.tolist(),)], "x array<array<array<int>>>"), pixels="x").first().image) == a).all()
    with pytest.raises(TypeError):
        images.from_array(np.zeros((2, 2, 5)))
    for wrong in ({}, {"paths": "p", "pixels": "p"}, {"pixels": "p"}):
        with pytest.raises(TypeError):
            images.image_of(df, **wrong)


def test_reports_of_no_groups(spark, tmp_path):
    """Empty input has stated results: a CSV without rows and a report of zeros, flags that hold, splits of none."""
    from lenswright.operators import audit, damage, splits
    from lenswright.sources import files, sinks

    flags = "mixed_label boolean, cross_split boolean, train_test boolean, train_validation boolean, validation_test boolean"
    none = spark.createDataFrame([], f"group_number int, group_id long, priority int, images long, fraud long, splits string, labels string, {flags}")
    sinks.write_group_audit(none, f"file://{tmp_path}/x")
    assert files.csv_split(spark, f"file://{tmp_path}/x/groups", none.schema).collect() == []
    report = spark.read.json(f"file://{tmp_path}/x/report").first()
    assert report.total.asDict() == {"groups": 0, "images": 0, "fraud": 0} and set(report.flags.asDict().values()) == {0} and report.priorities == []
    rows = spark.createDataFrame([], "doc_id long, group_id long, label int, split string")
    checks = [audit.isolated(rows, k, raise_on_overlap=False) for k in ("group_id", "doc_id")]
    one = sinks.audit_row(splits.summary(rows, "group_id"), *checks).first()
    assert one.group_isolation_verified and one.path_isolation_verified
    mixed = spark.createDataFrame([(1, 1, 0, "train"), (2, 1, 0, "test")], rows.schema)
    checks = [audit.isolated(mixed, k, raise_on_overlap=False) for k in ("group_id", "doc_id")]
    one = sinks.audit_row(splits.summary(mixed, "group_id"), *checks).first()
    assert not one.group_isolation_verified and one.path_isolation_verified
    boxes = spark.createDataFrame([], "claim_id long, class_id int, severity_score double")
    claims = spark.createDataFrame([(1,)], "claim_id long")
    assert [tuple(r) for r in damage.overall(boxes, claims).select("damage_detected", "damage_count", "overall_severity_score", "overall_severity").collect()] == [(False, 0, 0.0, "No Damage Detected")]


def test_class_names_beyond_the_broadcast(spark, monkeypatch):
    from lenswright.operators import damage

    d = spark.createDataFrame([(1,), (2,)], "class_id int")
    names = spark.createDataFrame([(1, "dent")], "class_id int, name string")
    for most in (10, 0):
        monkeypatch.setattr(damage, "CLASSES", most)
        assert sorted(r.damage_type for r in damage.named(d, names).collect()) == ["class_2", "dent"]
