import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from lenswright.llm import warc

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, "http://c/", "é\r\n\r\nWARC/1.1\r\n"), (4, None, None), (5, "http://e/", ""), (6, "u", "y" * 200_000), (None, "u", "<p>x</p>"), (None, "v", "only here"), (2, "http://b/", "<p>x</p>")]
SCHEMA = "page_id long, url string, html string"


def _expected(rows):
    best = {}
    for i, _, h in rows:
        h = h or ""
        best[h] = max((x for x in (best.get(h), i) if x is not None), default=None)
    for i, _, h in rows:
        raw = (h or "").encode()
        first = best[h or ""]
        revisit = first is not None and first != i
        yield (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)


def test_round_trip(spark):
    got = warc.archive_digest(spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "'x' as body", "1 as digest")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _expected(PAGES)))


def test_small_payloads_stay_responses(spark):
    got = warc.archive_digest(spark.createDataFrame(PAGES, SCHEMA), min_bytes=9).collect()
    assert {r.record_type for r in got if r.payload_bytes < 9} == {"response"}


def test_empty_table(spark):
    assert warc.archive_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_packages_and_payloads(spark):
    rows = [(k, f"http://x/{k}", f"page {k} " * 300) for k in range(60)]
    manifest = warc.write_packages(spark.createDataFrame(rows, SCHEMA), package_bytes=2000)
    assert manifest.count() > 4
    back = {r.page_id: r for r in warc.read_packages(spark, manifest).collect()}
    assert {k: (r.url, bytes(r.payload).decode()) for k, r in back.items()} == {k: (u, h) for k, u, h in rows}


def _package(zip64, stored=True):
    out = io.BytesIO()
    raw = [warc.record(k, "http://x/", f"body {k}".encode(), None, False) for k in range(3)]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        z.comment = b"a comment PK"
        with z.open("archive/other.warc", "w", force_zip64=zip64) as f:
            f.write(b"".join(raw))
        z.writestr("pages/pages.jsonl", "{}")
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_foreign_packages_are_walked_through(tmp_path, spark, zip64):
    (tmp_path / "f.zip").write_bytes(_package(zip64))
    rows = warc.read_packages(spark, spark.createDataFrame([(f"file://{tmp_path}/f.zip",)], "package string")).collect()
    assert [(r.page_id, bytes(r.payload)) for r in sorted(rows, key=lambda r: r.page_id)] == [(k, f"body {k}".encode()) for k in range(3)]


def test_zip64_end_record_and_directory_fields():
    """A directory whose 32-bit fields are all ones, as in archives beyond 4 GB."""
    data = bytearray(_package(True))
    found = warc.members(pa.BufferReader(bytes(data)))
    end = data.rindex(b"PK\x05\x06")
    count, length, offset = (int.from_bytes(data[end + a : end + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
    directory = bytearray(data[offset : offset + length])
    # the first entry's sizes and offset move into a ZIP64 field
    n_name, n_extra = (int.from_bytes(directory[a : a + 2], "little") for a in (28, 30))
    packed, whole, local = (int.from_bytes(directory[a : a + 4], "little") for a in (20, 24, 42))
    field = b"\x01\x00\x18\x00" + whole.to_bytes(8, "little") + packed.to_bytes(8, "little") + local.to_bytes(8, "little")
    head = bytearray(directory[: 46 + n_name])
    head[20:28], head[42:46], head[30:32] = b"\xff" * 8, b"\xff" * 4, len(field).to_bytes(2, "little")
    directory = bytes(head) + field + bytes(directory[46 + n_name + n_extra :])
    end64 = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\x2d\x00\x2d\x00" + b"\0" * 8 + count.to_bytes(8, "little") * 2 + len(directory).to_bytes(8, "little") + offset.to_bytes(8, "little")
    at = offset + len(directory)
    locator = b"PK\x06\x07" + b"\0" * 4 + at.to_bytes(8, "little") + (1).to_bytes(4, "little")
    wide = bytes(data[:offset]) + directory + end64 + locator + b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 12 + b"\0\0"
    assert warc.members(pa.BufferReader(wide)) == found


def test_damage_is_noticed(tmp_path):
    with pytest.raises(ValueError):
        warc.members(pa.BufferReader(b"no package at all"))
    (tmp_path / "c.zip").write_bytes(_package(False, stored=False))
    with pytest.raises(ValueError, match="stored"):
        list(warc.locate(f"file://{tmp_path}/c.zip"))


def test_a_common_payload_can_be_split(spark, monkeypatch):
    """Beyond the broadcast's bound, adaptive execution marks the skew of a payload that most pages have."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000"}
    rows = spark.range(12_000).selectExpr("id as page_id", "'u' as url", "if(id % 4 > 0, 'the same page', if(id % 8 = 0, concat('own ', id), 'another')) as html").repartition(8)
    plans, old = [], {k: spark.conf.get(k, None) for k in settings}

    def seen(df, name):
        if name == "warc-manifest":
            df.cache().count()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    materialise = warc.materialise
    monkeypatch.setattr(warc, "materialise", seen)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = warc.archive_digest(rows).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plans[0]
    assert sum(r.refers_to == 11_999 for r in got) == 8999 and sum(r.record_type == "response" for r in got) == 2 + 1500
