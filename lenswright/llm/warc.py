"""WARC archives in ZIP packages: a writer, and a reader that extracts nothing.

A package is a ZIP file whose members are *stored*: ``archive/data.warc.gz``
(every record its own gzip member) and ``indexes/index.cdxj``.  The reader
parses the end record, the ZIP64 locator and directory where present, and the
central directory; finds where a stored member's bytes begin; reads the index;
and fetches records by byte ranges, so no member is ever unpacked to disk.

Defined cases: a null html is an empty payload; rows that repeat the largest
page_id of a payload are all responses; a null page_id is a revisit wherever a
row with an id has the same payload, else a response; an empty table gives no
package and no row.  Executors write under names of their own and a manifest
names the packages of the tasks that succeeded, so a rerun task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialise, small_batches, tidy, text_bytes, work_path

#: Payloads of at least so many bytes are deduplicated; smaller ones are all responses.
MIN_BYTES = 0
#: A package that has grown to so many bytes is closed and a new one begun.
PACKAGE_BYTES = 1 << 30
#: Neighbouring records are fetched together up to so many bytes, in chunks of so many.
RANGE_BYTES, CHUNK = 4 << 20, 1 << 16
#: The table has no capture time; records bear the epoch.
DATE = "1970-01-01T00:00:00Z"

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the ZIP format.
END, END64_LOCATOR, END64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"


# -- records ---------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with its HTTP block; a revisit holds no payload but its digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE, "WARC-Target-URI": (url or "").replace("\r", "").replace("\n", ""),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
        "Page-ID": "" if page_id is None else page_id,
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to), "Refers-To-Page-ID": refers_to}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """A parsed record; ``payload`` is None for a revisit."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What gzip members one after another hold; plain chunks as they are."""
    z, first, plain = None, True, False
    for chunk in chunks:
        if first and chunk:
            first, plain = False, chunk[:2] != b"\x1f\x8b"
        while chunk and not plain:
            z = z or zlib.decompressobj(31)
            yield z.decompress(chunk)
            chunk = z.unused_data  # no longer than a chunk
            z = None if z.eof else z
        if plain:
            yield chunk
    if z:
        raise ValueError("a gzip member of the archive is cut off")


def parse(raw: bytes | Iterable[bytes]) -> Iterator[Record]:
    """The records of a byte range, given whole or in chunks: gzip members one after another, or plain records.

    No more than a record and a chunk are held.
    """
    whole = memoryview(raw) if isinstance(raw, bytes) else None
    chunks = iter(_inflated(raw if whole is None else (bytes(whole[k : k + CHUNK]) for k in range(0, len(whole), CHUNK))))
    data = bytearray()

    def fill(n: int) -> bool:
        while len(data) < n and (more := next(chunks, None)) is not None:
            data.extend(more)
        return len(data) >= n

    while fill(5) and data[:5] == b"WARC/":
        end = data.find(b"\r\n\r\n")
        while end < 0 and fill(len(data) + 1):
            end = data.find(b"\r\n\r\n", max(0, len(data) - CHUNK - 4))
            end = data.find(b"\r\n\r\n") if end >= 0 else end
        if end < 0:
            raise ValueError("a record of the archive is cut off")
        headers = _fields(bytes(data[:end]))
        start, n = end + 4, int(headers["content-length"])
        if not fill(start + n):
            raise ValueError("a record of the archive is cut off")
        block = bytes(data[start : start + n])
        fill(start + n + 4)
        del data[: start + n + 4]
        head, _, body = block.partition(b"\r\n\r\n")
        yield Record(headers, _fields(head), None if headers["warc-type"] == "revisit" else body)


# -- writing ---------------------------------------------------------------

#: Tables of up to so many short rows are broadcast.
BROADCAST_ROWS = 200_000


class _Package:
    """A package being written, record by record."""

    def __init__(self, folder: str):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.zip"
        self.uri, self.at, self.index = f"{folder}/{name}", 0, []
        self.out = fs.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)

    def add(self, key: int | None, kind: str, raw: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = z.compress(raw) + z.flush()
        self.member.write(packed)
        self.index.append(f"{key} {DATE} " + json.dumps({"type": kind, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index) + "\n")
        self.zip.close()
        self.out.close()


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest (package, records, bytes).

    Of equal payloads the row with the largest page_id is stored.  That is an
    aggregation of digests, which combines before it shuffles.  Only digests that
    several rows have are kept, in a written table: while it is short, rows learn
    theirs by a broadcast and bodies aren't shuffled; beyond, by a join of two tables
    on the digest, whose hot keys adaptive execution can split.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or work_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_bytes("html").alias("body")).withColumn("digest", F.unhex(F.sha1("body")))
    same = rows.where(F.length("body") >= min_bytes).select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    best = materialise(same.where("n > 1").drop("n"), "repeated")
    rows = rows.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, "digest", "left").select("page_id", "url", "body", "first_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in batches:
            for page_id, url, body, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = bytes(body)
                revisit = first is not None and first != page_id and len(body) >= min_bytes
                package = package or _Package(folder)
                package.add(page_id, "revisit" if revisit else "response", record(page_id, url, body, first, revisit))
                if package.at >= package_bytes:
                    package.close()
                    done, package = [*done, package], None
        if package:
            package.close()
            done.append(package)
        yield pa.RecordBatch.from_arrays([pa.array([p.uri for p in done], pa.string()), pa.array([len(p.index) for p in done], pa.int64()), pa.array([p.at for p in done], pa.int64())], names=["package", "records", "bytes"])

    return materialise(rows.mapInArrow(tidy(write), "package string, records long, bytes long"), "warc-manifest")


# -- reading ---------------------------------------------------------------


@dataclass
class Member:
    """A member of a package; ``start`` is where its bytes begin in the file."""

    name: str
    method: int
    size: int
    start: int


def _read(f: pa.NativeFile, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the package is cut off")
    return data


def members(f: pa.NativeFile) -> list[Member]:
    """The members by the central directory, ZIP64 fields included; only directory bytes and local headers are read."""
    size = f.size()
    tail_at = max(0, size - 65557)
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, offset = struct.unpack_from("<10xHLL", tail, end)
    if end >= 20 and tail[end - 20 : end - 16] == END64_LOCATOR:
        (at,) = struct.unpack_from("<8xQ", tail, end - 20)
        wide = _read(f, at, 56)
        if wide[:4] != END64:
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, length, offset = struct.unpack_from("<32xQQQ", wide)
    directory, at, out = _read(f, offset, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, packed, whole, n_name, n_extra, n_note, local = struct.unpack_from("<10xH8xLLHHH8xL", directory, at)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # 64-bit values, in this order, of the fields that are all ones
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                whole, packed, local = (next(values) if v == 0xFFFFFFFF else v for v in (whole, packed, local))
            k += 4 + n
        head = _read(f, local, 30)
        if head[:4] != LOCAL:
            raise ValueError("a local header is damaged")
        out.append(Member(name, method, packed, local + 30 + sum(struct.unpack_from("<26xHH", head))))
        at += 46 + n_name + n_extra + n_note
    return out


def _chunks(f: pa.NativeFile, start: int, length: int) -> Iterator[bytes]:
    """The bytes of a range, a chunk after another."""
    for at in range(0, length, CHUNK):
        yield f.read_at(min(CHUNK, length - at), start + at)


def locate(uri: str) -> Iterator[tuple[str, int, int]]:
    """Byte ranges (package, start, length) of whole records, neighbours together."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        found = members(f)
        archives = [m for m in found if m.name.startswith("archive/") and (m.name.endswith((".warc", ".warc.gz")))]
        if any(m.method for m in archives):
            raise ValueError(f"{uri}: archive members must be stored, not compressed")
        index = next((m for m in found if m.name == INDEX and not m.method), None)
        for m in archives:
            if m.name != ARCHIVE or not index:  # without an index of ours: one range to walk through
                yield uri, m.start, m.size
                continue
            spots = [json.loads(line.split(b" ", 2)[2]) for line in _read(f, index.start, index.size).splitlines() if line]
            begin = end = 0
            for spot in sorted(spots, key=lambda s: s["offset"]):
                if spot["offset"] != end or end - begin >= RANGE_BYTES:
                    if end > begin:
                        yield uri, m.start + begin, end - begin
                    begin = spot["offset"]
                end = spot["offset"] + spot["length"]
            if end > begin:
                yield uri, m.start + begin, end - begin


def read_packages(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """The records of the packages named in column ``package``, by range reads.

    One row per record: page_id, url, record_type, refers_to, payload (null for
    a revisit), payload_bytes and payload_digest.  A stored payload's length
    and digest are recomputed and must match its headers.
    """
    small_batches(spark)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for uri in b.column(0).to_pylist() for r in locate(uri)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["package", "start", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    out, size = [], 0
                    for r in parse(_chunks(f, start, length)):
                        digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
                        n = int(r.http.get("content-length", 0))
                        if r.payload is not None and (len(r.payload) != n or base32_sha1(r.payload) != digest):
                            raise ValueError(f"{uri}: the payload of {r.headers['warc-record-id']} doesn't match its digest")
                        out.append((number(r.headers.get("page-id")), r.headers["warc-target-uri"], r.headers["warc-type"], number(r.headers.get("refers-to-page-id")), r.payload, n, digest))
                        size += len(r.payload or b"") + 200
                        if size >= RANGE_BYTES:
                            yield batch(out)
                            out, size = [], 0
                    yield batch(out)

    def number(v: str | None) -> int | None:
        return int(v) if v else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])

    parallel = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spots = packages.select("package").repartition(parallel).mapInArrow(tidy(ranges), "package string, start long, length long")
    return spots.repartition(parallel).mapInArrow(tidy(records), "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archive_digest(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives, read them back, and say what each record holds."""
    manifest = write_packages(pages, min_bytes=min_bytes)
    return read_packages(pages.sparkSession, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
