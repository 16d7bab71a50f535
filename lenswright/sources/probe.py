"""What picture files say of themselves: format, size, mode and whether they are whole, from their structure.

Nothing is decoded.  A walk goes from header to header of a file's chunks and
reads only those, by ranges; so a file costs a few kilobytes however large it
is.  It covers PNG, JPEG, GIF, WebP, BMP and TIFF.

Defined cases: an empty file, an unknown or truncated one and one that can't be
read is not valid, with the reason in ``problem`` and null sizes and mode; a
null content counts as one that can't be read; a suffix that isn't the format's
makes a file ``renamed``, which does not make it invalid.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .file_sink import store

Read = Callable[[int, int], bytes]

# Suffixes by format; modes by PNG colour type, by JPEG and TIFF components.
SUFFIXES = {"PNG": (".png",), "JPEG": (".jpg", ".jpeg"), "GIF": (".gif",), "WEBP": (".webp",), "BMP": (".bmp",), "TIFF": (".tif", ".tiff")}
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
COMPONENTS = {1: "L", 3: "RGB", 4: "CMYK"}
#: Bytes that are fetched at once, and headers that are looked at in one file.
WINDOW, MOST_PARTS = 4096, 1_000_000


class Probe(NamedTuple):
    format: str | None = None
    width: int | None = None
    height: int | None = None
    mode: str | None = None
    problem: str | None = None


class Broken(Exception):
    """A file that isn't what its beginning says."""


class _Bytes:
    """A file's bytes through a window; a read past its end is what makes it truncated."""

    def __init__(self, read: Read, size: int) -> None:
        self.read, self.size, self.at, self.held = read, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise Broken("truncated")
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.read(at, max(n, min(WINDOW, self.size - at)))
            if len(self.held) < n:
                raise Broken("truncated")
        return self.held[at - self.at : at - self.at + n]

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self.get(at, struct.calcsize(form)))


def _png(f: _Bytes) -> Probe:
    (length, kind), end = f.unpack(">I4s", 8), False
    if kind != b"IHDR" or length != 13:
        raise Broken("no header")
    head, (crc,) = f.get(16, 13), f.unpack(">I", 29)
    if zlib.crc32(kind + head) != crc:
        raise Broken("bad checksum")
    width, height, depth, colour = struct.unpack(">IIBB", head[:10])
    if colour not in PNG_MODES or not width or not height:
        raise Broken("bad header")
    at, data = 33, False
    for _ in range(MOST_PARTS):
        length, kind = f.unpack(">I4s", at)
        f.get(at + 8 + length, 4)
        data, end = data or kind == b"IDAT", kind == b"IEND"
        if end:
            break
        at += 12 + length
    if not end or not data:
        raise Broken("no data" if end else "truncated")
    mode = {1: "1", 16: "I;16"}.get(depth, "L") if colour == 0 else PNG_MODES[colour]
    return Probe("PNG", width, height, mode)


def _jpeg(f: _Bytes) -> Probe:
    at, found = 2, None
    for _ in range(MOST_PARTS):
        mark, kind = f.unpack("BB", at)
        if mark != 0xFF:
            raise Broken("bad marker")
        if kind == 0xFF:  # a fill byte
            at += 1
            continue
        if kind in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        if kind == 0xD9:
            raise Broken("no data")
        (length,) = f.unpack(">H", at + 2)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            _, height, width, parts = f.unpack(">BHHB", at + 4)
            if parts not in COMPONENTS or not width or not height:
                raise Broken("bad header")
            found = Probe("JPEG", width, height, COMPONENTS[parts])
        f.get(at + 2 + length - 1, 1)
        at += 2 + length
        if kind == 0xDA:
            break
    if found is None:
        raise Broken("no header")
    tail = f.get(max(at, f.size - 1024), f.size - max(at, f.size - 1024))
    if b"\xff\xd9" not in tail:
        raise Broken("truncated")
    return found


def _gif(f: _Bytes) -> Probe:
    width, height, flags = f.unpack("<HHB", 6)
    at, pictures = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0

    def blocks(at: int) -> int:
        while n := f.get(at, 1)[0]:
            at += 1 + n
        return at + 1

    for _ in range(MOST_PARTS):
        kind = f.get(at, 1)[0]
        if kind == 0x3B:
            break
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C:
            local = f.get(at + 9, 1)[0]
            at = blocks(at + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1)
            pictures += 1
        else:
            raise Broken("bad block")
    if not pictures or not width or not height:
        raise Broken("no data")
    return Probe("GIF", width, height, "P")


def _webp(f: _Bytes) -> Probe:
    (size,) = f.unpack("<I", 4)
    if size + 8 > f.size:
        raise Broken("truncated")
    kind = f.get(12, 4)
    if kind == b"VP8X":
        flags, sides = f.get(20, 1)[0], f.get(24, 6)
        found = Probe("WEBP", 1 + int.from_bytes(sides[:3], "little"), 1 + int.from_bytes(sides[3:], "little"), "RGBA" if flags & 0x10 else "RGB")
    elif kind == b"VP8L":
        if f.get(20, 1) != b"\x2f":
            raise Broken("bad header")
        (packed,) = f.unpack("<I", 21)
        found = Probe("WEBP", 1 + (packed & 0x3FFF), 1 + (packed >> 14 & 0x3FFF), "RGBA" if packed >> 28 & 1 else "RGB")
    elif kind == b"VP8 ":
        if f.get(23, 3) != b"\x9d\x01\x2a":
            raise Broken("bad header")
        width, height = f.unpack("<HH", 26)
        found = Probe("WEBP", width & 0x3FFF, height & 0x3FFF, "RGB")
    else:
        raise Broken("bad header")
    at, picture = 12, False
    while at < size + 8:
        kind, length = f.unpack("<4sI", at)
        picture = picture or kind in (b"VP8 ", b"VP8L", b"ANMF")
        at += 8 + length + length % 2
        if at > size + 8 + 1:
            raise Broken("truncated")
    if not picture:
        raise Broken("no data")
    return found


def _bmp(f: _Bytes) -> Probe:
    begin, head, width, height, _, depth = f.unpack("<IIiiHH", 10)
    if head < 40 or width <= 0 or not height or depth not in (1, 4, 8, 16, 24, 32):
        raise Broken("bad header")
    (packed,) = f.unpack("<I", 30)
    if packed in (0, 3) and begin + (width * depth + 31) // 32 * 4 * abs(height) > f.size:
        raise Broken("truncated")
    return Probe("BMP", width, abs(height), {1: "1", 4: "P", 8: "P", 32: "RGBA" if packed == 3 else "RGB"}.get(depth, "RGB"))


def _tiff(f: _Bytes) -> Probe:
    order = "<" if f.get(0, 2) == b"II" else ">"
    (at,) = f.unpack(order + "I", 4)
    (entries,) = f.unpack(order + "H", at)
    tags = {}

    def values(kind: int, n: int, spot: int) -> list[int]:
        form = {3: "H", 4: "I"}.get(kind)
        if form is None or n > 1 << 20:
            return []
        spot = spot if n * struct.calcsize(form) <= 4 else f.unpack(order + "I", spot)[0]
        return list(f.unpack(f"{order}{n}{form}", spot))

    for k in range(entries):
        tag, kind, n = f.unpack(order + "HHI", at + 2 + 12 * k)
        if tag in (256, 257, 258, 262, 273, 277, 279, 324, 325):
            tags[tag] = values(kind, n, at + 2 + 12 * k + 8)
    first = lambda tag, other: (tags.get(tag) or [other])[0]
    width, height = first(256, 0), first(257, 0)
    if not width or not height:
        raise Broken("bad header")
    places, sizes = tags.get(273) or tags.get(324) or [], tags.get(279) or tags.get(325) or []
    if not places:
        raise Broken("no data")
    if any(p + s > f.size for p, s in zip(places, sizes, strict=False)):
        raise Broken("truncated")
    parts, depth, colour = first(277, 1), first(258, 1), first(262, 1)
    mode = "P" if colour == 3 else "CMYK" if colour == 5 else {1: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "LA", 3: "RGB", 4: "RGBA"}.get(parts, "RGB")
    return Probe("TIFF", width, height, mode)


def _walk(f: _Bytes) -> tuple[str | None, Callable[[_Bytes], Probe] | None]:
    head = f.get(0, min(f.size, 16))
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG", _png
    if head[:3] == b"\xff\xd8\xff":
        return "JPEG", _jpeg
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF", _gif
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "WEBP", _webp
    if head[:2] == b"BM":
        return "BMP", _bmp
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "TIFF", _tiff
    return None, None


def probe(read: Read, size: int) -> Probe:
    """What a file of ``size`` bytes, of which ``read`` gives some from a place on, says of itself."""
    if not size:
        return Probe(problem="empty")
    f, kind = _Bytes(read, size), None
    try:
        kind, walk = _walk(f)
        return walk(f) if walk else Probe(problem="unknown format")
    except (Broken, struct.error) as e:
        return Probe(kind, problem=str(e) if isinstance(e, Broken) else "truncated")


_SCHEMA = "path string, bytes long, format string, width int, height int, mode string, problem string"


def _flagged(found: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    right = F.lit(False)
    for kind, names in SUFFIXES.items():
        right = right | ((F.col("format") == kind) & suffix.isin(*names))
    return found.withColumns({"valid": F.col("problem").isNull(), "renamed": F.col("format").isNotNull() & ~right})


def _batch(paths: list[str], sizes: list[int | None], probes: list[Probe]) -> pa.RecordBatch:
    columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), *(pa.array([p[k] for p in probes], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())))]
    return pa.RecordBatch.from_arrays(columns, names=["path", "bytes", "format", "width", "height", "mode", "problem"])


def probed(files: DataFrame) -> DataFrame:
    """path, bytes, format, width, height, mode, problem, valid and renamed of files (path, content) that Spark has read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = [memoryview(c.as_buffer()) if c.is_valid else None for c in b.column(1)]
            probes = [Probe(problem="unreadable") if v is None else probe(lambda at, n, v=v: bytes(v[at : at + n]), len(v)) for v in views]
            yield _batch(b.column(0).to_pylist(), [None if v is None else len(v) for v in views], probes)

    return _flagged(files.select("path", "content").mapInArrow(work, _SCHEMA))


def probed_paths(paths: DataFrame) -> DataFrame:
    """The same of files (path), by range reads from where they lie; their bodies are never read whole."""

    def one(path: str | None) -> tuple[int | None, Probe]:
        try:
            fs, where = store(path)
            with fs.open_input_file(where) as f:
                return f.size(), probe(lambda at, n: f.read_at(n, at), f.size())
        except (OSError, TypeError, AttributeError, pa.ArrowInvalid):
            return None, Probe(problem="unreadable")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            found = [one(p) for p in names]
            yield _batch(names, [n for n, _ in found], [p for _, p in found])

    return _flagged(paths.select("path").mapInArrow(work, _SCHEMA))


def valid_only(probes: DataFrame) -> DataFrame:
    """The files that are whole pictures."""
    return probes.where("valid")
