"""Image operators at the Python boundary: decode results in, hashes and tensors out.

They read Spark's ``image`` source (BGR bytes, 1, 3 or 4 channels) and work on
Arrow batches with NumPy alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

# The input size and the normalisation of pretrained image models.
IMAGE_SIZE = 224
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3 RGB bytes: grey is repeated, alpha is dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    if channels not in (3, 4):
        raise TypeError(f"an image of {channels} channels")
    return a[:, :, 2::-1]


def from_array(pixels: list | np.ndarray) -> dict:
    """A grey (height x width), RGB or RGBA array of 0 to 255 as the image source's struct; other shapes are an error."""
    a = np.asarray(pixels)
    a = a[:, :, None] if a.ndim == 2 else a
    if a.ndim != 3 or a.shape[2] not in (1, 3, 4) or not a.size:
        raise TypeError(f"an image of the shape {a.shape}")
    a = np.clip(np.rint(a.astype(float)), 0, 255).astype(np.uint8)
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[a.shape[2]]
    return {"origin": "", "height": a.shape[0], "width": a.shape[1], "nChannels": a.shape[2], "mode": 8 * (a.shape[2] - 1), "data": a[:, :, order].tobytes()}


#: The image source's struct.
IMAGE = StructType([StructField("origin", StringType()), *(StructField(n, IntegerType()) for n in ("height", "width", "nChannels", "mode")), StructField("data", BinaryType())])


def image_of(df: DataFrame, paths: str | None = None, pixels: str | None = None) -> DataFrame:
    """``df`` with ``image`` from a column of paths (read by Spark's image source) or of nested pixel arrays.

    A path without a file, a file that is no picture and a null have a null image; an
    array of any other shape than a picture's is an error.
    """
    if (paths is None) == (pixels is None):
        raise TypeError("images come from paths or from pixels")
    if pixels is not None:
        kind = df.schema[pixels].dataType.simpleString()
        if not kind.startswith("array<array<"):
            raise TypeError(f"no image can be made of a column of {kind}")

        sides = (("origin", pa.string()), *((n, pa.int32()) for n in ("height", "width", "nChannels", "mode")), ("data", pa.binary()))

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [None if v is None else from_array(v) for v in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.struct(sides))], names=[*b.schema.names[:-1], "image"])

        rest = [f for f in df.schema.fields if f.name.lower() != "image"]
        schema = StructType([*rest, StructField("image", IMAGE)])
        names = ["`" + f.name.replace("`", "``") + "`" for f in rest]
        return df.select(*names, F.col(pixels).alias("_pixels")).mapInArrow(drawn, schema)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    folders = [r[0] for r in df.select(F.regexp_replace(paths, "/[^/]*$", "").alias("f")).where("f is not null").distinct().limit(FOLDERS + 1).collect()]
    if len(folders) > FOLDERS:
        raise ValueError(f"paths of more than {FOLDERS} folders; read their common root with sources.files.images and join")
    there = [f for f in folders if _exists(df.sparkSession, f)]
    if not there:
        return df.withColumn("image", F.lit(None).cast(IMAGE))
    read = df.sparkSession.read.format("image").option("dropInvalid", "true").load(there).select(plain(F.col("image.origin")).alias("_origin"), "image")
    return df.join(read, plain(F.col(paths)) == F.col("_origin"), "left").drop("_origin")


#: Folders that one call reads paths of.
FOLDERS = 1000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _weights(n_in: int, n_out: int) -> np.ndarray:
    """Triangle-filter resampling from ``n_in`` to ``n_out``, widened when shrinking so that nothing aliases."""
    scale = n_in / n_out
    reach = max(1.0, scale)
    centre = (np.arange(n_out) + 0.5) * scale
    w = np.maximum(0.0, 1.0 - np.abs((np.arange(n_in) + 0.5)[None, :] - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Antialiased bilinear resampling of a float image."""
    a = np.tensordot(_weights(a.shape[0], height), a.astype(float), (1, 0))
    return np.moveaxis(np.tensordot(_weights(a.shape[1], width), a, (1, 1)), 0, 1)


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


_DCT32 = _dct(32)


def phash(rgb: np.ndarray) -> int:
    """A signed 64-bit perceptual hash: which low frequencies of the 32 x 32 grey image exceed their median."""
    grey = np.rint(rgb.astype(float) @ (0.299, 0.587, 0.114))
    low = (_DCT32 @ resize(grey[:, :, None], 32, 32)[:, :, 0] @ _DCT32.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def with_phash(images: DataFrame, on_error: str = "null") -> DataFrame:
    """``images`` (the image source's struct ``image``) with ``hash``; undecodable rows have none, or are an error."""

    @F.pandas_udf(LongType())
    def hashed(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = [phash(to_rgb(d, h, w, c)) if w > 0 else None for d, h, w, c in zip(data, height, width, channels, strict=True)]
        return pd.Series(out, dtype="Int64")

    out = images.withColumn("hash", hashed("image.data", "image.height", "image.width", "image.nChannels"))
    if on_error == "raise":
        out = out.withColumn("hash", F.coalesce("hash", F.raise_error(F.concat(F.lit("cannot hash "), F.col("image.origin"))).cast("bigint")))
    return out


def eval_tensor(rgb: np.ndarray) -> np.ndarray:
    """The evaluation transform: resize, scale to 0..1, normalise; channels first, float32."""
    x = resize(rgb, IMAGE_SIZE, IMAGE_SIZE) / 255.0
    return ((x - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)


def train_tensor(rgb: np.ndarray, rng: np.random.Generator, blur: float = 0.0, erase: float = 0.0) -> np.ndarray:
    """The training transform: crop, flip, slight rotation, jitter, normalise; blur and erasing are optional."""
    # Shares of area, ratios, degrees and jitter of the transform that is to be matched.
    h, w = rgb.shape[:2]
    area, ratio = h * w * rng.uniform(0.90, 1.0), np.exp(rng.uniform(np.log(0.95), np.log(1.05)))
    ch, cw = min(h, max(1, round(np.sqrt(area / ratio)))), min(w, max(1, round(np.sqrt(area * ratio))))
    top, left = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
    x = resize(rgb[top : top + ch, left : left + cw], IMAGE_SIZE, IMAGE_SIZE) / 255.0
    if rng.random() < 0.5:
        x = x[:, ::-1]
    x = _rotated(x, np.deg2rad(rng.uniform(-8, 8)))
    for step in rng.permutation(4):
        grey = (x @ (0.299, 0.587, 0.114))[:, :, None]
        if step == 0:
            x = x * rng.uniform(0.85, 1.15)
        elif step == 1:
            x = grey.mean() + (x - grey.mean()) * rng.uniform(0.85, 1.15)
        elif step == 2:
            x = grey + (x - grey) * rng.uniform(0.90, 1.10)
        else:
            x = _hue(x, rng.uniform(-0.02, 0.02))
        x = np.clip(x, 0, 1)
    if rng.random() < blur:
        k = np.array([0.25, 0.5, 0.25])
        for axis in (0, 1):
            x = sum(wt * np.roll(x, s, axis) for wt, s in zip(k, (-1, 0, 1), strict=True))
    x = (x - MEAN) / STD
    if rng.random() < erase:
        eh, ew = (int(IMAGE_SIZE * rng.uniform(0.05, 0.2)) for _ in range(2))
        top, left = rng.integers(0, IMAGE_SIZE - eh), rng.integers(0, IMAGE_SIZE - ew)
        x[top : top + eh, left : left + ew] = 0
    return x.transpose(2, 0, 1).astype(np.float32)


def _rotated(x: np.ndarray, angle: float) -> np.ndarray:
    """Nearest-neighbour rotation about the centre, black outside."""
    n, m = x.shape[:2]
    yy, xx = np.mgrid[:n, :m] - np.array([(n - 1) / 2, (m - 1) / 2])[:, None, None]
    sy, sx = np.rint(yy * np.cos(angle) - xx * np.sin(angle) + (n - 1) / 2).astype(int), np.rint(yy * np.sin(angle) + xx * np.cos(angle) + (m - 1) / 2).astype(int)
    ok = (sy >= 0) & (sy < n) & (sx >= 0) & (sx < m)
    return np.where(ok[:, :, None], x[np.clip(sy, 0, n - 1), np.clip(sx, 0, m - 1)], 0.0)


def _hue(x: np.ndarray, turn: float) -> np.ndarray:
    """Turn the hue by a share of the circle, in the plane of equal luma."""
    to = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]])
    c, s = np.cos(2 * np.pi * turn), np.sin(2 * np.pi * turn)
    return x @ (np.linalg.inv(to) @ np.array([[1, 0, 0], [0, c, -s], [0, s, c]]) @ to).T


def tensors(images: DataFrame, training: bool = False, seed: int = 42) -> DataFrame:
    """(origin, tensor) of decodable images; a row's random choices depend on the seed and its origin only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for origin, data, h, w, c in zip(f["origin"], f["data"], f["height"], f["width"], f["nChannels"], strict=True):
                rgb = to_rgb(data, h, w, c)
                rng = np.random.default_rng([seed, *origin.encode()])
                out.append((train_tensor(rgb, rng) if training else eval_tensor(rgb)).ravel())
            yield pd.DataFrame({"origin": f["origin"], "tensor": out})

    flat = images.where("image.width > 0").select("image.origin", "image.data", "image.height", "image.width", "image.nChannels")
    return flat.mapInPandas(run, "origin string, tensor array<float>")


def thumbnail(rgb: np.ndarray, height: int, width: int, fill: int = 255) -> np.ndarray:
    """An image shrunk to fit a frame, never enlarged, and padded to it around the centre."""
    share = min(1.0, height / rgb.shape[0], width / rgb.shape[1])
    h, w = (max(1, round(n * share)) for n in rgb.shape[:2])
    small = rgb if share == 1.0 else np.clip(np.rint(resize(rgb, h, w)), 0, 255).astype(np.uint8)
    out = np.full((height, width, 3), fill, np.uint8)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = small
    return out


def contact_sheet(images: list[np.ndarray], columns: int, height: int, width: int, gap: int = 8) -> np.ndarray:
    """Thumbnails by rows on a white sheet."""
    rows = -(-len(images) // columns)
    sheet = np.full((gap + rows * (height + gap), gap + columns * (width + gap), 3), 255, np.uint8)
    for k, rgb in enumerate(images):
        y, x = gap + k // columns * (height + gap), gap + k % columns * (width + gap)
        sheet[y : y + height, x : x + width] = thumbnail(rgb, height, width)
    return sheet


def with_boxes(rgb: np.ndarray, boxes: list[tuple[float, float, float, float]], colour: tuple[int, int, int] = (255, 0, 0), line: int = 2) -> np.ndarray:
    """An image with the outlines of boxes; what lies outside is cut."""
    out, (h, w) = rgb.copy(), rgb.shape[:2]
    for x1, y1, x2, y2 in boxes:
        x1, x2 = (int(np.clip(round(v), 0, w)) for v in (x1, x2))
        y1, y2 = (int(np.clip(round(v), 0, h)) for v in (y1, y2))
        if x2 > x1 and y2 > y1:
            out[y1 : min(y1 + line, y2), x1:x2] = out[max(y2 - line, y1) : y2, x1:x2] = colour
            out[y1:y2, x1 : min(x1 + line, x2)] = out[y1:y2, max(x2 - line, x1) : x2] = colour
    return out


def cam_panels(rgb: np.ndarray, activations: np.ndarray, gradients: np.ndarray, fraud: bool, share: float = 0.4) -> np.ndarray:
    """Image, heat map and blend side by side; the logit's gradient counts for the class that was predicted."""
    heat = activation_map(activations, gradients if fraud else -gradients)
    return np.concatenate([rgb, blend(rgb, heat, 1.0), blend(rgb, heat, share)], 1)


def png(rgb: np.ndarray) -> bytes:
    """An RGB image as a PNG file."""
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def activation_map(activations: np.ndarray, gradients: np.ndarray) -> np.ndarray:
    """A class activation map: channels weighted by their mean gradient, rectified, scaled to 0..1 (all 0 stays 0)."""
    cam = np.maximum(0.0, np.tensordot(gradients.mean((1, 2)), activations, (0, 0)))
    cam = cam - cam.min()
    return cam / cam.max() if cam.max() > 0 else cam


def blend(rgb: np.ndarray, heat: np.ndarray, share: float = 0.4) -> np.ndarray:
    """An image under its heat map: blue to red by heat, mixed in by ``share``."""
    h = resize(heat[:, :, None], *rgb.shape[:2])
    colour = 255.0 * np.concatenate([np.clip(1.5 - np.abs(4 * h - k), 0, 1) for k in (3, 2, 1)], 2)
    return np.clip(np.rint((1 - share) * rgb + share * colour), 0, 255).astype(np.uint8)
