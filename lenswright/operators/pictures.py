"""Pictures as rows (name, content) for the file sink: contact sheets, annotated images, activation panels, evidence.

Images come as the image source's struct.  A sheet is drawn by one task and holds
at most ``columns * rows`` pictures; more go onto the next sheet.  Other pictures are
drawn row by row.  An image that can't be decoded leaves its cell white, or has no file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import by_merge
from .images import cam_panels, contact_sheet, png, to_rgb, with_boxes

FILE = "name string, content binary"


def _rgb(image: dict | None) -> np.ndarray | None:
    """A decoded image of the image source, or None."""
    if image is None or image["width"] is None or image["width"] <= 0:
        return None
    return to_rgb(image["data"], image["height"], image["width"], image["nChannels"])


def numbered_sheets(images: DataFrame, group: Column, place: Column, per_sheet: int) -> DataFrame:
    """``images`` with ``sheet`` (a name) and ``cell`` in it, where ``place`` numbers a group's pictures from 0."""
    number = F.format_string("%s-%04d.png", group, F.floor(place / per_sheet).cast("long"))
    return images.withColumns({"sheet": number, "cell": (place % per_sheet).cast("int")})


def contact_sheets(placed: DataFrame, columns: int = 3, rows: int = 4, height: int = 180, width: int = 220, gap: int = 8) -> DataFrame:
    """A PNG for each ``sheet`` of ``placed`` (sheet, cell, image), pictures by cell."""
    most = columns * rows

    def draw(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pictures: list[np.ndarray | None] = [None] * (1 + max(t.column("cell").to_pylist()))
        for cell, image in zip(t.column("cell").to_pylist(), t.column("image").to_pylist(), strict=True):
            pictures[cell] = _rgb(image)
        blank = np.full((1, 1, 3), 255, np.uint8)
        sheet = contact_sheet([blank if p is None else p for p in pictures], columns, height, width, gap)
        return pa.table({"name": pa.array([key[0].as_py()], pa.string()), "content": pa.array([png(sheet)], pa.binary())})

    cells = placed.select("sheet", "cell", "image")
    wrong = F.col("cell").isNull() | ~F.col("cell").between(0, most - 1)
    checked = cells.withColumn("cell", F.when(wrong, F.raise_error(F.concat(F.lit("no cell for a picture of "), "sheet"))).otherwise(F.col("cell")).cast("int"))
    return checked.groupBy("sheet").applyInArrow(draw, FILE)


def annotated(images: DataFrame, name: Column) -> DataFrame:
    """A PNG of each image with its ``boxes`` (an array of x1, y1, x2, y2; null: none) outlined."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for image, boxes in zip(b.column("image").to_pylist(), b.column("boxes").to_pylist(), strict=True):
                rgb = _rgb(image)
                files.append(None if rgb is None else png(with_boxes(rgb, [(x["x1"], x["y1"], x["x2"], x["y2"]) for x in boxes or []])))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(files, pa.binary())], names=["name", "content"])

    return images.select(name.cast("string").alias("name"), "image", "boxes").mapInArrow(draw, FILE).where("content is not null")


def activation_figures(images: DataFrame, name: Column, share: float = 0.4) -> DataFrame:
    """A PNG of image, heat map and blend for each row (image, activations, gradients: arrays by channel, row and column; fraud)."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cube = lambda x: np.array([[list(row) for row in channel] for channel in x], float)
        for f in frames:
            files = []
            for image, a, g, fraud in zip(f["image"], f["activations"], f["gradients"], f["fraud"], strict=True):
                rgb = _rgb(image)
                files.append(None if rgb is None or a is None or g is None else png(cam_panels(rgb, cube(a), cube(g), bool(fraud), share)))
            yield pd.DataFrame({"name": f["name"], "content": files})

    return images.select(name.cast("string").alias("name"), "image", "activations", "gradients", "fraud").mapInPandas(draw, FILE).where("content is not null")


def evidence(claims: DataFrame) -> DataFrame:
    """Two files a claim (claim_id, image, boxes): the original and the annotated picture, in the claim's folder."""
    folder = lambda leaf: F.concat(F.col("claim_id").cast("string"), F.lit(f"/{leaf}"))
    original = annotated(claims.withColumn("boxes", F.lit(None).cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")), folder("original.png"))
    return original.unionByName(annotated(claims, folder("annotated.png")))


def evidence_paths(claims: DataFrame, written: DataFrame) -> DataFrame:
    """claim_id with the paths of its original and annotated picture; null where no file was written."""
    leaf = F.substring_index("name", "/", -1)
    by = written.select(F.regexp_replace("name", "/[^/]*$", "").alias("k"), F.when(leaf == "original.png", F.col("path")).alias("o"), F.when(leaf == "annotated.png", F.col("path")).alias("a"))
    paths = by.groupBy("k").agg(F.max("o").alias("original"), F.max("a").alias("annotated"))
    return claims.select("claim_id").distinct().join(by_merge(paths), F.col("claim_id").cast("string") == F.col("k"), "left").drop("k")
