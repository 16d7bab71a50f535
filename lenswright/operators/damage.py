"""Box scoring, severities and exact union coverage of detected damage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import python_int, python_round
from ..plans.workspace import materialise

# Knots of the area score, and the score labels' upper bounds.
AREA_KNOTS = [(0.0, 0.0), (2.0, 25.0), (8.0, 50.0), (20.0, 80.0), (40.0, 90.0)]
SEVERITIES = [(25.0, "Low"), (50.0, "Moderate"), (75.0, "High")]
TOP_SEVERITY, NO_DAMAGE = "Severe", "No Damage Detected"
AREA_SHARE, CONFIDENCE_SHARE, BONUS, MOST_BONUS = 0.9, 10.0, 3, 15
MIN_CONFIDENCE, MAX_OVERLAP = 0.25, 0.45
#: Class names of a detector that are broadcast.
CLASSES = 10_000


def severity(score: Column) -> Column:
    """The label of a score, by strict upper bounds on the unrounded value."""
    out = F.when(score < SEVERITIES[0][0], SEVERITIES[0][1])
    for bound, name in SEVERITIES[1:]:
        out = out.when(score < bound, name)
    return out.otherwise(TOP_SEVERITY)


def area_percentage(box_area: Column, image_area: Column) -> Column:
    return F.when(image_area > 0, box_area / image_area * F.lit(100.0)).otherwise(F.lit(0.0))


def area_score(area: Column) -> Column:
    knots = AREA_KNOTS
    out = F.lit(knots[-2][1]) + F.least(area - F.lit(knots[-2][0]), F.lit(20.0)) / F.lit(20.0) * F.lit(10.0)
    for (x0, y0), (x1, y1) in reversed(list(zip(knots[:-2], knots[1:-1], strict=True))):
        out = F.when(area <= x1, (F.lit(y0) + (area - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0)) if x0 else area / F.lit(x1) * F.lit(y1)).otherwise(out)
    return out


def box_score(area: Column, confidence: Column) -> Column:
    raw = area_score(area) * F.lit(AREA_SHARE) + confidence * F.lit(CONFIDENCE_SHARE)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))


def scored_boxes(boxes: DataFrame) -> DataFrame:
    """Rounded detections of ``boxes`` (claim_id, class_id, conf, x1, y1, x2, y2, w, h), with a running number a claim."""
    width, height = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    df = boxes.withColumn("area", area_percentage(width * height, (F.col("w") * F.col("h")).cast("double")))
    df = df.withColumn("raw_score", box_score(F.col("area"), F.col("conf")))
    w = Window.partitionBy("claim_id").orderBy("x1", "y1", "x2", "y2", "conf", "class_id")
    return df.select(
        "claim_id", F.row_number().over(w).alias("box_no"), "class_id", python_round(F.col("conf"), 4).alias("confidence"), *(python_round(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")),
        python_round(F.col("area")).alias("area_percentage"), severity(F.col("raw_score")).alias("severity"), python_round(F.col("raw_score")).alias("severity_score"), "w", "h",
    )


def named(detections: DataFrame, names: DataFrame) -> DataFrame:
    """``damage_type`` by class id from ``names`` (class_id, name), a table of a detector's classes; unknown ids get a made-up name."""
    few = names.limit(CLASSES + 1).count() <= CLASSES
    return detections.join(F.broadcast(names) if few else names, "class_id", "left").withColumn("damage_type", F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))).drop("name")


def overall(detections: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Per claim: the worst rounded score, a bonus for further boxes, and its label; claims without boxes come from ``claims``."""
    n = F.count("*")
    out = detections.groupBy("claim_id").agg(n.alias("damage_count"), F.max("severity_score").alias("worst"))
    total = F.least(F.col("worst") + F.least((F.col("damage_count") - 1) * BONUS, F.lit(MOST_BONUS)), F.lit(100.0))
    out = out.select("claim_id", "damage_count", python_round(total).alias("overall_severity_score"), severity(total).alias("overall_severity"))
    if claims is not None:
        out = claims.select("claim_id").distinct().join(out, "claim_id", "left")
    return out.select("claim_id", (F.coalesce("damage_count", F.lit(0)) > 0).alias("damage_detected"), F.coalesce("damage_count", F.lit(0)).cast("long").alias("damage_count"), F.coalesce("overall_severity_score", F.lit(0.0)).alias("overall_severity_score"), F.coalesce("overall_severity", F.lit(NO_DAMAGE)).alias("overall_severity"))


def coverage(detections: DataFrame) -> DataFrame:
    """Per claim: pixels covered by at least one rounded, clamped box, and their share in percent.

    Vertical slabs between neighbouring edges, and in each slab the union of
    intervals by a running maximum: exact, without a pixel mask.
    """
    clamp = lambda c, most: F.least(F.greatest(python_int(F.col(c)), F.lit(0)), most)
    w, h = F.col("w").cast("int"), F.col("h").cast("int")
    boxes = detections.select("claim_id", "w", "h", clamp("x1", w - 1).alias("x1"), clamp("y1", h - 1).alias("y1"), clamp("x2", w).alias("x2"), clamp("y2", h).alias("y2")).where("x2 > x1 and y2 > y1")
    edges = boxes.select("claim_id", F.explode(F.array("x1", "x2")).alias("xa")).distinct()
    slabs = edges.withColumn("xb", F.lead("xa").over(Window.partitionBy("claim_id").orderBy("xa"))).where("xb is not null")
    inside = slabs.join(boxes.select("claim_id", "x1", "x2", "y1", "y2"), "claim_id").where("x1 <= xa and x2 >= xb")
    reached = F.max("y2").over(Window.partitionBy("claim_id", "xa").orderBy("y1", "y2").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("y2") - F.greatest(F.col("y1"), F.coalesce(reached, F.col("y1")))) * (F.col("xb") - F.col("xa"))
    pixels = inside.select("claim_id", added.alias("n")).groupBy("claim_id").agg(F.sum("n").cast("long").alias("pixels"))
    sizes = detections.groupBy("claim_id").agg((F.first("w").cast("long") * F.first("h")).alias("image"))
    share = python_round(F.coalesce("pixels", F.lit(0)) / F.col("image") * F.lit(100.0))
    return sizes.join(pixels, "claim_id", "left").select("claim_id", F.coalesce("pixels", F.lit(0)).cast("long").alias("covered_pixels"), F.when(F.col("image") > 0, share).otherwise(F.lit(0.0)).alias("damage_coverage_percentage"))


def nested(detections: DataFrame) -> DataFrame:
    """Per claim: its detections as an array of structs, in detector order."""
    one = F.struct("box_no", "damage_type", "confidence", F.array("x1", "y1", "x2", "y2").alias("bounding_box"), "area_percentage", "severity", "severity_score")
    rows = detections.groupBy("claim_id").agg(F.sort_array(F.collect_list(one)).alias("d"))
    return rows.select("claim_id", F.transform("d", lambda x: x.dropFields("box_no")).alias("detections"))


def suppress(boxes: DataFrame, min_confidence: float = MIN_CONFIDENCE, max_overlap: float = MAX_OVERLAP) -> DataFrame:
    """Greedy non-maximum suppression by claim and class, of boxes confident enough.

    An image's boxes of one class, which a detector bounds, travel as one row;
    Python sees rows in Arrow batches and returns the places of those kept.
    """
    columns = [c for c in boxes.columns if c not in ("claim_id", "class_id")]
    one = F.struct((-F.col("conf")).alias("order"), "x1", "y1", "x2", "y2", *(F.col(c).alias(f"_{c}") for c in columns))
    groups = boxes.where(F.col("conf") >= min_confidence).groupBy("claim_id", "class_id").agg(F.sort_array(F.collect_list(one)).alias("b"))

    @F.pandas_udf("array<int>")
    def kept(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        return pd.Series([_greedy(*(np.asarray(v, float) for v in row), max_overlap) for row in zip(x1, y1, x2, y2, strict=True)])

    places = groups.withColumn("k", F.explode(kept("b.x1", "b.y1", "b.x2", "b.y2")))
    found = places.select("claim_id", "class_id", F.get("b", F.col("k")).alias("b"))
    return found.select("claim_id", "class_id", *(F.col(f"b._{c}").alias(c) for c in columns)).select(*boxes.columns)


def _greedy(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, most: float) -> list[int]:
    """Places of the boxes, best first, that overlap no better one kept by more than ``most`` of their union."""
    area = np.maximum(0, x2 - x1) * np.maximum(0, y2 - y1)
    out: list[int] = []
    for k in range(len(x1)):
        both = np.maximum(0, np.minimum(x2[out], x2[k]) - np.maximum(x1[out], x1[k])) * np.maximum(0, np.minimum(y2[out], y2[k]) - np.maximum(y1[out], y1[k]))
        if not (both > most * (area[out] + area[k] - both)).any():
            out.append(k)
    return out


def boxes_from(detect, images: DataFrame, schema: str) -> DataFrame:
    """Boxes by a user's ``detect(frames of images) -> frames of boxes``; it loads its weights once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from detect(frames)

    return images.mapInPandas(run, schema)


def predict(images: DataFrame, detect, names: DataFrame, schema: str = "claim_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, w int, h int") -> DataFrame:
    """From images (claim_id, image) to a row a claim: overall severity, coverage and nested detections.

    ``detect`` is as in :func:`boxes_from`.  A claim without a box that stays has
    no damage, coverage 0 and no detections; a class id without a name gets one.
    Detections are written once, as three aggregations read them.
    """
    found = materialise(named(scored_boxes(suppress(boxes_from(detect, images, schema))), names), "detections")
    out = overall(found, images).join(coverage(found).drop("covered_pixels"), "claim_id", "left").join(nested(found), "claim_id", "left")
    none = F.array().cast(nested(found).schema["detections"].dataType)
    return out.withColumns({"damage_coverage_percentage": F.coalesce("damage_coverage_percentage", F.lit(0.0)), "detections": F.coalesce("detections", none)})
