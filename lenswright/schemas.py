"""Explicit schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("label", T.IntegerType(), False), T.StructField("class_name", T.StringType())])
SPLIT = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("label", T.IntegerType(), False)])
MANIFEST = T.StructType([*SPLIT.fields, T.StructField("group_id", T.LongType()), T.StructField("old_split", T.StringType())])
EDA_RECORD = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("split", T.StringType()), ("class", T.StringType()), ("valid", T.BooleanType()), ("width", T.IntegerType()), ("height", T.IntegerType()))])
SCORES = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("prob", T.DoubleType())])
DETECTION = T.StructType([
    T.StructField("damage_type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bounding_box", T.ArrayType(T.DoubleType())),
    T.StructField("area_percentage", T.DoubleType()), T.StructField("severity", T.StringType()), T.StructField("severity_score", T.DoubleType()),
])
DAMAGE = T.StructType([
    T.StructField("damage_detected", T.BooleanType()), T.StructField("damage_count", T.LongType()), T.StructField("damage_coverage_percentage", T.DoubleType()),
    T.StructField("overall_severity", T.StringType()), T.StructField("overall_severity_score", T.DoubleType()), T.StructField("detections", T.ArrayType(DETECTION)),
])
EXPLANATION = T.StructType([T.StructField(n, t) for n, t in (("image", T.StringType()), ("prediction", T.IntegerType()), ("predicted_class", T.StringType()), ("fraud_probability", T.DoubleType()), ("confidence", T.DoubleType()), ("threshold", T.DoubleType()), ("gradcam_path", T.StringType()))])
