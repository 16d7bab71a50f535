"""Claim reports: fraud and damage results of a claim in one nested row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import formatted

THRESHOLD = 0.30


def percent_text(x: Column, digits: int = 2) -> Column:
    return F.concat(formatted(x, digits), F.lit("%"))


def claim_id(key: Column, year: int) -> Column:
    """``CLM-year-nnnnn``, the digits from a hash of the key, so that a rerun gives the same."""
    return F.concat(F.lit(f"CLM-{year}-"), F.lpad((F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100000).cast("string"), 5, "0"))


def processing_id(key: Column) -> Column:
    return F.concat(F.lit("PRC-"), F.lpad((F.conv(F.substring(F.md5(F.concat(F.lit("p"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % 10000).cast("string"), 4, "0"))


def execution_time(ts: Column | None = None) -> Column:
    """A UTC time as the report prints it; the session's zone should be UTC."""
    return F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss 'UTC'")


def kilobytes(size: Column) -> Column:
    return size / F.lit(1024.0)


# The report's sentences, around a percentage.
FRAUD_SUMMARY = (
    "The model identified visual patterns consistent with the Fraud class at ",
    " probability. The Grad-CAM heatmap highlights the image regions that most strongly influenced this prediction — review these areas alongside the claim history before making a determination.",
)
CLEAR_SUMMARY = ("No strong fraud signal was detected. The model's non-fraud confidence is ", ". This result should still be treated as AI-assisted screening rather than a final decision.")


def summary_text(prediction: Column, prob: Column) -> Column:
    """The sentence that sums a claim up: the fraud probability, or how sure its absence is."""
    around = lambda text, x: F.concat(F.lit(text[0]), percent_text(x * 100.0, 1), F.lit(text[1]))
    return F.when(prediction == 1, around(FRAUD_SUMMARY, prob)).otherwise(around(CLEAR_SUMMARY, 1.0 - prob))


def report(fraud: DataFrame, damage: DataFrame, key: str = "claim_key") -> DataFrame:
    """Claims that have both results (a missing one means no report), fraud numbers in percent and damage as a struct."""
    both = fraud.join(damage, key)
    label = F.when(F.col("prediction") == 1, "Fraud").otherwise("Non-Fraud")
    fields = ["damage_detected", "damage_count", "damage_coverage_percentage", "overall_severity", "overall_severity_score", "detections"]
    return both.select(
        key, claim_id(F.col(key), 2024).alias("claim_id"), processing_id(F.col(key)).alias("processing_id"), label.alias("fraud_label"), (F.col("prob") * 100.0).alias("fraud_probability"), (F.col("confidence") * 100.0).alias("model_confidence"),
        summary_text(F.col("prediction"), F.col("prob")).alias("summary"), F.struct(*fields).alias("damage_result"),
    )
