"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``, whatever extra
ones there are and however they are called.

Defined cases, for every stage: a null or empty text is scored like any other,
is a near-duplicate of nothing, holds no benchmark window and no personal data,
and is packed as its end id; a null doc_id counts as no label's and as the last
of its group; of repeated rows one stays where their text has words; an empty
table gives an empty one.  Only the personal-data stage changes a column that
it is given, text, and n_chars with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lenswright.llm import decontaminate, neardup, packing, pii, quality, tokens
from lenswright.llm.common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on ``docs``, whose extra columns go by plain names meanwhile and keep their own afterwards."""
    known = ("doc_id", "text", "n_chars")
    names = [c.lower() if c.lower() in known else f"extra_column_{k}" for k, c in enumerate(docs.columns)]
    out = stage(docs.toDF(*names))
    return out.select(*names).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, predicts to be good."""
    return _over(docs, lambda d: quality.classify(d, _table(spark, sf_dir, "labels")).where("predicted = 1"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 and up."""
    return _over(docs, lambda d: neardup.deduplicate(d, 80))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return _over(docs, lambda d: decontaminate.decontaminate(d, _table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return _over(docs, pii.redact)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of at most 4096 tokens."""
    packed = packing.pack(docs, tokens.default_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as a table and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
