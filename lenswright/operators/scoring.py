"""Model scoring: a user's model by batches, and a trainable stand-in on embeddings."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.file_sink import store

#: Models that a worker has open, by digest; it keeps the last few.
_OPEN: dict[str, object] = {}
OPEN_MODELS = 2


@dataclass(frozen=True)
class ModelFile:
    """A model's file of any format, in a store that all executors see, under its content's digest."""

    path: str
    sha256: str

    @classmethod
    def publish(cls, content: bytes, folder: str) -> ModelFile:
        """Put a model's bytes below ``folder`` under a name that follows from them; publishing twice changes nothing."""
        digest = hashlib.sha256(content).hexdigest()
        fs, where = store(f"{folder}/{digest}.model")
        if fs.get_file_info(where).type == pafs.FileType.NotFound:
            fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{where}.{os.getpid()}") as out:
                out.write(content)
            fs.move(f"{where}.{os.getpid()}", where)
        return cls(f"{folder}/{digest}.model", digest)

    @classmethod
    def at(cls, path: str) -> ModelFile:
        """A file that stands somewhere already; a missing one is an error."""
        fs, where = store(path)
        if fs.get_file_info(where).type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        with fs.open_input_file(where) as f:
            return cls(path, hashlib.sha256(f.read()).hexdigest())

    def fetch(self) -> bytes:
        fs, where = store(self.path)
        with fs.open_input_file(where) as f:
            content = f.read()
        if hashlib.sha256(content).hexdigest() != self.sha256:
            raise OSError(f"{self.path} isn't the model that was published")
        return content

    def opened(self, load: Callable[[bytes], object]) -> object:
        """The model, fetched and opened by ``load`` once a worker process."""
        if self.sha256 not in _OPEN:
            while len(_OPEN) >= OPEN_MODELS:
                del _OPEN[next(iter(_OPEN))]
            _OPEN[self.sha256] = load(self.fetch())
        return _OPEN[self.sha256]

    def opened_from_path(self, load: Callable[[str], object]) -> object:
        """The same for libraries that only open files by path: the bytes stand in a temporary file meanwhile."""

        def through_a_file(content: bytes) -> object:
            with tempfile.NamedTemporaryFile(suffix=".model") as f:
                f.write(content)
                f.flush()
                return load(f.name)

        return self.opened(through_a_file)


def score_with_file(model: ModelFile, load: Callable[[bytes], Callable[[pd.DataFrame], pd.Series]], rows: DataFrame, keep: list[str], failed: str = "null") -> DataFrame:
    """``score_with`` a published model: only its path and digest travel with the plan."""
    return score_with(lambda: model.opened(load), rows, keep, failed)


def score_with(load: Callable[[], Callable[[pd.DataFrame], pd.Series]], rows: DataFrame, keep: list[str], failed: str = "null") -> DataFrame:
    """``keep`` columns and ``prob`` by a model that ``load`` opens once a task.

    A batch that fails is scored row by row; rows that still fail have a null
    ``prob``, or are dropped or an error, as ``failed`` says.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            try:
                prob = model(f).astype(float).to_numpy()
            except Exception:
                if failed == "raise":
                    raise
                prob = [_one(model, f.iloc[k : k + 1]) for k in range(len(f))]
            yield f[keep].assign(prob=prob)

    schema = ", ".join(f"{n} {t}" for n, t in rows.select(*keep).dtypes) + ", prob double"
    out = rows.mapInPandas(run, schema)
    return out.where(F.col("prob").isNotNull()) if failed == "drop" else out


def _one(model: Callable[[pd.DataFrame], pd.Series], row: pd.DataFrame) -> float | None:
    try:
        return float(model(row).iloc[0])
    except Exception:
        return None


def embedding_classifier(train: DataFrame, rows: DataFrame, label: str = "label", embedding: str = "embedding", positive: int = 1) -> DataFrame:
    """Fit a logistic regression on embeddings, and give ``rows`` the probability of the positive label."""
    features = lambda df: df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    model = LogisticRegression(featuresCol="features", labelCol="y", maxIter=50, regParam=0.01).fit(features(train).withColumn("y", (F.col(label) == positive).cast("double")))
    scored = model.transform(features(rows))
    return scored.withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
