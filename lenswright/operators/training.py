"""Training of a classifier head on embeddings: epochs of shuffled mini-batches, validation, a two-stage schedule, checkpoints.

The head is a layer norm with scale and shift, then a linear layer to one
logit.  Training rows stand in a store by position.  An epoch is one barrier
stage that reads it once: a seeded permutation gives every row its batch, each
worker goes through its rows batch by batch, and after each batch the workers' sums of
gradients are added, in the shared folder, and all take the same step.  So an epoch gives
what one process would that reads the same batches in a row.  A worker holds a batch's
share of rows and the parameters; a lost one restarts the stage, with the same result.
Rows without label or embedding are left out; an empty table leaves the
parameters as they are.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import materialise, work_path
from ..sources.file_sink import store as file_store
from ..sources.positions import BATCH, RowStore
from ..sources.sinks import write_report
from .metrics import metric_bundle
from .scoring import ModelFile

# Epochs and learning rates of the two stages, weight decay.
STAGES = ((5, 1e-3, False), (15, 1e-5, True))
WEIGHT_DECAY = 1e-4
#: Rows of a batch that a worker has at least (about): with fewer, adding up the workers' sums takes longer than making them.
WORKER_ROWS = 8


@dataclass
class Head:
    """Parameters and the optimiser's moments by name."""

    parameters: dict[str, list[float]]
    first: dict[str, list[float]] = field(default_factory=dict)
    second: dict[str, list[float]] = field(default_factory=dict)
    steps: int = 0

    @classmethod
    def new(cls, size: int) -> Head:
        return cls({"scale": [1.0] * size, "shift": [0.0] * size, "weight": [0.0] * size, "bias": [0.0]})

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(v) for k, v in self.parameters.items()}


def parameter_counts(head: Head, all_layers: bool = True) -> dict[str, int]:
    """How many parameters there are, and how many of them a stage trains."""
    sizes = {k: len(v) for k, v in head.parameters.items()}
    return {"total": sum(sizes.values()), "trainable": sum(n for k, n in sizes.items() if all_layers or k in ("weight", "bias"))}


def _normed(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(1, keepdims=True)
    return x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-6)


def _logits(p: dict[str, np.ndarray], z: np.ndarray) -> np.ndarray:
    return (z * p["scale"] + p["shift"]) @ p["weight"] + p["bias"][0]


def _usable(rows: DataFrame, label: str, embedding: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull() & F.col(embedding).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(embedding).cast("array<double>").alias("x"))


def summed(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """By row, the probability and the binary cross-entropy; and the summed gradients."""
    z = _normed(x)
    logit = _logits(p, z)
    prob = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    d = prob - y
    sums = {"scale": (d @ z) * p["weight"], "shift": d.sum() * p["weight"], "weight": d @ (z * p["scale"] + p["shift"]), "bias": d.sum(keepdims=True)}
    return prob, np.logaddexp(0, logit) - y * logit, sums


def _step(head: Head, sums: dict[str, np.ndarray], n: int, rate: float, names: tuple[str, ...]) -> None:
    """Adam with decoupled weight decay on the named parameters."""
    head.steps += 1
    for k in names:
        g, w = sums[k] / n, np.array(head.parameters[k])
        m = 0.9 * np.array(head.first.get(k, np.zeros_like(g))) + 0.1 * g
        v = 0.999 * np.array(head.second.get(k, np.zeros_like(g))) + 0.001 * g * g
        w = w * (1 - rate * WEIGHT_DECAY) - rate * (m / (1 - 0.9**head.steps)) / (np.sqrt(v / (1 - 0.999**head.steps)) + 1e-8)
        head.parameters[k], head.first[k], head.second[k] = w.tolist(), m.tolist(), v.tolist()


def training_rows(rows: DataFrame, label: str = "label", embedding: str = "embedding", folder: str | None = None) -> RowStore:
    """The usable rows (y, x) of a table as a store by position, in the shared folder unless another is given."""
    return RowStore.write(_usable(rows, label, embedding), folder or work_path(rows.sparkSession, "training-rows"))


def _by_batch(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows (batch, y, x) of a partition, which ascend by batch, as one pair of arrays (x, y) for each of all steps."""
    held: list[tuple[int, list[float], float]] = []
    rows = ((k, x, y) for b in batches for k, y, x in zip(*(b.column(c).to_pylist() for c in ("batch", "y", "x")), strict=True))
    ahead = next(rows, None)
    for step in range(steps):
        while ahead is not None and ahead[0] == step:
            held.append(ahead)
            ahead = next(rows, None)
        yield np.array([x for _, x, _ in held], float), np.array([y for _, _, y in held], float)
        held.clear()


class Exchange:
    """Sums of small arrays over the workers of a barrier stage, through files of the shared folder.

    Every worker puts its array down; the first one adds them in the workers'
    order and puts down the total, which the others wait for.  A step's files go two
    steps later, when all have read them.
    """

    def __init__(self, folder: str, worker: int, workers: int) -> None:
        self.fs, self.folder = file_store(folder)
        self.worker, self.workers, self.step, self.own = worker, workers, 0, []
        self.fs.create_dir(self.folder, recursive=True)

    def _put(self, name: str, data: bytes) -> None:
        path = f"{self.folder}/{name}"
        with self.fs.open_output_stream(f"{path}.part") as out:
            out.write(data)
        self.fs.move(f"{path}.part", path)
        self.own.append((self.step, path))

    def _get(self, name: str) -> np.ndarray:
        path, pause = f"{self.folder}/{name}", 0.0005
        while self.fs.get_file_info(path).type == pafs.FileType.NotFound:  # a worker that is lost ends the stage, and this wait
            time.sleep(pause)
            pause = min(1.25 * pause, 0.05)
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read())

    def total(self, mine: np.ndarray) -> np.ndarray:
        """The sum of what all workers bring to this step."""
        if self.workers == 1:
            return mine
        if self.worker:
            self._put(f"{self.step}-{self.worker}", mine.tobytes())
            out = self._get(f"{self.step}-total")
        else:
            out = mine.copy()
            for k in range(1, self.workers):
                out = out + self._get(f"{self.step}-{k}")
            self._put(f"{self.step}-total", out.tobytes())
        while self.own and self.own[0][0] <= self.step - 2:
            self.fs.delete_file(self.own.pop(0)[1])
        self.step += 1
        return out


def _slots(spark: SparkSession) -> int:
    """How many tasks the session runs at a time, as a barrier stage needs them all at once."""
    context = spark.sparkContext._jsc.sc()
    return max(1, min(spark.sparkContext.defaultParallelism, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())))


def train_one_epoch(store: RowStore, head: Head, rate: float, all_layers: bool, size: int = BATCH, seed: int = 42, workers: int | None = None) -> DataFrame:
    """One pass over ``store`` in shuffled batches of ``size``: step, label, prob and loss of every row as its batch met it.

    ``head`` is brought up to date.  There are as many workers as the session runs
    tasks at a time, but no more than have ``WORKER_ROWS`` of a batch, or as ``workers`` says.
    """
    spark, steps = store.spark, store.batches(size)
    workers = workers or min(_slots(spark), -(-size // WORKER_ROWS))
    names = tuple(head.parameters) if all_layers else ("weight", "bias")
    begin, exchanges = json.dumps(asdict(head)), work_path(spark, "sums")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        run = context.allGather(uuid.uuid4().hex)  # the first worker's word names this attempt of the stage
        exchange = Exchange(f"{exchanges}/{run[0]}", context.partitionId(), len(run))
        own = Head(**json.loads(begin))
        width = {k: len(v) for k, v in own.parameters.items()}
        for step, (x, y) in enumerate(_by_batch(batches, steps)):
            p = own.arrays()
            prob, loss, sums = summed(p, x, y) if len(y) else (y, y, {k: np.zeros(n) for k, n in width.items()})
            total = exchange.total(np.concatenate([[len(y)], *(sums[k] for k in width)]))
            cuts = np.cumsum([1, *width.values()])
            _step(own, {k: total[a:b] for k, a, b in zip(width, cuts, cuts[1:])}, int(total[0]), rate, names)
            yield pa.RecordBatch.from_arrays([pa.array([step] * len(y), pa.int64()), pa.array(y), pa.array(prob), pa.array(loss), pa.nulls(len(y), pa.string())], names=["step", "label", "prob", "loss", "head"])
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * 3, pa.array([json.dumps(asdict(own))])], names=["step", "label", "prob", "loss", "head"])

    dealt = store.batched(size, seed).select("batch", "place", "y", "x").repartition(workers, "batch", "place").sortWithinPartitions("batch", "place")
    log = materialise(dealt.mapInArrow(work, "step long, label double, prob double, loss double, head string", barrier=True), "epoch")
    if len(store):
        after = Head(**json.loads(log.where("head is not null").first().head))
        head.parameters, head.first, head.second, head.steps = after.parameters, after.first, after.second, after.steps
    return log.where("head is null").select("step", F.col("label").cast("int").alias("label"), "prob", "loss")


def step_losses(log: DataFrame) -> DataFrame:
    """step, n and mean loss of each batch of an epoch."""
    return log.groupBy("step").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"))


def epoch_metrics(log: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """The epoch's mean loss, and the metrics bundle of what its batches predicted before each step."""
    loss = log.agg(F.avg("loss")).first()[0]
    return {"train_loss": 0.0 if loss is None else loss, **{f"train_{k}": v for k, v in metric_bundle(log, threshold).first().asDict().items()}}


def predict(rows: DataFrame, head: Head, embedding: str = "embedding") -> DataFrame:
    """``rows`` with ``prob``; null where there is no embedding."""
    p = head.arrays()

    @F.pandas_udf("double")
    def prob(x):
        known = x.notna().to_numpy()
        out = np.full(len(x), np.nan)
        if known.any():
            out[known] = 1 / (1 + np.exp(-np.clip(_logits(p, _normed(np.array(x[known].tolist(), float))), -60, 60)))
        return type(x)(out).astype(object).where(known, None)

    return rows.withColumn("prob", prob(F.col(embedding).cast("array<double>")))


def validate(rows: DataFrame, head: Head, threshold: float = 0.5, label: str = "label", embedding: str = "embedding") -> dict[str, float]:
    """The metrics bundle of a head on labelled rows."""
    scored = predict(rows, head, embedding).select(F.col(label).cast("int").alias("label"), "prob")
    return metric_bundle(scored, threshold).first().asDict()


def fit_two_stages(spark: SparkSession, train: DataFrame, validation: DataFrame, width: int, folder: str | None = None, stages: tuple = STAGES, size: int = BATCH, seed: int = 42) -> tuple[Head, list[dict]]:
    """The head first, then all layers at a rate that falls by a cosine; keeps the epoch of the best f1.

    Every epoch has its own order of the rows.  Given a ``folder``, the best epoch's
    checkpoint and the run's metrics are written there.
    """
    head, best, history, store = Head.new(width), None, [], training_rows(train)
    for epochs, rate, all_layers in stages:
        for k in range(epochs):
            now = rate * (1 + math.cos(math.pi * k / epochs)) / 2 if all_layers else rate
            log = train_one_epoch(store, head, now, all_layers, size, seed + len(history))
            found = validate(validation, head)
            history.append({"epoch": len(history) + 1, "rate": now, **epoch_metrics(log), **found})
            if best is None or found["f1"] > best[1]["f1"]:
                best = (Head(**json.loads(json.dumps(asdict(head)))), history[-1])
                if folder:
                    save_checkpoint(spark, best[0], best[1], f"{folder}/checkpoint")
    if folder and best:
        write_metrics(spark, history, best[1], parameter_counts(head), f"{folder}/metrics")
    return best[0] if best else head, history


def save_checkpoint(spark: SparkSession, head: Head, metrics: dict, path: str) -> None:
    """The epoch, the parameters, the optimiser's state and the validation metrics, as one JSON row."""
    row = {"epoch": metrics["epoch"], "head": json.dumps(asdict(head)), "metrics": json.dumps(metrics)}
    write_report(spark.createDataFrame([tuple(row.values())], "epoch long, head string, metrics string"), path)


def load_checkpoint(spark: SparkSession, path: str) -> tuple[Head, dict]:
    row = spark.read.schema("epoch long, head string, metrics string").json(path).first()
    if row is None:
        raise FileNotFoundError(path)
    return Head(**json.loads(row["head"])), json.loads(row["metrics"])


def scorer(content: bytes) -> Callable[[pd.DataFrame], pd.Series]:
    """A checkpoint's bytes as a model for ``scoring.score_with_file``: embeddings to probabilities."""
    head = Head(**json.loads(json.loads(content)["head"]))
    p = head.arrays()

    def prob(f: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(_logits(p, _normed(np.array(f["embedding"].tolist(), float))), -60, 60))))

    return prob


def publish_checkpoint(spark: SparkSession, path: str, folder: str) -> ModelFile:
    """A saved checkpoint as a model file that executors open."""
    row = spark.read.schema("epoch long, head string, metrics string").json(path).first()
    if row is None:
        raise FileNotFoundError(path)
    return ModelFile.publish(json.dumps(row.asDict()).encode(), folder)


def write_metrics(spark: SparkSession, history: list[dict], best: dict, counts: dict[str, int], path: str) -> None:
    """The run's metrics report: every epoch, the best one, and the parameter counts."""
    row = (json.dumps(history), best["epoch"], float(best["f1"]), counts["total"], counts["trainable"])
    write_report(spark.createDataFrame([row], "history string, best_epoch long, best_f1 double, parameters long, trainable_parameters long"), path)
