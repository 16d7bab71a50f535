"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting grows shallow trees, one feature at a time, on binned features;
what each feature's trees add up to is a lookup table per bin.  The strongest
pairs get two-dimensional tables in the same way.  A text's score is the
logistic of a sum of table entries, computed for whole batches at once.

Defined cases: a null text is the empty text; an empty text has all features 0
and a score; repeated rows get equal scores; without labelled rows each score
is 0.5; several labels of one document count as their mean, 0.5 and up as 1.
A column of ``docs`` named like an added one is replaced.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import id_crc32, release, small_batches, text_bytes, tidy, without

#: At most so many labelled rows are fitted on, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: From this score on a document is predicted to be good.
THRESHOLD = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "repeated_neighbours", "upper", "digit", "common_marks",
    "rare_marks", "exclamations", "bars", "white", "not_ascii", "log_lines", "distinct_lines", "compression", "marks_per_word",
)

_COMMON = np.zeros(256, bool)
_COMMON[list(b".,;:'\"()?-")] = True
_RARE = np.zeros(256, bool)
_RARE[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True


def text_features(text: bytes) -> list[float]:
    """The features of one whole UTF-8 text, none of them its label, source or language."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    k = max(1, len(words))
    lines = text.split(b"\n")
    letters = int(hist[65:91].sum() + hist[97:123].sum())
    rare = int(hist[_RARE].sum())
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        sum(map(len, words)) / k,
        len(set(words)) / k,
        sum(map(operator.eq, words, words[1:])) / k,
        int(hist[65:91].sum()) / max(1, letters),
        int(hist[48:58].sum()) / n,
        int(hist[_COMMON].sum()) / n,
        rare / n,
        int(hist[33]) / n,
        int(hist[124]) / n,
        int(hist[32] + hist[9:14].sum()) / n,
        int(hist[128:].sum()) / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / n,
        (rare + int(hist[33])) / k,
    ]


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables by feature, and tables by pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, k], side="right")]
        if self.pairs:
            coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for k in {i for a, b, _ in self.pairs for i in (a, b)}}
            for a, b, t in self.pairs:
                out += t[coarse[a], coarse[b]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    return g * g / (h + reg)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """A shallow regression tree over ordered bins: the best cuts, one after another; its value by bin."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p in parts:
            a, b = p
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gains = _gain(cg[:-1], ch[:-1], reg) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], reg) - _gain(cg[-1], ch[-1], reg)
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], p, a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + reg)
    return out


def _cross(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid, one on either axis: its gain and the four leaves' values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = []
    for c in (cg, ch):
        a, row, col, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        quads.append((a, row - a, col - a, whole - row - col + a))
    gains = sum(_gain(x, y, reg) for x, y in zip(*quads, strict=True))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for x, y, at in zip(*quads, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        out[at] = x[i, j] / (y[i, j] + reg)
    return float(gains[i, j] - _gain(cg[-1, -1], ch[-1, -1], reg)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, pair_bins: int = 12, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, leaves: int = 4, reg: float = 2.0) -> AdditiveModel:
    """Boost tables for ``y`` (0 or 1) from features ``x``; the same rows give the same model."""
    n, m = x.shape
    model = AdditiveModel(base=float(np.log((y.sum() + 1) / (n - y.sum() + 1))))
    if not n:
        return model
    quantiles = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
    model.edges = [quantiles(x[:, k], bins) for k in range(m)]
    model.pair_edges = [quantiles(x[:, k], pair_bins) for k in range(m)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    f = np.full(n, model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k in range(m):
            g, h = gradients()
            step = rate * _tree(np.bincount(at[k], g, len(model.tables[k])), np.bincount(at[k], h, len(model.tables[k])), leaves, reg)
            model.tables[k] += step
            f += step[at[k]]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * size[b] + coarse[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = gradients()
    ranked = sorted(((_cross(grid(a, b, g), grid(a, b, h), reg)[0], a, b) for a, b in combinations(range(m), 2) if size[a] > 1 and size[b] > 1), reverse=True)
    model.pairs = [(a, b, np.zeros((size[a], size[b]))) for _, a, b in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = gradients()
            step = rate * _cross(grid(a, b, g), grid(a, b, h), reg)[1]
            table += step
            f += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fit on at most ``fit_rows`` labelled documents whose crc32(doc_id) mod 4 is not 2.

    The bounded set of label rows is broadcast; only features come to the driver.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_crc32() % 4 != 2))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    rows = docs.select("doc_id", text_bytes().alias("body")).join(F.broadcast(known), "doc_id").select("doc_id", "y", "body")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [text_features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    table = rows.mapInArrow(tidy(features), "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, table["doc_id"].to_numpy()))  # equal ids: any order gives one model
    x, y = x[order], table["y"].to_numpy().astype(float)[order]
    del table
    model = fit(x, y)
    release()
    return model


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    docs = without(docs, "held_out", "score", "predicted")
    n = len(docs.columns)
    rows = docs.withColumn("held_out", id_crc32() % 4 == 2)
    schema = StructType([*docs.schema.fields, StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    at = [c.lower() for c in docs.columns].index("text")
    names = [f.name for f in schema]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(at).cast(pa.large_binary()).to_pylist()
            s = model.scores(np.array([text_features(t or b"") for t in texts], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n + 1)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    return rows.mapInArrow(tidy(scored), schema)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all of them."""
    return score(docs, train(docs, labels, fit_rows), threshold)
