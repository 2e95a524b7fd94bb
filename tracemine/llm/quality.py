"""Quality classifier: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracemine.llm.common import cut, empty_if_null, held_out

#: Labelled documents that a model is fitted on, about (a hash of doc_id picks them): the bound of what is broadcast and kept.
TRAIN_DOCS = 50_000
#: Random features, width of the Gaussian kernel per square root of a statistic, ridge, bins of raw scores for calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 1.0, 1e-3, 500
#: Documents below this score are rejected.
ACCEPT = 0.7

#: The classes of ASCII characters whose shares are statistics.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?'\"()-", "!", "#$%&*+/<=>@[\\]^_`{}~", "|", " ", "\n\t\r\x0b\x0c")
_CLASS = np.zeros((256, len(CLASSES) + 1))
for _i, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars], _i] = 1
_CLASS[128:, len(CLASSES)] = 1
STATISTICS = len(CLASSES) + 1 + 8


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; those of an empty one are zero."""
    if not text:
        return [0.0] * STATISTICS
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = (np.bincount(raw, minlength=256) @ _CLASS / len(raw)).tolist()
    parts = text.split()
    n = max(1, len(parts))
    seen = Counter(parts)
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, parts[1:], parts)) / n
    return [
        *shares, float(np.log1p(len(parts))), len(raw) / n, len(seen) / n, float(np.log1p(len(seen)) / np.log1p(n)), same,
        max(seen.values(), default=0) / n, len(set(lines)) / max(1, len(lines)), float(np.log1p(len(lines))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    fit: np.ndarray
    #: Calibration: raw scores, and the scores at these; linear between them.
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.scale @ self.weights + self.phases) * np.sqrt(2 / self.weights.shape[1])
        return np.concatenate((z, np.ones((len(x), 1))), axis=1)

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.fit

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(x), self.raw, self.calibrated)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y by weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, k in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _sample(labels: DataFrame, train_docs: int) -> DataFrame:
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    n = known.count()
    return known if n <= train_docs else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_docs / n * (1 << 30)))


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("y"), b.column("fold"), x], names=["y", "fold", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 7) -> Model:
    """Fits a model of label 1 on about ``train_docs`` labelled documents that are not held out.

    Half of the folds (crc32(doc_id) mod 4 of 0 and 1) give the ridge fit, the third one the calibration. Each partition sends its sums
    of the normal equations, whose rows are added up in Spark; the driver gets one matrix of FEATURES squared and BINS counts. Labels
    other than 0 and 1 are ignored, as are labels without a document; without any label all documents score 0.5.
    """
    sample = _sample(labels.select("doc_id", "quality"), train_docs)
    rows = docs.select("doc_id", empty_if_null("text").alias("text")).join(F.broadcast(sample), "doc_id").select("y", (F.crc32(F.col("doc_id").cast("string")) % 4).cast("int").alias("fold"), "text")
    data = cut(rows.mapInArrow(_statistic_rows, "y int, fold int, x array<double>"))
    moments = data.agg(*[f(F.col("x")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(seed)
    none = moments[0] is None
    mean, scale = (np.zeros(STATISTICS), np.ones(STATISTICS)) if none else (np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-6))
    model = Model(mean, scale, rng.normal(0, 1 / (WIDTH * np.sqrt(STATISTICS)), (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.append(np.zeros(FEATURES), 0.5), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if none:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = shared.value.features(_matrix(b.column("x"))) if len(b) else np.zeros((0, FEATURES + 1))
            total += z.T @ np.concatenate((z, b.column("y").to_numpy()[:, None]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), _matrix(b.column("row")) if len(b) else (), strict=True):
                total[i] = total.get(i, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])

    kind = "i long, row array<double>"
    equations = data.where("fold < 2").mapInArrow(sums, kind).repartition("i").mapInArrow(added, kind).toArrow().sort_by("i")
    m = np.array(equations["row"].to_pylist()).reshape(FEATURES + 1, FEATURES + 2)
    n = max(1.0, m[-1, -2])
    model.fit = np.linalg.solve(m[:, :-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), m[:, -1])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = shared.value.raw_scores(_matrix(b.column("x"))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("fold"), pa.array(np.clip(np.round(raw * BINS), -BINS, 2 * BINS).astype(np.int64))], names=["y", "fold", "bin"])

    bins = data.mapInArrow(binned, "y int, fold int, bin long").groupBy("bin", (F.col("fold") == 3).alias("third")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas()
    bins = (bins[bins.third] if bins.third.any() else bins).groupby("bin", as_index=False)[["n", "y"]].sum().sort_values("bin")
    model.raw = bins["bin"].to_numpy() / BINS
    model.calibrated = np.clip(isotonic((bins["y"] / bins["n"]).to_numpy(), bins["n"].to_numpy()), 0, 1)
    return model


def scorer(docs: DataFrame, model: Model):
    """A function of a text column that gives its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.array([statistics(t or "") for t in texts]).reshape(-1, STATISTICS)))

    return score


def quality(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """One row per document: ``doc_id``, ``score`` (0 to 1, rounded to 9 places), ``predicted`` (1 if score >= accept). Null texts count as empty, and are scored like others.

    Rows that repeat are scored alike and each kept, also without a doc_id; other columns are ignored, whatever their names; an empty table gives an empty result. Of labels that differ for one doc_id the largest counts.
    """
    scored = docs.select("doc_id", scorer(docs, model)(empty_if_null("text")).alias("s")).select("doc_id", F.round("s", 9).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that score ``accept`` at least, with all their columns."""
    return docs.withColumn("__score", F.round(scorer(docs, model)(empty_if_null("text")), 9)).where(F.col("__score") >= accept).drop("__score")
