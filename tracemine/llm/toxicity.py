"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import cut, empty_if_null, held_out

#: Labelled documents that a model is fitted on, about (a hash of doc_id picks them); features; documents that a feature must occur in.
TRAIN_DOCS, FEATURES, LEAST_DOCS = 20_000, 1024, 4
#: Steps of the fit, its ridge, and partitions of the bounded training table.
STEPS, RIDGE, PARTS = 30, 1e-3, 12
#: Lengths of the stems that are features beside whole words; the one by which words mark toxicity.
STEMS, MARKED = (4, 5, 6), 5
#: A stem marks toxicity if this share of the training documents with it is toxic; derived grades count such words, up to GRADES.
MARK, GRADES = 0.8, 3
FLAG = 0.5

TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    #: Feature of each word; weights of the features; increasing thresholds between the grades.
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, counts: list[dict[int, int]]) -> np.ndarray:
        """P(grade > k) by text and threshold k."""
        s = np.array([sum(self.weights[i] * np.log1p(n) for i, n in c.items()) for c in counts])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -500, 500)))


def tokens(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return TOKEN.findall(text.lower())


def features(word: str) -> list[str]:
    """The word, and its first letters where it has more."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def counted(text: str, vocabulary: dict[str, int], known: dict[str, list[int]]) -> dict[int, int]:
    """How often each feature occurs in the whole text. known: features of the words seen so far, which it adds to."""
    out: dict[int, int] = {}
    for w in tokens(text):
        found = known.get(w)
        if found is None:
            found = known[w] = [i for f in features(w) if (i := vocabulary.get(f)) is not None]
        for i in found:
            out[i] = out.get(i, 0) + 1
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's texts, in how many each feature occurs, and in how many toxic ones."""
    docs: Counter[str] = Counter()
    bad: Counter[str] = Counter()
    for b in batches:
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
            seen = {f for w in set(tokens(text)) for f in features(w)}
            docs.update(seen)
            if toxic:
                bad.update(seen)
    yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array([bad[w] for w in docs], pa.int64()), pa.array(list(docs.values()), pa.int64())], names=["word", "a", "k"])


def feature_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``a``, ``k``: features of texts (``toxic`` 0 or 1, ``text``) that occur in LEAST_DOCS of them at least, in how many toxic ones and in how many."""
    parts = texts.select("toxic", "text").mapInArrow(_counts, "word string, a long, k long")
    return cut(parts.groupBy("word").agg(F.sum("a").alias("a"), F.sum("k").alias("k")).where(f"k >= {LEAST_DOCS}"))


def training_texts(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id``, ``toxic``, ``text`` of about ``train_docs`` labelled documents that are not held out: the bound of what is broadcast and kept."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > train_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_docs / n * (1 << 30)))
    return cut(docs.select("doc_id", empty_if_null("text").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text"))


def graded(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``grade`` to training texts. Labels tell only toxic from clean, so severity is derived: a toxic text's grade is the number of its words whose stem marks
    toxicity (a share of MARK of the training texts with it is toxic), 1 at least and GRADES at most; clean ones have grade 0. All marks count; the
    driver gets them, as they come from the bounded sample and have MARKED letters at most."""
    stem = (F.length("word") == MARKED + 1) & F.col("word").endswith("-") | (F.length("word") <= MARKED) & ~F.col("word").endswith("-")
    marks = {r["word"] for r in counts.where(stem & (F.col("a") >= MARK * F.col("k"))).collect()}

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum((w[:MARKED] + "-" if len(w) > MARKED else w) in marks for w in tokens(t)) for t in b.column("text").to_pylist()]
            grades = np.where(b.column("toxic").to_numpy() > 0, np.clip(n, 1, GRADES), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("text"), pa.array(grades, pa.int32())], names=["doc_id", "toxic", "text", "grade"])

    return texts.mapInArrow(grade, "doc_id long, toxic int, text string, grade int")


def fit(training: DataFrame, counts: DataFrame | None = None, grades: int = GRADES, features_: int = FEATURES, steps: int = STEPS) -> Model:
    """Fits P(grade > k) = sigmoid(w x - threshold k) on rows of ``grade`` (0 to grades) and ``text``; all thresholds share the weights w.

    Features are log counts of the words and stems whose presence best tells grade 0 from others (chi-squared; ties by word; counts may bring
    their feature_counts). Each step sums gradients and curvatures over the partitions of the training table, which is bounded, and moves on the
    driver, which gets PARTS rows of 2 * (features + grades) numbers. Without rows of several grades the weights are zero.
    """
    spark = training.sparkSession
    total = training.agg(F.count("*"), F.sum((F.col("grade") > 0).cast("double"))).first()
    n, bad = total[0], total[1] or 0.0
    if counts is None:
        counts = feature_counts(training.select((F.col("grade") > 0).cast("int").alias("toxic"), "text"))
    expected = F.col("k") * bad / max(n, 1)
    best = counts.select("word", (F.pow(F.col("a") - expected, 2) / (expected * (1 - bad / max(n, 1)) + 1e-9)).alias("gain")).orderBy(F.desc("gain"), "word").limit(features_).collect() if 0 < bad < n else []
    model = Model({r["word"]: i for i, r in enumerate(best)}, np.zeros(max(1, len(best))), np.arange(grades) + np.log(max(n - bad, 1) / max(bad, 1)))
    if not best:
        return model
    shared = spark.sparkContext.broadcast(model.vocabulary)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            rows = [counted(t, shared.value, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([[float(np.log1p(x)) for x in r.values()] for r in rows], pa.list_(pa.float64()))], names=["grade", "at", "value"])

    table = cut(training.select("grade", "text").mapInArrow(sparse, "grade int, at array<int>, value array<double>").coalesce(PARTS))
    k = len(model.weights)
    velocity = np.zeros(k + grades)
    for step in range(steps):
        now = spark.sparkContext.broadcast((model.weights, model.thresholds))

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            w, cuts = now.value
            edges = np.concatenate(([-np.inf], cuts, [np.inf]))
            grad, curve = np.zeros(k + grades), np.zeros(k + grades)
            for b in batches:
                y = b.column("grade").to_numpy()
                sizes = np.diff(b.column("at").offsets.to_numpy())
                at, v = b.column("at").flatten().to_numpy(), b.column("value").flatten().to_numpy()
                row = np.repeat(np.arange(len(b)), sizes)
                s = np.bincount(row, weights=w[at] * v, minlength=len(b))
                hi, lo = (1 / (1 + np.exp(-np.clip(edges[y + j] - s, -500, 500))) for j in (1, 0))  # P(grade <= y), P(grade < y)
                p, dh, dl = np.maximum(hi - lo, 1e-12), hi * (1 - hi), lo * (1 - lo)
                g = -(dh - dl) / p  # of log p by s
                info = dh + dl
                grad[:k] += np.bincount(at, weights=g[row] * v, minlength=k)
                curve[:k] += np.bincount(at, weights=info[row] * v * v, minlength=k)
                for j in range(grades):
                    grad[k + j] += (dh[y == j] / p[y == j]).sum() - (dl[y == j + 1] / p[y == j + 1]).sum()
                    curve[k + j] += dh[y == j].sum() + dl[y == j + 1].sum()
            yield pa.RecordBatch.from_arrays([pa.array([grad.tolist()], pa.list_(pa.float64())), pa.array([curve.tolist()], pa.list_(pa.float64()))], names=["grad", "curve"])

        parts = table.mapInArrow(sums, "grad array<double>, curve array<double>").toArrow()
        grad, curve = (np.array(parts[c].to_pylist()).sum(axis=0) for c in ("grad", "curve"))
        grad[:k] -= RIDGE * n * model.weights / 100
        curve[:k] += RIDGE * n / 100
        velocity = 0.5 * velocity + np.clip(0.5 * grad / (curve + 0.5), -1, 1)
        model.weights = model.weights + velocity[:k]
        model.thresholds = np.maximum.accumulate(model.thresholds + velocity[k:] + 1e-6 * np.arange(grades))
        if step > 5 and np.abs(velocity).max() < 1e-3:
            break
    return model


def toxicity(docs: DataFrame, model: Model, flag: float = FLAG) -> DataFrame:
    """One row per document: ``doc_id``, ``severity`` (the expected grade), ``grade`` (the likeliest; ties: the lower), ``score`` (P(grade > 0)), ``predicted`` (1 if score >= flag).

    Null texts count as empty; a text without a feature gets the thresholds' probabilities. The whole text is read. Numbers are rounded to 9 places. Rows that repeat are graded alike and
    each kept, also without a doc_id; other columns are ignored, whatever their names; an empty table gives an empty result. Of labels that differ for one doc_id the largest counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            known: dict[str, list[int]] = {}
            above = m.above([counted(t, m.vocabulary, known) for t in b.column("text").to_pylist()]) if len(b) else np.zeros((0, len(m.thresholds)))
            each = -np.diff(np.concatenate((np.ones((len(b), 1)), above, np.zeros((len(b), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(above.sum(axis=1), 9)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(np.round(above[:, 0], 9))], names=["doc_id", "severity", "grade", "score"])

    scored = docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(rows, "doc_id long, severity double, grade int, score double")
    return scored.withColumn("predicted", (F.col("score") >= flag).cast("int"))
