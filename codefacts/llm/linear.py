"""What the two text classifiers share: a bounded labelled sample, log-count ratios, calibration, scoring in place.

Rows are sampled by the order of a hash of their id, so a run is repeatable. Only ids, labels and hashed features of the
sample reach the driver, never texts; ``LABELLED_ROWS`` bounds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm import grams
from codefacts.llm.batches import bounded

#: labelled rows that a classifier is fitted on, at most
LABELLED_ROWS = 6000
#: features are hashed into 2 ** BITS buckets
BITS = 18


def fold(doc_id: Column) -> Column:
    """0 to 3; rows of fold 2 are held out. Null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


@dataclass(frozen=True)
class Features:
    """Which features of a text count."""

    heads: tuple[int, ...] = ()
    pairs: bool = False
    gaps: bool = False

    def of(self, texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return grams.indicators(texts, BITS, self.heads, self.pairs, self.gaps, wanted)


@dataclass
class Sample:
    """Labelled rows: label and features of each; ``variants[i]`` are features of altered texts of row i."""

    labels: np.ndarray
    features: list[np.ndarray]
    variants: list[list[np.ndarray]]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, features: Features, rows: int = LABELLED_ROWS, alter: Callable[[str], list[str]] | None = None
) -> Sample:
    """Up to ``rows`` labelled documents outside fold 2; ids or labels that are null are no labels.

    Of several labels of one id the largest counts. Repeated rows of an id count once. ``alter`` gives altered texts.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    first = (
        known.filter(fold(F.col("doc_id")) != 2)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .collect()  # at most ``rows`` pairs of numbers
    )
    if not first:
        return Sample(np.zeros(0, np.int64), [], [])
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(int(r.doc_id), int(r.label)) for r in first], "doc_id long, label int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in grams.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                at, bucket = features.of(part.column("text"))
                cut = np.searchsorted(at, np.arange(hi - lo + 1))
                mine = [bucket[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
                others: list[list[bytes]] = [[] for _ in mine]
                if alter is not None:
                    for i, text in enumerate(part.column("text").to_pylist()):
                        for changed in alter(text or ""):
                            others[i].append(features.of(pa.array([changed]))[1].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array(mine, pa.binary()), pa.array(others, pa.list_(pa.binary()))],
                    names=["doc_id", "label", "features", "variants"],
                )

    described = bounded(texts).mapInArrow(describe, "doc_id long, label int, features binary, variants array<binary>").dropDuplicates(["doc_id"])
    read = lambda b: np.frombuffer(b, np.int32)
    found = [(r.doc_id, r.label, read(r.features), [read(v) for v in r.variants]) for r in described.toLocalIterator()]  # ``rows`` of them, partition by partition
    found.sort(key=lambda r: r[0])
    return Sample(np.array([y for _, y, _, _ in found], np.int64), [x for _, _, x, _ in found], [v for _, _, _, v in found])


def log_count_ratio(features: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Of each bucket: log of how often rows of label 1 have it against rows of label 0; 0 where that says nothing.

    A bucket counts if three rows have it and its two frequencies differ by more than two standard errors.
    """
    size = 1 << BITS
    if not features:
        return np.zeros(size)
    of = np.repeat(labels, [len(f) for f in features])
    flat = np.concatenate(features)
    ones, zeros = np.bincount(flat[of == 1], minlength=size), np.bincount(flat[of != 1], minlength=size)
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels != 1).sum()))
    ratio = np.log((ones + smooth) / (n1 + 2 * smooth)) - np.log((zeros + smooth) / (n0 + 2 * smooth))
    clear = np.abs(ones / n1 - zeros / n0) / np.sqrt((ones + zeros + 1) / len(labels) * (1 / n1 + 1 / n0))
    clear[(ones + zeros < 3) | (clear <= 2)] = 0
    return np.where(clear > 0, ratio, 0.0)


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) is the share of label 1; Newton steps on smoothed targets."""
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        weight = p * (1 - p)
        gradient = np.array([((p - goal) * margins).sum() + 1e-3 * a, (p - goal).sum()])
        hessian = np.array([[(weight * margins**2).sum() + 1e-3, (weight * margins).sum()], [(weight * margins).sum(), weight.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return a, b


@dataclass(frozen=True)
class Model:
    """Weights of buckets, each bucket's part of a text's length, bias and calibration."""

    features: Features
    buckets: np.ndarray
    weights: np.ndarray
    norms: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        """(sum of weights + bias) / length, for each text; a text without known features has the bias."""
        size = 1 << BITS
        weights, norms, wanted = np.zeros(size), np.zeros(size), np.zeros(size, bool)
        weights[self.buckets], norms[self.buckets], wanted[self.buckets] = self.weights, self.norms, True
        out = []
        for lo, hi in grams.slices(texts):
            row, bucket = self.features.of(texts.slice(lo, hi - lo), wanted)
            total, length = np.bincount(row, weights[bucket], hi - lo), np.bincount(row, norms[bucket], hi - lo)
            out.append((total + self.bias) / np.sqrt(length + 1))
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(texts) + self.b, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row; no row is moved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
