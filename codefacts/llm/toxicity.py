"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and beginnings of words is fitted on a bounded sample of labelled rows. Beside the usual
loss it pays for every change of its score when group names in a labelled text are exchanged, or when one is put into a
text that has none; so a text is not held toxic for naming a group.

Nulls and empty texts have the score of a text that says nothing (the bias); rows of any length are read whole; equal
texts have equal scores; repeated rows are scored each; an empty table gives an empty result; without labels every score
is 0.5. Other columns are passed on by ``reject`` and ignored elsewhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codefacts.llm import linear
from codefacts.llm.batches import bounded

FEATURES = linear.Features(heads=(4, 5, 6, 7, 8))
#: a document counts as toxic from this score on
THRESHOLD = 0.3
#: names of groups, in sets whose members stand for one another; a parameter of ``fit``
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "hispanic", "african", "european", "indigenous"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
)
#: altered texts for each labelled row
VARIANTS = 1
#: weight of the squared change of score, and of the squared weights
FAIRNESS, RIDGE = 5.0, 1e-3


def swaps(terms: Sequence[Sequence[str]], count: int = VARIANTS):
    """A function that gives altered versions of a text: its group names exchanged, or one put in where it has none."""
    others = {t: [o for o in group if o != t] for group in terms for t in group}
    every = [t for group in terms for t in group]
    # one pass over words; a name is looked up, so the number of names costs nothing
    word = re.compile(r"[^\W\d_]+")

    def alter(text: str) -> list[str]:
        seed = zlib.crc32(text.encode("utf-8", "replace"))
        named = [m for m in word.finditer(text) if m.group().lower() in others]
        out = []
        for k in range(count if every else 0):
            if named:
                parts, end = [], 0
                for m in named:
                    choice = others[m.group().lower()]
                    parts += [text[end : m.start()], choice[(seed + k) % len(choice)] if choice else m.group()]
                    end = m.end()
                out.append("".join([*parts, text[end:]]))
            else:
                stop = text.find(". ") + 1
                out.append(f"{text[:stop]} {every[(seed + k) % len(every)]} {text[stop:]}")
        return out

    return alter


def fit(docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, rows: int = linear.LABELLED_ROWS) -> linear.Model:
    """Fitted on at most ``rows`` labelled rows outside fold 2: three quarters give the weights, one the calibration."""
    sample = linear.labelled_sample(docs, labels, "toxic", FEATURES, rows, swaps(terms))
    return fit_sample(sample)


def fit_sample(sample: linear.Sample, fairness: float = FAIRNESS) -> linear.Model:
    none = np.zeros(0, np.int32)
    y = sample.labels
    if not len(y) or y.min() == y.max():
        at = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return linear.Model(FEATURES, none, np.zeros(0), np.zeros(0), 0.0, 1.0, at)
    aside = np.arange(len(y)) % 4 == 3
    train = np.flatnonzero(~aside)
    ratio = linear.log_count_ratio([sample.features[i] for i in train], y[train])
    used = np.flatnonzero(ratio)
    slot = np.full(len(ratio), -1)
    slot[used] = np.arange(len(used))
    value = ratio[used]

    def rows_of(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        col = slot[np.concatenate(lists)] if lists else np.zeros(0, np.int64)
        row, col = row[col >= 0], col[col >= 0]
        length = np.sqrt(np.bincount(row, value[col] ** 2, len(lists)) + 1)
        return row, col, value[col] / length[row]

    row, col, x = rows_of([sample.features[i] for i in train])
    pairs = [(i, v) for i in train for v in sample.variants[i]]
    row_a, col_a, x_a = rows_of([sample.features[i] for i, _ in pairs])
    row_b, col_b, x_b = rows_of([v for _, v in pairs])
    goal = (y[train] == 1).astype(float)
    n, m = len(train), max(1, len(pairs))
    # rows of the rarer label weigh more, but not so much that their share is forgotten
    weight = np.where(goal == 1, np.sqrt(n / max(1, 2 * goal.sum())), np.sqrt(n / max(1, 2 * (n - goal.sum()))))
    w, bias = np.zeros(len(used)), 0.0
    moment, second, moment_b, second_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, 301):
        margin = np.bincount(row, w[col] * x, n) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - goal) / n
        change = np.bincount(row_b, w[col_b] * x_b, m) - np.bincount(row_a, w[col_a] * x_a, m)
        pull = 2 * fairness * change / m
        gradient = np.bincount(col, error[row] * x, len(used)) + RIDGE * w / max(1, len(used)) * 100
        gradient += np.bincount(col_b, pull[row_b] * x_b, len(used)) - np.bincount(col_a, pull[row_a] * x_a, len(used))
        gradient_b = float(error.sum())
        moment, second = 0.9 * moment + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        moment_b, second_b = 0.9 * moment_b + 0.1 * gradient_b, 0.99 * second_b + 0.01 * gradient_b**2
        rate = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * moment / (np.sqrt(second) + 1e-8)
        bias -= rate * moment_b / (np.sqrt(second_b) + 1e-8)
    keep = np.ones(len(used), bool)
    row_c, col_c, x_c = rows_of([sample.features[i] for i in np.flatnonzero(aside)])
    held = np.bincount(row_c, w[col_c] * x_c, int(aside.sum())) + bias
    a, b = linear.calibrate(held, y[aside]) if aside.any() else (1.0, 0.0)
    # the bias is divided by the length like the rest when texts are scored, so it goes to the calibration
    return linear.Model(FEATURES, used[keep].astype(np.int32), (w * value)[keep], (value**2)[keep], 0.0, a, a * bias + b)


def score(docs: DataFrame, model: linear.Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: more likely toxic) of every row."""
    return linear.score(docs, model)


def reject(docs: DataFrame, model: linear.Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not toxic; filtered where they lie, without a shuffle."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # whatever the columns are called

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < threshold))

    return bounded(plain).mapInArrow(work, plain.schema).toDF(*docs.columns)
