"""Quality by naive Bayes support vectors.

N-gram indicators (words, word pairs, what stands between words, repeats) are scaled by the log-count ratio of the two
classes; a linear hinge-loss model over them is fitted by dual coordinate descent on a bounded sample of labelled rows,
and its margins are calibrated on a part of the sample kept aside.

Null and empty texts have the score of a text that says nothing (the bias); rows of any length are read whole; equal
texts have equal scores; repeated rows are scored each; an empty table gives an empty result; without labels every score
is 0.5. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from codefacts.llm import linear

FEATURES = linear.Features(pairs=True, gaps=True)
#: a document counts as good from this score on
THRESHOLD = 0.7
#: upper bound of a dual variable, and passes over the sample
COST, PASSES = 1.0, 12


def fit(docs: DataFrame, labels: DataFrame, rows: int = linear.LABELLED_ROWS) -> linear.Model:
    """Fitted on at most ``rows`` labelled rows outside fold 2: three quarters give the weights, one the calibration."""
    return fit_sample(linear.labelled_sample(docs, labels, "quality", FEATURES, rows))


def fit_sample(sample: linear.Sample) -> linear.Model:
    none = np.zeros(0, np.int32)
    y = sample.labels
    if not len(y) or y.min() == y.max():
        at = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return linear.Model(FEATURES, none, np.zeros(0), np.zeros(0), 0.0, 1.0, at)
    aside = np.arange(len(y)) % 4 == 3
    train = np.flatnonzero(~aside)
    ratio = linear.log_count_ratio([sample.features[i] for i in train], y[train])
    known = [f[ratio[f] != 0] for f in sample.features]
    length = np.array([np.sqrt((ratio[f] ** 2).sum() + 1) for f in known])
    sign = np.where(y == 1, 1.0, -1.0)
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(train):
            f = known[i]
            # each row has length 1, so the step along its dual variable is the slope itself
            slope = sign[i] * ((w[f] * ratio[f]).sum() + bias) / length[i] - 1
            new = min(max(dual[i] - slope, 0.0), COST)
            step = (new - dual[i]) * sign[i] / length[i]
            if step:
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
                w[f] += step * ratio[f]
                bias += step
        if moved < 1e-3:
            break
    held = np.flatnonzero(aside)
    margins = np.array([((w[known[i]] * ratio[known[i]]).sum() + bias) / length[i] for i in held])
    a, b = linear.calibrate(margins, y[held]) if len(held) else (1.0, 0.0)
    used = np.flatnonzero(ratio)
    return linear.Model(FEATURES, used.astype(np.int32), (w * ratio)[used], (ratio**2)[used], bias, a, b)


def score(docs: DataFrame, model: linear.Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: more likely good) of every row."""
    return linear.score(docs, model)
