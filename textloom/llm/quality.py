"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by its shape and encoded by a small network; gated
attention weights, learned from document labels alone, form the weighted passage representation that is scored. Labels are
learned from about `bound` labelled rows, of PASSAGES passages together at most; every text is scored whole.

An empty or null text is a bag of one empty passage; without labels of both kinds the score is the base rate, or 1 without any
label (nothing is rejected). Every row is scored by itself, equal texts alike; where labels repeat an id, 1 wins; an empty table
gives no rows; other columns, whatever their names, are not read; a text of any length is as many passages as it has.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, held_out, labelled_sample, map_batches, materialize, texts

BOUND = 8_000
PASSAGE = 64
#: Passages that are learned from at most: of the sample, the documents whose ids come first until that is reached.
PASSAGES = 400_000
HIDDEN, GATE, EPOCHS = 16, 8, 150
SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")
TAIL = re.compile(r"[^\w\s.,;:'\"()?!-]$|!!")
N = 17


def _describe(w: list[str], whole: float) -> tuple[float, ...]:
    n = len(w)
    if not n:
        return (0.0,) * (N - 2) + (1.0, whole)
    s = " ".join(w)
    chars, bag = len(s), Counter(w)
    title = sum(map(str.istitle, w))
    return (
        sum(map(str.isupper, w)) / n, len(SYMBOL.findall(s)) / chars, s.count("|") / n, s.count("!") / n, len(bag) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n, math.log1p(chars / n), sum(map(str.isdigit, w)) / n, s.count(".") / n, s.count(",") / n,
        sum(TAIL.search(x) is not None for x in w) / n, title / n, max(bag.values()) / n, sum(len(x) <= 3 for x in w) / n, math.log1p(n),
        0.0, whole,
    )


def passages(text: str) -> list[tuple[float, ...]]:
    w = text.split()
    whole = math.log1p(len(w))
    return [_describe(w[k : k + PASSAGE], whole) for k in range(0, len(w), PASSAGE)] or [_describe([], 0.0)]


class Model:
    """Weights: encoder e, gates v and u, attention a, output c."""

    def __init__(self, mean, std, weights, prior=None):
        self.mean, self.std, self.w, self.prior = mean, std, weights, prior

    def forward(self, x: np.ndarray, start: np.ndarray, w=None):
        e, v, u, a, c = w or self.w
        h = np.tanh(x @ e[:-1] + e[-1])
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        s = (t * g) @ a
        size = np.diff(np.r_[start, len(x)])
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, start), size))
        att = s / np.repeat(np.add.reduceat(s, start), size)
        z = np.add.reduceat(att[:, None] * h, start)
        p = 1 / (1 + np.exp(-np.clip(z @ c[:-1] + c[-1], -30, 30)))
        return p, (h, t, g, att, z, size)

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def score(self, values: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(values), self.prior)
        bags = [passages(t) for t in values]
        start = np.cumsum([0] + [len(b) for b in bags])[:-1]
        return self.forward(self.scale(np.array([p for b in bags for p in b])), start)[0]


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, prior=float(y.mean()) if len(y) else 1.0)
    rows = np.concatenate(bags)
    mean, std = rows.mean(0), rows.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.3, s) for s in ((N + 1, HIDDEN), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN + 1,))]
    model = Model(mean, std, w)
    first, second, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    sizes = [len(b) for b in bags]
    scaled = [model.scale(b) for b in bags]
    order = rng.permutation(len(bags))
    per = 512
    for epoch in range(EPOCHS):
        rate = 0.02 * 0.5 ** (epoch // 40)
        for at in range(0, len(order), per):
            pick = order[at : at + per]
            x, start = np.concatenate([scaled[k] for k in pick]), np.cumsum([0] + [sizes[k] for k in pick])[:-1]
            p, (h, t, g, att, z, size) = model.forward(x, start)
            e, v, u, a, c = w
            d = (p - y[pick]) / len(pick)
            dc = np.r_[z.T @ d, d.sum()]
            dz = np.repeat(d[:, None] * c[:-1], size, 0)
            dh = att[:, None] * dz
            da = (dz * h).sum(1)
            ds = att * (da - np.repeat(np.add.reduceat(att * da, start), size))
            dt, dg = ds[:, None] * a * g * (1 - t * t), ds[:, None] * a * t * g * (1 - g)
            dh += dt @ v.T + dg @ u.T
            dx = dh * (1 - h * h)
            grads = [np.vstack([x.T @ dx, dx.sum(0)]), h.T @ dt, h.T @ dg, (t * g).T @ ds, dc]
            step += 1
            for k in range(5):
                grad = grads[k] + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, bound: int = BOUND, label: str = "quality") -> Model:
    whole = sample = materialize(labelled_sample(docs, labels, label, modulus, held, bound))
    sizes, held_sizes = sample.select("doc_id", F.greatest(F.lit(1), F.ceil(F.regexp_count("text", F.lit(r"\S+")) / PASSAGE)).alias("n")).orderBy("doc_id").collect(), 0
    within = [r[0] for r in sizes if (held_sizes := held_sizes + r.n) <= PASSAGES]
    if len(within) < len(sizes):
        sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in within], sample.select("doc_id").schema)), "doc_id")

    def run(ids, ys, values):
        return ids, ys, [np.array(passages(t), np.float32).tobytes() for t in values]

    got = map_batches(sample.select("doc_id", "label", "text"), run, "doc_id long, y int, x binary").collect()  # features of about `bound` rows
    drop_tables(whole)
    got.sort(key=lambda r: (r[0], bytes(r[2])))
    return fit([np.frombuffer(r[2], np.float32).reshape(-1, N).astype(float) for r in got], np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2) -> DataFrame:
    def run(ids, values):
        p = model.score(values)
        return ids, p, (p >= 0.7).astype(np.int32)

    return map_batches(texts(docs), run, "doc_id long, score double, predicted int").select("doc_id", held_out(modulus, held).alias("held_out"), "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score `least` or more: a narrow filter, no shuffle."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def scored(values):
        import pandas as pd

        rows = [t or "" for t in values]
        return pd.Series(np.concatenate([model.score(rows[k : k + 1024]) for k in range(0, len(rows), 1024)] or [np.empty(0)]))

    return docs.where(scored(F.col(text_col)) >= least)
