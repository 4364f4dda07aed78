"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of PASSAGE words. Each passage is described by measures of its letters
and words, encoded by a small layer, and weighted by gated attention, softmax(w . (tanh(V z) * sigmoid(U
z))); the weighted mean of the encodings gives the score. Weights are learned from document labels alone.

The model is fitted on the driver from at most `sample` labelled documents (chosen by the hash of their
id, a documented bound); every document is scored on the executors, with all of its passages.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, raw
from .quality import WORDS as COMMON_WORDS

PASSAGE = 64  # words
SAMPLE = 3000  # labelled documents
HIDDEN, ATTENTION = 24, 12
EPOCHS, BAGS, RATE, DECAY = 25, 64, 0.01, 1e-4
N_FEATURES = 17

_COMMON = frozenset(COMMON_WORDS)
_CLASSES = 9
_MARKS, _BARS = b".,;:", b"!?"


def _class_of(c: int) -> int:
    if c == 0x20 or 0x09 <= c <= 0x0D:
        return 0
    if 0x61 <= c <= 0x7A:
        return 1
    if 0x41 <= c <= 0x5A:
        return 2
    if 0x30 <= c <= 0x39:
        return 3
    if c in _MARKS:
        return 4
    if c in _BARS:
        return 5
    if c == 0x7C:
        return 6
    if c < 0x80:
        return 7
    return 8


_CLASS = np.array([_class_of(c) for c in range(256)], np.int64)


def passages(text: bytes | None) -> np.ndarray:
    """One row of N_FEATURES measures for each passage; a text without words has one row of zeros."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    line = b" ".join(words)
    k = -(-n // PASSAGE)
    size = np.fromiter(map(len, words), np.int64, n)
    which = np.arange(n) // PASSAGE
    per = np.bincount(which, minlength=k).astype(float)
    stops = np.cumsum(size + 1)[np.minimum(np.arange(1, k + 1) * PASSAGE, n) - 1]
    stops[-1] = len(line)
    chars = np.diff(np.concatenate(([0], stops)))
    counts = np.bincount(np.repeat(np.arange(k) * _CLASSES, chars) + _CLASS[np.frombuffer(line, np.uint8)], minlength=k * _CLASSES).reshape(k, _CLASSES)
    h = np.fromiter(map(hash, words), np.int64, n)
    grid = np.empty(k * PASSAGE, np.int64)
    grid[:n] = h
    grid[n:] = h[-1]  # repeats do not add distinct words
    ordered = np.sort(grid.reshape(k, PASSAGE), axis=1)
    distinct = 1 + (np.diff(ordered, axis=1) != 0).sum(axis=1)
    again = np.bincount(which[1:], weights=h[1:] == h[:-1], minlength=k)
    common = np.bincount(which, weights=np.fromiter(map(_COMMON.__contains__, line.lower().split()), bool, n), minlength=k)
    mean = np.bincount(which, weights=size, minlength=k) / per
    spread = np.sqrt(np.maximum(np.bincount(which, weights=size**2, minlength=k) / per - mean**2, 0))
    out = np.empty((k, N_FEATURES), np.float32)
    out[:, :_CLASSES] = counts / np.maximum(chars, 1)[:, None]
    out[:, 9] = distinct / per
    out[:, 10] = again / per
    out[:, 11] = common / per
    out[:, 12], out[:, 13] = np.minimum(mean, 50) / 10, np.minimum(spread, 50) / 10
    out[:, 14] = np.log1p(per) / 5
    out[:, 15] = np.log1p(n) / 10
    out[:, 16] = 1.0  # the text has words
    return out


class Model:
    """Gated-attention pooling over passages, in numpy."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f, h, a = N_FEATURES, HIDDEN, ATTENTION
        self.w = {"enc": r.normal(0, f**-0.5, (f, h)), "enc0": np.zeros(h), "v": r.normal(0, h**-0.5, (h, a)), "u": r.normal(0, h**-0.5, (h, a)), "att": r.normal(0, a**-0.5, a), "out": r.normal(0, h**-0.5, h), "out0": np.zeros(1)}
        self.mean, self.scale = np.zeros(f), np.ones(f)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """x: passages of all bags, one after another; starts: each bag's first passage."""
        w = self.w
        sizes = np.diff(np.concatenate((starts, [len(x)])))
        x = (x - self.mean) / self.scale
        z = np.tanh(x @ w["enc"] + w["enc0"])
        t, s = np.tanh(z @ w["v"]), 1 / (1 + np.exp(-(z @ w["u"])))
        e = (t * s) @ w["att"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
        m = np.add.reduceat(alpha[:, None] * z, starts)
        p = 1 / (1 + np.exp(-np.clip(m @ w["out"] + w["out0"][0], -40, 40)))
        return p, (x, z, t, s, alpha, m, sizes)

    def gradient(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        p, (x, z, t, s, alpha, m, sizes) = self.forward(x, starts)
        dy = (p - label) / len(label)
        dm = np.repeat(dy[:, None] * w["out"], sizes, axis=0)
        da = (z * dm).sum(axis=1)
        de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, starts), sizes))
        dg = de[:, None] * w["att"]
        dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dz = (alpha[:, None] * dm + dt @ w["v"].T + ds @ w["u"].T) * (1 - z**2)
        return {"out": m.T @ dy, "out0": np.array([dy.sum()]), "att": (t * s).T @ de, "v": z.T @ dt, "u": z.T @ ds, "enc": x.T @ dz, "enc0": dz.sum(axis=0)}

    def fit(self, bags: list[np.ndarray], labels: list[int], seed: int = 7) -> Model:
        y = np.array(labels, float)
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        r, step = np.random.default_rng(seed), 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for at in range(0, len(order), BAGS):
                some = order[at : at + BAGS]
                sizes = [len(bags[i]) for i in some]
                g = self.gradient(np.concatenate([bags[i] for i in some]), np.concatenate(([0], np.cumsum(sizes)[:-1])), y[some])
                step += 1
                for k, d in g.items():
                    d = d + DECAY * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d**2
                    self.w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        out = []
        for at in range(0, len(bags), 200):
            some = bags[at : at + 200]
            out.append(self.forward(np.concatenate(some), np.concatenate(([0], np.cumsum([len(b) for b in some])[:-1])))[0])
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", fold: Callable[[Column], Column] | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` documents whose id satisfies `fold`.

    Ids with contradicting or null labels teach nothing. Without both labels the score is a constant.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & (fold(F.col("id")) if fold else F.lit(True)))
    agreed = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").select("id", "label")
    chosen = F.broadcast(agreed.orderBy(F.xxhash64("id"), "id").limit(sample))  # at most `sample` rows
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id")

    def build():
        def make(column: pa.Array) -> dict[str, object]:
            return {"bag": pa.array([passages(t).tobytes() for t in raw(column)], pa.binary())}

        return make

    rows = map_text(slim, ["id", "label"], "text", build, "bag binary").groupBy("id").agg(F.min("label").alias("label"), F.min("bag").alias("bag")).collect()
    rows.sort(key=lambda r: r.id)
    return Model().fit([np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES) for r in rows], [r.label for r in rows])


def scored(docs: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    """The `keep` columns with score: the whole text's, for every row. Null is like empty."""

    def build():
        def make(column: pa.Array) -> dict[str, object]:
            return {"score": pa.array(model.score([passages(t) for t in raw(column)]), pa.float64())}

        return make

    return map_text(docs, keep, text, build, "score double", piece=500)


def report(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, held_out, score, predicted. A third of the ids is held out from learning."""
    model = train(docs, labels, id, text, fold=lambda i: F.crc32(i.cast("string")) % 3 != 1, sample=sample)
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return scored(slim, ["id"], "text", model).select(F.col("id").alias(id), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
