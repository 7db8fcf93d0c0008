"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each text becomes the set of its hashed n-grams: byte trigrams, words and word pairs, and runs of one to three word
shapes (character classes, and whether the word repeats the one before). Indicators are scaled by class log-count
ratios, rows are brought to length one, and a linear hinge-loss model is fitted by dual coordinate descent. The fit
uses a bounded sample of labelled rows; its weights have a fixed size and are broadcast. Scoring is one pass over the
texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, bounded_batches, distinct, mix

BITS = 20
#: The fit's bounds, parameters of learn(): labelled rows, and features of them all.
MAX_ROWS, MAX_FEATURES = 6000, 16_000_000
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.full(256, 8, np.uint8)  # other marks
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[128:] = 16


def _hash(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x + np.uint64(kind << 56)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: bytes | None) -> np.ndarray:
    """The distinct hashed n-grams of a text."""
    b = np.frombuffer(text or b"", np.uint8)
    parts = []
    if len(b) >= 3:
        wide = b.astype(np.uint64)
        parts.append(_hash(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:], 1))
    word = np.concatenate(([False], ~_SPACES[b], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if len(start):
        place = np.arange(len(b), dtype=np.uint64)
        place -= np.repeat(place[np.concatenate(([0], start[1:]))], np.diff(np.concatenate(([0], start[1:], [len(b)]))))
        hashed = np.where(_SPACES[b], np.uint64(0), mix(_BYTE[b] + place))
        h = np.add.reduceat(hashed, start)
        shape = np.bitwise_or.reduceat(np.where(_SPACES[b], np.uint8(0), _CLASS[b]), start).astype(np.uint64)
        again = np.concatenate(([False], h[1:] == h[:-1]))
        shape = (shape << np.uint64(1) | again) + np.uint64(1)
        parts += [_hash(h, 2), _hash(h[:-1] * np.uint64(31) + h[1:], 3), _hash(shape, 4)]
        parts += [_hash(shape[:-1] << np.uint64(8) | shape[1:], 5)]
        parts += [_hash(shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:], 6)]
    return distinct(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = sum(weight) / sqrt(sum(square)) + bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[f].sum(dtype=np.float64)))
        return float(self.weight[f].sum(dtype=np.float64)) / norm + self.bias if norm > 0 else self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, blend: float = 0.5, rounds: int = 15, seed: int = 1) -> Model:
    """rows: feature sets; y: 0 or 1. Every fourth row is kept from the weights and calibrates the score."""
    size = 1 << BITS
    zero = np.zeros(size, np.float32)
    if not len(rows) or len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 0.5
        return Model(zero, zero, 0.0, 1.0, float(np.log((p * len(y) + 1) / ((1 - p) * len(y) + 1))))
    hold = np.arange(len(rows)) % 4 == 3
    if len(set(y[~hold].tolist())) < 2:
        hold[:] = False
    count = np.ones((2, size))
    for f, label in zip(rows, y):
        count[label, f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    own = np.flatnonzero(~hold)
    # Scaled rows share one array: as arrays of their own they would stay in the process's memory after the fit.
    end = np.cumsum([len(rows[i]) for i in own])
    flat = np.empty(end[-1])
    x = [flat[b - len(rows[i]) : b] for i, b in zip(own, end)]
    for i, v in zip(own, x):
        np.take(ratio, rows[i], out=v)
        v /= np.linalg.norm(v) or 1.0
    sign = np.where(y[own] == 1, 1.0, -1.0)
    # The rarer class weighs as much as the other.
    upper = cost * np.where(sign > 0, len(own) / (2 * (sign > 0).sum()), len(own) / (2 * (sign < 0).sum()))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(own))
    square = np.array([v @ v for v in x]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(own)):
            f = rows[own[i]]
            step = sign[i] * (w[f] @ x[i] + bias) - 1.0
            new = min(max(alpha[i] - step / square[i], 0.0), upper[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * sign[i]
                w[f] += d * x[i]
                bias += d
                moved = max(moved, abs(d))
                alpha[i] = new
        if moved < 1e-3:
            break
    w = (1 - blend) * np.abs(w).mean() + blend * w if blend < 1 else w
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(hold) if hold.any() else own
    m = np.array([model.margin(rows[i]) for i in rest])
    model.slope, model.shift = _calibrate(m, y[rest])
    return model


def _calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins by Newton steps, with smoothed targets; the slope stays positive."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


def held_out(key: str) -> Column:
    """Rows that no label is learned from: crc32 of the key as text, modulo 4, is 2. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fits on a sample of the labelled rows that are not held out: in the order of a hash of their key, `max_rows` at
    most, and as many as have `max_features` features together (one at least). Both bound the driver's memory.

    A key labelled twice counts by its largest label, a key with several texts by the least of their feature sets, so
    reruns fit the same model.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_y"))
    sample = known.orderBy(F.xxhash64("_key"), "_key").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [features(t).tobytes() for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["k", "y", "f"])

    # max_rows rows: a proven bound, so the sample is broadcast and the texts stay in place.
    pick = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key").select(F.col("_key").cast("string"), F.col("_y").cast("int"), "_text")
    found = bounded_batches(pick).mapInArrow(run, "k string, y int, f binary").groupBy("k").agg(F.max("y").alias("y"), F.min("f").alias("f"))
    # One buffer for all rows: as objects of their own they would stay in the driver's memory after the fit.
    flat, ends, y = bytearray(), [0], []
    for r in found.orderBy(F.xxhash64("k"), "k").toLocalIterator():
        if y and len(flat) + len(r.f) > 4 * max_features:
            break
        flat += r.f
        ends.append(len(flat) // 4)
        y.append(r.y)
    sets = np.frombuffer(flat, np.int32)
    return fit([sets[a:b] for a, b in zip(ends, ends[1:])], np.array(y, np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds `out`, from 0 to 1; higher: label 1 is likelier. A null text counts as empty. A column of that name is replaced."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(features(t)) for t in as_bytes(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return bounded_batches(docs).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The contract's columns."""
    model = learn(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
