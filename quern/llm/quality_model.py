"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

The labels that may be learned from are cut to ``most_rows`` rows, those with the smallest hash of their id, so that
training costs the same at any size. They are dealt to groups of about ``GROUP`` rows; each group runs its own updates
over its rows and the weights are averaged. Scoring is a sparse dot product per text, over the whole text.

A null or empty text has no n-gram and gets the score of the intercept. Labels other than 0 and 1, null ids and ids
that no document has teach nothing; a label given twice counts twice. Without any label to learn from, every score
is 0.5. A score that ties with the threshold is predicted 1. A text of any length is scored whole, repeated rows alike,
an empty table gives no rows. Further columns of the documents pass through; columns named score and predicted are
replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import per_worker, stable, values

BITS, GROUP = 18, 1250
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _MID = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Training:
    """``most_rows`` bounds the labelled rows; the others are the usual parameters of the updates."""

    most_rows: int = 20_000
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.02
    epochs: int = 3


def _shape(token: str) -> str:
    if token.isalpha():
        case = "u" if token.isupper() and len(token) > 1 else "l" if token.islower() else "t" if token.istitle() else "m"
        return f"{case}{min(len(token), 24) // 4}"
    return f"0{min(len(token), 20) // 4}" if token.isdigit() else token[:3]


class _Codes(dict):
    """Of a token: 32 bits for its lower case, 32 for its shape."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        word = token.lower() if token.isalpha() else "0" * len(token) if token.isdigit() else token
        self[token] = code = zlib.crc32(word.encode()) << 32 | zlib.crc32(_shape(token).encode())
        return code


def features(text: str | None, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Places in the weight vector, one for each n-gram that occurs, and the value of each occurrence."""
    tokens = TOKEN.findall(text or "")
    n = len(tokens)
    c = np.fromiter(map(codes.__getitem__, tokens), np.uint64, n)
    word, shape = c >> np.uint64(32), c & _LOW
    same = c[1:] == c[:-1]
    kinds = [
        (word, 1),
        (word[:-1] * _LEFT + word[1:], 2),
        (shape, 3),
        (shape[:-1] * _LEFT + shape[1:], 4),
        (shape[:-2] * _LEFT + shape[1:-1] * _MID + shape[2:], 5),
        (same.astype(np.uint64), 6),
    ]
    with np.errstate(over="ignore"):
        at = [((k + np.uint64(salt << 40)) * _MIX ^ (k >> np.uint64(7))) * _LEFT >> np.uint64(64 - BITS) for k, salt in kinds if n >= 3 or len(k)]
    size = [np.full(len(a), 4.0 / len(a)) if len(a) else np.zeros(0) for a in at]
    return (np.concatenate(at) if at else np.zeros(0, np.uint64)).astype(np.int64), np.concatenate(size) if size else np.zeros(0)


def _logistic(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str | None], labels: list[int], p: Training, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes in an order drawn from the seed."""
    z, g2, codes = np.zeros(1 << BITS), np.zeros(1 << BITS), _Codes()
    rate = (sum(labels) + 1) / (len(labels) + 2)
    z0, n0, start = 0.0, 0.0, float(np.log(rate / (1 - rate)))
    held = []
    for t, y in zip(texts, labels, strict=True):
        at, value = features(t, codes)
        u, inverse = np.unique(at, return_inverse=True)
        held.append((u, np.bincount(inverse, value, len(u)) if len(u) else value, y))
    rng = np.random.default_rng(seed)
    for _ in range(p.epochs):
        for i in rng.permutation(len(held)):
            at, x, y = held[i]
            zi, ni = z[at], g2[at]
            w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
            w[np.abs(zi) <= p.l1] = 0.0
            b = -z0 / ((p.beta + np.sqrt(n0)) / p.alpha)
            error = _logistic(start + b + float(w @ x)) - y
            g = error * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            g2[at] = ni + g * g
            z0 += error - (np.sqrt(n0 + error * error) - np.sqrt(n0)) / p.alpha * b
            n0 += error * error
    w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(g2)) / p.alpha + p.l2)
    w[np.abs(z) <= p.l1] = 0.0
    return w, start - z0 / ((p.beta + np.sqrt(n0)) / p.alpha)


def cross_validate(texts: list[str | None], labels: list[int], folds: list[int], settings: list[Training], threshold: float = 0.3) -> list[tuple[float, float]]:
    """(log loss, accuracy) of each setting over rows that may be learned from, each scored by a model without its fold."""
    codes, out = _Codes(), []
    found = [features(t, codes) for t in texts]
    for p in settings:
        loss = right = 0.0
        for f in sorted(set(folds)):
            learn = [i for i, x in enumerate(folds) if x != f]
            w, b = train([texts[i] for i in learn], [labels[i] for i in learn], p)
            for i in (i for i, x in enumerate(folds) if x == f):
                score = float(_logistic(b + float(w[found[i][0]] @ found[i][1])))
                loss -= math.log(max(1e-9, score if labels[i] else 1 - score))
                right += (score >= threshold) == bool(labels[i])
        out.append((loss / len(texts), right / len(texts)))
    return out


def fit(docs: DataFrame, labels: DataFrame, p: Training = Training(), text: str = "text", id: str = "doc_id", label: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and intercept; the driver gets only the weights that are not 0 of each group."""
    given = labels.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("i").isNotNull())
    chosen = stable(given.orderBy(F.xxhash64("i"), "i", "y").limit(p.most_rows))
    groups = max(1, -(-chosen.count() // GROUP))
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen), "i")  # chosen: most_rows small rows at most
    rows = rows.select("i", "t", "y", F.pmod(F.xxhash64(F.lit(1), "i"), groups).alias("shard"))

    def one(group: pa.Table) -> pa.Table:
        held = sorted(zip(*(group[c].to_pylist() for c in ("i", "y", "t", "shard")), strict=True), key=lambda r: (r[0], r[1], r[2] or ""))
        w, b = train([r[2] for r in held], [r[1] for r in held], p)
        at = np.flatnonzero(w)
        found = {"shard": [held[0][3]], "n": [len(held)], "b": [b], "at": [at.astype(np.int32).tobytes()], "w": [w[at].astype(np.float32).tobytes()]}
        return pa.table(found)

    parts = sorted(rows.groupBy("shard").applyInArrow(one, "shard long, n long, b double, at binary, w binary").collect())
    weights, intercept, n = np.zeros(1 << BITS), 0.0, sum(r["n"] for r in parts)
    for r in parts:
        weights[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["w"], np.float32) * (r["n"] / n)
        intercept += r["b"] * r["n"] / n
    return weights.astype(np.float32), float(intercept)


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]) -> Callable[[Column], Column]:
    """Column of texts to column of scores; the model is 1 MB, whatever the documents."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, b = held.value
        codes = per_worker(("codes",), _Codes)
        for part in values(batches):
            found = (features(t, codes) for t in part)
            yield pa.array([float(_logistic(b + float(w[at] @ value))) for at, value in found], pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, p: Training = Training(), text: str = "text", id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents with ``score`` (how likely label 1 is) and ``predicted``."""
    score = scorer(docs, fit(docs, labels, p, text, id, label))
    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
