"""Quality: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
_SHAPE = bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c for c in range(256)
)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; grade > k where w x exceeds thresholds[k]


class Buckets(dict):
    most = 300_000

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token) & ((1 << BITS) - 1)
        return value


def _squeeze(shape: bytes) -> bytes:
    for c in (b"a", b"A", b"9"):
        while c * 2 in shape:
            shape = shape.replace(c * 2, c)
    return shape


def text_features(text: str | None, buckets: Buckets, shapes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: the shares of its word shapes and of its words.

    A word's shape has one letter for each run of capitals, small letters and digits, and
    punctuation as it is. Values are square roots of shares, so their squares sum to 1 by family.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    counts: Counter = Counter()
    lengths = Counter(w.translate(_SHAPE) for w in words)
    for shape, n in lengths.items():
        key = shapes.get(shape)
        if key is None:
            if len(shapes) > 100_000:
                shapes.clear()
            key = shapes[shape] = buckets[b"s " + _squeeze(shape)[:32]]
        counts[key] += n
    index, value = list(counts), [n / max(1, len(words)) for n in counts.values()]
    spoken = Counter(w.lower() for w in words)
    index += [buckets[b"w " + w] for w in spoken]
    value += [0.25 * n / max(1, len(words)) for n in spoken.values()]
    return np.array(index, dtype=np.int64), np.sqrt(np.array(value))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    buckets, shapes = Buckets(), {}
    for batch in batches:
        rows = [text_features(t, buckets, shapes) for t in batch["text"]]
        yield pd.DataFrame({"grade": batch["grade"].to_numpy(), "index": pd.Series([r[0] for r in rows], dtype=object), "value": pd.Series([r[1] for r in rows], dtype=object)})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_quality(graded: DataFrame, grades: int, max_rows: int = 4_000, rounds: int = 300, l2: float = 1e-4) -> QualityModel:
    """Fit on graded texts: text and grade from 0 to grades - 1 (null grades are ignored).

    At most max_rows rows, the first by a hash of the text, are used: a documented bound. One
    weight vector is shared by all grades; the thresholds stay in order because their steps are
    exponentials. Without rows all weights are 0.
    """
    rows = graded.filter("grade is not null").select("text", F.col("grade").cast("int").alias("grade"))
    fit = rows.orderBy(F.xxhash64("text"), "grade").limit(max_rows).mapInPandas(_featured, "grade int, index array<long>, value array<double>").toPandas()
    w, cuts = np.zeros(1 << BITS), np.r_[-1.0, np.full(max(0, grades - 2), 0.0)]
    if not len(fit):
        return QualityModel(w, np.arange(grades - 1, dtype=float))
    row = np.repeat(np.arange(len(fit)), fit["index"].map(len))
    at, x = np.concatenate(list(fit["index"])).astype(np.int64), np.concatenate(list(fit["value"])).astype(float)
    y = fit.grade.to_numpy()
    over = y[:, None] > np.arange(grades - 1)
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)
    for t in range(1, rounds + 1):
        steps = np.exp(cuts[1:])
        theta = cuts[0] + np.r_[0.0, np.cumsum(steps)]
        z = np.bincount(row, weights=x * w[at], minlength=len(y))
        above = np.c_[np.ones(len(y)), _sigmoid(z[:, None] - theta), np.zeros(len(y))]  # P(grade > k - 1)
        slope = above * (1 - above)
        p = np.maximum(above[np.arange(len(y)), y] - above[np.arange(len(y)), y + 1], 1e-9)
        dz = -(slope[np.arange(len(y)), y] - slope[np.arange(len(y)), y + 1]) / p / len(y)
        dtheta = np.array([((slope[:, k + 1] / p) * ((y == k + 1) * 1.0 - (y == k) * 1.0)).sum() / len(y) for k in range(grades - 1)])
        g = np.bincount(at, weights=x * dz[row], minlength=len(w)) + l2 * w
        gc = np.r_[dtheta.sum(), [dtheta[k + 1 :].sum() * steps[k] for k in range(grades - 2)]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mc, vc = 0.9 * mc + 0.1 * gc, 0.999 * vc + 0.001 * gc * gc
        rate = 0.1 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        cuts = cuts - rate / 2 * mc / (np.sqrt(vc / (1 - 0.999**t)) + 1e-8)
    return QualityModel(w, cuts[0] + np.r_[0.0, np.cumsum(np.exp(cuts[1:]))])


def score_quality(docs: DataFrame, model: QualityModel, tail: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, expected_grade, tail_probability and kept.

    tail_probability is that of a grade of `tail` or more; rows stay where it is `least` or more.
    Null and empty texts have no features and get the thresholds' own probabilities. Ids may be of any type, null or
    repeated; an empty table gives an empty result; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        (weights, theta), buckets, shapes = shared.value, Buckets(), {}
        for batch in batches:
            found = (text_features(t, buckets, shapes) for t in batch)
            z = np.array([float(weights[i] @ v) for i, v in found])
            above = _sigmoid(z[:, None] - theta)
            yield pd.DataFrame({"expected_grade": above.sum(axis=1), "tail_probability": above[:, tail - 1]})

    out = docs.select(F.col(id_col), grade(F.col(text_col)).alias("g"))
    return out.select(id_col, "g.expected_grade", "g.tail_probability", (F.col("g.tail_probability") >= least).alias("kept"))
