"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ORDERS, BITS = (3, 4, 5), 18
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # of every hash bucket: log-count ratio times learned weight
    bias: float


def ngram_buckets(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Hash buckets of the distinct character n-grams of a whole text, A-Z lower-cased.

    N-grams are taken over UTF-8 bytes with a space at either end. flags: a cleared boolean
    array of all buckets, cleared again on return.
    """
    data = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" ", dtype=np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            count = len(data) - n + 1
            if count < 1:
                continue
            h = np.zeros(count, dtype=np.uint64)
            for k in range(n):
                h = (h << np.uint64(8)) | data[k : count + k]
            h = (h + np.uint64(n)) * _MUL
            flags[h >> np.uint64(64 - BITS)] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flags, counts, rows = np.zeros(1 << BITS, dtype=bool), np.zeros((2, 1 << BITS), dtype=np.int64), [0, 0]
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            counts[int(label)][ngram_buckets(text, flags)] += 1
            rows[int(label)] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": np.r_[-1, used], "clean": np.r_[rows[0], counts[0][used]], "toxic": np.r_[rows[1], counts[1][used]]})


def _selected(chosen):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, keep = np.zeros(1 << BITS, dtype=bool), chosen.value
        for batch in batches:
            found = [b[keep[b]].astype(np.int32) for b in (ngram_buckets(t, flags) for t in batch["text"])]
            yield pd.DataFrame({"label": batch["label"].to_numpy(), "buckets": pd.Series(found, dtype=object)})

    return run


def count_ratios(clean: np.ndarray, toxic: np.ndarray, rows: tuple[int, int], smoothing: float, least_ratio: float) -> np.ndarray:
    """Naive Bayes log-count ratio of every bucket, from how many clean and toxic rows hold it and how many there are; small ones are 0."""
    prior = rows[1] / sum(rows)
    # smoothing adds rows in the classes' shares, so that a rare bucket's ratio stays near 0
    p, q = (toxic + smoothing * prior) / (prior * smoothing + rows[1]), (clean + smoothing * (1 - prior)) / ((1 - prior) * smoothing + rows[0])
    ratio = np.where(clean + toxic > 0, np.log(p) - np.log(q), 0.0)
    ratio[np.abs(ratio) < least_ratio] = 0
    return ratio


def learn_weights(y: np.ndarray, flat: np.ndarray, row: np.ndarray, ratio: np.ndarray, prior: float, l2: float, rounds: int, step: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights of every bucket and the bias: logistic regression by Adam on the mean loss. flat and row: the buckets of all rows, and whose each is."""
    x = ratio[flat]
    w, bias = np.full(len(ratio), 0.05), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, weights=x * w[flat], minlength=len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(flat, weights=x * err[row], minlength=len(w)) + l2 * w * (ratio != 0) / 100
        gb = float(err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = step / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= 5 * rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return ratio * w, bias


def fit_toxicity(labelled: DataFrame, max_rows: int = 12_000, fit_rows: int = 4_000, smoothing: float = 60.0, least_ratio: float = 0.6, l2: float = 2e-2, rounds: int = 300) -> ToxicityModel:
    """Fit on labelled rows: text and label (0 or 1; null labels are ignored, null text is empty).

    At most max_rows rows, the first by a hash of the text, give the log-count ratios, and at
    most fit_rows of them the weights; both bounds are parameters, and only hash buckets with a
    ratio of least_ratio or more (either way) are used. Without rows of both classes every score
    is the share of toxic rows, 0 without any rows. For the other settings see `cross_validate`.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("label is not null").select("text", F.col("label").cast("int").alias("label"))
    # the sample of one sort lies in one task; featurising it is spread again
    rows = rows.orderBy(F.xxhash64(F.lit(5), "text"), "label").limit(max_rows).repartition(spark.sparkContext.defaultParallelism).persist()
    stats = rows.mapInPandas(_class_counts, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    sums = stats[stats.bucket < 0]
    clean, toxic = (int(sums.clean.iloc[0]), int(sums.toxic.iloc[0])) if len(sums) else (0, 0)
    prior = toxic / max(1, clean + toxic)
    if not clean or not toxic:
        return ToxicityModel(np.zeros(1 << BITS), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
    stats = stats[stats.bucket >= 0]
    counts = np.zeros((2, 1 << BITS))
    counts[:, stats.bucket] = stats.clean, stats.toxic
    ratio = count_ratios(*counts, (clean, toxic), smoothing, least_ratio)
    chosen = spark.sparkContext.broadcast(ratio != 0)
    fit = rows.orderBy(F.xxhash64(F.lit(3), "text"), "label").limit(fit_rows).repartition(spark.sparkContext.defaultParallelism).mapInPandas(_selected(chosen), "label int, buckets array<int>").toPandas()
    rows.unpersist()
    flat, row = _flattened(fit.buckets)
    return ToxicityModel(*learn_weights(fit.label.to_numpy(dtype=float), flat, row, ratio, prior, l2, rounds))


def _flattened(buckets) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(b) for b in buckets], dtype=np.int64)
    flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in buckets]) if lengths.sum() else np.empty(0, dtype=np.int64)
    return flat, np.repeat(np.arange(len(lengths)), lengths)


#: Settings that were compared, named before the first comparison was run: every combination.
GRID = {"smoothing": (20.0, 60.0), "least_ratio": (0.6, 1.2), "l2": (2e-3, 2e-2), "rounds": (150, 300)}


def settings_of(grid: dict[str, tuple]) -> list[dict[str, float]]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def cross_validate(labelled: DataFrame, grid: dict[str, tuple] = GRID, folds: int = 3, max_rows: int = 4_000) -> DataFrame:
    """Nested validation of settings inside labelled rows (text, label): outer, inner, setting, rows, loss and errors.

    Rows fall into `folds` outer and inner folds by hashes of their text. Each setting is fitted without the rows of the outer and the
    inner fold and judged on the inner fold's others: sum of log losses, and errors at 0.7. outer -1 leaves nothing out, which chooses
    the setting for all rows; inner -1 is fitted without the outer fold and judged on it, which tells what choosing is worth. At most max_rows rows
    are used, the first by a hash of the text; their buckets are broadcast, and fits are dealt to tasks.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("label is not null").select("text", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64(F.lit(5), "text"), "label").limit(max_rows)
    fold = [F.pmod(F.xxhash64(F.lit(k), "text"), F.lit(folds)).cast("int").alias(name) for k, name in ((11, "outer"), (12, "inner"))]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            yield batch.drop(columns="text").assign(buckets=[ngram_buckets(t, flags).astype(np.int32) for t in batch["text"]])

    sample = rows.repartition(spark.sparkContext.defaultParallelism).select("text", "label", *fold).mapInPandas(features, "label int, outer int, inner int, buckets array<int>").toPandas()
    sample["buckets"] = [np.asarray(b, dtype=np.int32) for b in sample.buckets]
    shared, settings = spark.sparkContext.broadcast(sample), settings_of(grid)
    jobs = [(o, i, k) for o in range(-1, folds) for i in range(-1, folds) for k in range(len(settings)) if o >= 0 or i >= 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = shared.value
        y = data.label.to_numpy(dtype=float)
        for batch in batches:
            for o, i, k in batch.itertuples(index=False):
                out_o, out_i = (data.outer == o).to_numpy(), (data.inner == i).to_numpy()
                train, test = ~out_o & ~out_i, out_o if i < 0 else out_i & ~out_o
                some, how = data.buckets[train], settings[k]
                counts, n = np.zeros((2, 1 << BITS)), [0, 0]
                for b, label in zip(some, data.label[train]):
                    counts[label][b] += 1
                    n[label] += 1
                if not all(n) or not test.any():
                    continue
                ratio = count_ratios(*counts, tuple(n), how["smoothing"], how["least_ratio"])
                flat, row = _flattened([b[ratio[b] != 0] for b in some])
                w, bias = learn_weights(y[train], flat, row, ratio, n[1] / sum(n), how["l2"], int(how["rounds"]))
                p = np.clip(1 / (1 + np.exp(-np.clip([bias + w[b].sum() for b in data.buckets[test]], -40, 40))), 1e-9, 1 - 1e-9)
                loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).sum()
                yield pd.DataFrame({"outer": [o], "inner": [i], "setting": [k], "rows": [int(test.sum())], "loss": [float(loss)], "errors": [int(((p >= 0.7) != (y[test] == 1)).sum())]})

    table_ = spark.createDataFrame(jobs, "outer int, inner int, setting int").repartition(len(jobs))
    return table_.mapInPandas(run, "outer int, inner int, setting int, rows int, loss double, errors int")


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that each row's whole text is toxic. Rows aren't moved, and only the text is read for it.

    Null and empty texts score as a text without n-grams does; an empty table stays empty. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags, (weights, bias) = np.zeros(1 << BITS, dtype=bool), shared.value
        for batch in batches:
            z = np.array([bias + weights[ngram_buckets(t, flags)].sum() for t in batch])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return docs.withColumn(name, score(F.col(text_col)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col and score, as `with_toxicity` has it. Ids may be of any type, null or repeated; they aren't looked at."""
    return with_toxicity(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text").select(F.col("_id").alias(id_col), "score")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, train_only) -> DataFrame:
    """Texts of at most max_rows labelled rows, the first by a hash of the id: text, label, doc_id.

    The labels' ids, bounded by max_rows, are broadcast; documents are not shuffled.
    """
    some = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train_only).groupBy("doc_id").agg(F.max(label).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label", "doc_id")


def toxicity_model(spark, sf_dir: str, train_only, max_rows: int = 12_000) -> ToxicityModel:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit_toxicity(labelled_sample(docs, labels, "toxic", max_rows, train_only), max_rows)
