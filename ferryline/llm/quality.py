"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each document gives a short vector of transformed statistics.  Each class has a mean and a covariance,
shrunk towards the pooled one and towards its own mean variance; their Cholesky factors are computed once
and sent along.  The log odds are the difference of the two log densities (Mahalanobis distance and log
determinant) and log priors.  As they are far too sure of themselves, a logistic curve over them is fitted to the
labels of the rows that were learned from (Platt's way, from their histogram), and its value is the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, raw, text_only, unlike

#: Least shrinkage towards the pooled covariance, then towards the mean variance; few rows shrink more.
TO_POOLED, TO_SPHERE = 0.1, 0.05
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"])
_MARKS = np.frombuffer(b".,;:'\"-()?", np.uint8)
_NAMES = ("log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "white", "marks", "symbols", "wide", "distinct_words", "same_next", "distinct_lines", "words_a_line", "entropy", "caps_words", "tails")
DIM = len(_NAMES)


def statistics(text: bytes | None) -> np.ndarray:
    """Transformed statistics of a text; all zero but for the constants' transforms if it has no words."""
    text = text or b""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda k: float(k) / max(1, n)
    words = text.split()
    n_words = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n_words)
    lines = [x for x in text.split(b"\n") if x]
    p = count[count > 0] / max(1, n)
    root = np.sqrt
    part = lambda k, of: float(k) / max(1, of)
    return np.array([
        np.log1p(n), np.log1p(n_words),
        np.log1p(sizes.mean()) if n_words else 0.0, np.log1p(sizes.std()) if n_words else 0.0,
        root(share(count[65:91].sum())), root(share(count[48:58].sum())), root(share(count[[9, 10, 11, 12, 13, 32]].sum())),
        root(share(count[_MARKS].sum())), root(share(count[_SYMBOLS].sum())), root(share(count[128:].sum())),
        part(len(set(words)), n_words) ** 2, root(part(sum(map(bytes.__eq__, words, words[1:])), n_words)),
        part(len(set(lines)), len(lines)), np.log1p(part(n_words, len(lines))),
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        root(part(sum(map(bytes.isupper, words)), n_words)), root(part(sum(not w[-1:].isalnum() and w[-1] < 128 for w in words), n_words)),
    ])


def _statistics(batches):
    for b in batches:
        x = np.array([statistics(t) for t in raw(b.column("text"))]).reshape(-1, DIM)
        flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, DIM, dtype=np.int32), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("id"), flat], ["id", "x"])


def _matrix(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM) if hasattr(column, "combine_chunks") else column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def _moments(batches):
    """Per task and class: count, sums and sums of products."""
    total = np.zeros((2, 1 + DIM + DIM * DIM))
    for b in batches:
        x, y = _matrix(b.column("x")), b.column("label").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
    k = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], k), pa.int32()), pa.array(np.tile(np.arange(k), 2), pa.int32()), pa.array(total.reshape(-1))], ["label", "k", "v"])


@dataclass
class QuadraticDiscriminant:
    """Means, inverse Cholesky factors and log terms of the two classes."""

    centre: np.ndarray
    scale: np.ndarray
    means: list
    factors: list
    logs: list
    #: The curve over the squeezed log odds.
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def of(cls, count: np.ndarray, sums: np.ndarray, products: np.ndarray) -> QuadraticDiscriminant | None:
        """From moments by class; None unless both classes have rows."""
        if not (count > 0).all():
            return None
        centre = sums.sum(0) / count.sum()
        second = products.sum(0) / count.sum() - np.outer(centre, centre)
        scale = np.sqrt(np.maximum(np.diag(second), 1e-9))
        means, covs = [], []
        for c in (0, 1):
            m = sums[c] / count[c]
            covs.append((products[c] / count[c] - np.outer(m, m)) / np.outer(scale, scale))
            means.append((m - centre) / scale)
        pooled = (count[0] * covs[0] + count[1] * covs[1]) / count.sum()
        factors, logs = [], []
        for c in (0, 1):
            a, b = max(TO_POOLED, DIM / (DIM + count[c])), max(TO_SPHERE, DIM / (DIM + count.sum()))
            s = (1 - a) * covs[c] + a * pooled
            s = (1 - b) * s + b * max(np.trace(s) / DIM, 1e-6) * np.eye(DIM)
            chol = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(chol))
            logs.append(np.log(count[c] / count.sum()) - np.log(np.diag(chol)).sum())
        return cls(centre, scale, means, factors, logs)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Squeezed by asinh, which keeps their order and their sign."""
        z = (x - self.centre) / self.scale
        log = [g - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, g in zip(self.means, self.factors, self.logs)]
        return np.arcsinh(log[1] - log[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(x) + self.shift, -700, 700)))

    def calibrated(self, at: np.ndarray, bad: np.ndarray, good: np.ndarray, rounds: int = 50) -> QuadraticDiscriminant:
        """With the curve of greatest likelihood for counts of bad and good rows at some squeezed log odds; the targets
        are those of Platt, short of 0 and 1, so that classes that don't overlap give a finite slope."""
        low, high = 1 / (bad.sum() + 2), (good.sum() + 1) / (good.sum() + 2)
        n, hits = bad + good, bad * low + good * high
        x, w = np.stack([at, np.ones(len(at))], 1), np.array([1.0, 0.0])
        loss = lambda w: float((n * np.logaddexp(0, x @ w) - hits * (x @ w)).sum())
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (hits - n * p))
            part = next((t for t in 0.5 ** np.arange(30) if loss(w + t * step) <= loss(w)), 0.0)
            w = w + part * step
            if np.abs(part * step).max() < 1e-9:
                break
        return replace(self, slope=max(float(w[0]), 1e-6), shift=float(w[1]))


#: Steps of the histogram of squeezed log odds to a unit.
STEPS = 64


def _histogram(model: QuadraticDiscriminant):
    """Per task: how many rows of each label have squeezed log odds in each step."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            counts.update(zip(np.round(model.log_odds(_matrix(b.column("x"))) * STEPS).astype(int).tolist(), b.column("label").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["step", "label", "n"])

    return run


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id bigint, x array<double>): the statistics of each row's whole text."""
    return text_only(df, id_col, text_col).mapInArrow(_statistics, "id bigint, x array<double>")


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 0 modulo 5; false for a null id, which has no label."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QuadraticDiscriminant | None:
    """Fit on every labelled row of ``rows`` (features) that is not held out; null or other labels are left out."""
    known = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("label IN (0, 1)")
    learned = checkpointed(rows.join(known.filter(~held_out("id")), "id").select("label", "x"))
    sums = learned.mapInArrow(_moments, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, 1 + DIM + DIM * DIM))
    for r in sums:
        m[r["label"], r["k"]] = r["v"]
    model = QuadraticDiscriminant.of(m[:, 0], m[:, 1 : 1 + DIM], m[:, 1 + DIM :].reshape(2, DIM, DIM))
    if model is None:
        return None
    found = learned.mapInArrow(_histogram(model), "step int, label int, n bigint").groupBy("step").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0).orderBy("step").collect()
    at, bad, good = np.array([tuple(r) for r in found], float).T
    return model.calibrated(at / STEPS, bad, good)


def _scores(model):
    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["id", "score"])

    return run


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row for each input row: the id (bigint), held_out, score (0 to 1) and predicted (1 from ``threshold`` up).

    The score comes from the text alone.  Null text counts as empty; repeated rows get a row each; labels
    that are null, repeated or without a document do no harm; if a class has no labelled rows, every score
    is 0.5.  An empty table gives an empty result; other columns are not read.
    """
    rows = checkpointed(features(df, id_col, text_col))
    out = rows.mapInArrow(_scores(fit(rows, labels, id_col, label_col)), "id bigint, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, all columns, that are predicted good; rows with one id are judged by the best of them.

    Null text counts as empty and is scored; repeated rows stay or go together; an empty table gives an empty result, and without
    labels of both classes every score is 0.5, which the threshold judges like any other.
    """
    name = unlike("good_id", df)
    good = quality_scores(df, labels, id_col, text_col, **options).filter("predicted = 1").select(F.col(id_col).alias(name)).distinct()
    return df.join(good, F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(name)), "left_semi")


def op8_query(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_scores(read("documents").select("doc_id", "text"), read("labels"))
