"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk of a linear model.

Trusted positives are rows labelled 1; the unlabelled are rows without a label. With the class prior p and the sigmoid
loss l(z) = 1 / (1 + e^z), which is bounded, so that far rows do not outweigh an error of the prior, the risk is p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]); where the second term falls below 0, the step
goes against it instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, small_batches

UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|<>{}[]=\\/@^~+_`\""
FEATURES = ("upper", "symbols", "exclamations", "bars", "digits", "distinct words", "repeated neighbours", "repeated triples", "word length", "words", "lines", "stops", "commas")
#: Rows that a fit uses at most, of either kind, the same ones each time.
MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000


def features(text: str | None) -> list[float]:
    """What ``FEATURES`` names, as shares of bytes or words, on a logarithmic scale; an empty text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    triples = set(zip(words, words[1:], words[2:], strict=False))
    x = [
        share(UPPER), share(SYMBOLS), raw.count(b"!") / n, raw.count(b"|") / n, share(b"0123456789"),
        1 - len(set(words)) / m if words else 0.0, sum(map(bytes.__eq__, words, words[1:])) / m, 1 - len(triples) / (m - 2) if len(words) > 2 else 0.0,
        len(raw) / m / 100, len(words) / 100_000, raw.count(b"\n") / m, raw.count(b".") / m, raw.count(b",") / m,
    ]
    return np.log1p(100 * np.array(x)).tolist()


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher: label 1 is likelier."""
        g = ((x - self.centre) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 2000, rate: float = 0.05, decay: float = 1e-6) -> Model:
    """Minimises the non-negative risk by Adam over all rows at each step."""
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (positive - centre) / scale, (unlabelled - centre) / scale
    w = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        rest = su.mean() - prior * sp.mean()
        at_p = prior * ((sp * (1 - sp))[:, None] * p).mean(axis=0)
        rest_slope = ((su * (1 - su))[:, None] * u).mean(axis=0) - at_p
        slope = rest_slope - at_p if rest >= 0 else -rest_slope
        slope = slope + decay * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(centre, scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled, by best-bin estimation: a linear model tells positives from unlabelled
    rows on one half of the rows; on the other, the least ratio of unlabelled to positive rows above a score counts, the
    score being chosen with regard to how many rows there are. 0.5 where there are too few rows to halve."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    model = fit_logistic(positive[::2], unlabelled[::2])
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    above_p = (len(p) - np.arange(len(p))) / len(p)
    above_u = (len(u) - np.searchsorted(u, p)) / len(u)
    error = sum(math.sqrt(math.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    best = int(np.argmin((above_u + (1 + slack) * error) / above_p))
    return float(min(1.0, above_u[best] / above_p[best]))


def fit_logistic(positive: np.ndarray, other: np.ndarray, steps: int = 500, rate: float = 0.05) -> Model:
    """A logistic model that weighs both kinds of rows alike."""
    both = np.concatenate([positive, other])
    centre, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    x = np.c_[(both - centre) / scale, np.ones(len(both))]
    y = np.r_[np.ones(len(positive)), np.zeros(len(other))]
    share = np.where(y == 1, 0.5 / len(positive), 0.5 / len(other))
    w, first, second = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        slope = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(centre, scale, w[:-1], float(w[-1]), 0.5)


def with_features(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with an array column ``_x``."""
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([features(x) for x in b.column(at).to_pylist()], pa.list_(pa.float64()))], [*names, "_x"])

    return docs.mapInArrow(run, docs.withColumn("_x", F.lit(None).cast("array<double>")).schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from rows that are not held out: at most ``max_positive`` labelled 1 and ``max_unlabelled`` unlabelled, the
    same ones each time.

    The prior is estimated from the two samples. Without positives or unlabelled rows the model scores every text 0.5. An
    id that is labelled both 1 and 0 counts as positive; of rows with one id the smallest text is learnt from; rows
    without id or label are not positives. Long texts count whole.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    learnt = known.where(~held_out(F.col("_key")))
    turn = F.xxhash64("_key", F.lit(11))
    positive = learnt.where("_label = 1").select("_key").distinct().orderBy(turn).limit(max_positive)
    ids = docs.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull() & ~held_out(F.col("_key"))).distinct()
    unlabelled = ids.join(known, "_key", "left_anti").orderBy(turn).limit(max_unlabelled)
    wanted = positive.withColumn("_is", F.lit(1)).unionByName(unlabelled.withColumn("_is", F.lit(0)))
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(wanted), "_key")  # at most max_positive + max_unlabelled ids
    chosen = chosen.groupBy("_key", "_is").agg(F.min("_text").alias("_text"))  # one row for each id, however often it occurs
    rows = with_features(chosen.drop("_key"), "_text").select("_is", "_x").collect()
    p, u = (np.array([r["_x"] for r in rows if r["_is"] == k]).reshape(-1, len(FEATURES)) for k in (1, 0))
    if not len(p) or not len(u):
        k = len(FEATURES)
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.5)
    return fit_risk(p, u, estimated_prior(p, u))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the score of each whole text (null counts as empty). A column of this name is replaced."""
    small_batches(docs.sparkSession)
    rows = docs.drop(out)
    at, names = rows.columns.index(text), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("double")).schema)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with a score of ``threshold`` or more, columns as given; null texts are scored as empty ones."""
    model, out = fit(docs, labels, key, text), fresh(docs, "_score")
    return score(docs, model, text, out).where(F.col(out) >= threshold).drop(out)
