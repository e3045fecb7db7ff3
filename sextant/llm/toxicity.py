"""Toxicity by non-negative positive-unlabelled learning: numpy classifiers from confirmed toxic texts and unlabelled ones.

Positives are texts labelled 1; the unlabelled sample is the whole corpus, its labels unread. Words and word beginnings are
counted over all of it; those that positives have far more often than the corpus are the features. With the class prior p
and the sigmoid loss l(z) = 1 / (1 + e^z) the risk is p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]); where the second
term falls below 0, the step goes against it. One classifier is trained in each bag of the corpus, and their weights are
averaged, so that every text is learnt from and no task holds more than a bag.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, written

WORD = re.compile(r"\w+")
#: Word beginnings that count, in characters.
PREFIXES = (3, 4, 5)
#: Confirmed texts that a fit uses at most, the same ones each time.
MAX_POSITIVE = 8_000
#: Terms of positive texts that are counted over the corpus: the most frequent ones, in at least so many texts.
CANDIDATES = 20_000
LEAST_TEXTS = 3
#: Terms that a classifier reads, all of them so many standard deviations more frequent in positives; texts of a bag.
TERMS = 128
LEAST_Z = 4.0
BAG_ROWS = 8_192
#: Words whose terms a task remembers.
REMEMBERED = 500_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked by '^'."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def finder(known: dict[str, int]) -> Callable[[str | None], tuple[Counter, int]]:
    """How often each known term, by its number, is in a whole text, and the words of the text."""
    numbers: dict[str, list[int]] = {}

    def find(text: str | None) -> tuple[Counter, int]:
        words = WORD.findall((text or "").lower())
        found: Counter = Counter()
        for word, n in Counter(words).items():
            at = numbers.get(word)
            if at is None:
                if len(numbers) >= REMEMBERED:
                    numbers.clear()
                at = numbers[word] = [known[t] for t in terms_of(word) if t in known]
            for i in at:
                found[i] += n
        return found, len(words)

    return find


def vector(found: Counter, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the terms that occur, and the logarithm of their share among the words."""
    at = np.array(sorted(found), dtype=np.uint16)
    return at, np.log1p(100 * np.array([found[i] for i in at.tolist()], dtype=np.float32) / max(1, words)).astype(np.float32)


VECTORS = "bag int, at binary, x binary"


def vectors(place: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bag, text) as ``VECTORS``: the numbers of a text's terms and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(place)
        for b in batches:
            found = [vector(*find(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([v[k].tobytes() for v in found], pa.binary()) for k in (0, 1))], ["bag", "at", "x"])

    return run


def dense(rows: list[tuple[bytes, bytes]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, (at, x) in enumerate(rows):
        out[i, np.frombuffer(at, np.uint16)] = np.frombuffer(x, np.float32)
    return out


@dataclass
class Model:
    terms: list[str]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.centre) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def fit_risk(p: np.ndarray, u: np.ndarray, weight: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias that minimise the non-negative risk; ``weight`` tells how many texts a row of ``u`` stands for."""
    p, u = (np.c_[x, np.ones(len(x))] for x in (p, u))
    share = weight / weight.sum()
    w, first, second = (np.zeros(p.shape[1]) for _ in range(3))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        rest = su @ share - prior * sp.mean()
        at_p = prior * ((sp * (1 - sp)) @ p) / len(p)
        rest_slope = (su * (1 - su) * share) @ u - at_p
        slope = (rest_slope - at_p if rest >= 0 else -rest_slope) + decay * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(in_positive: np.ndarray, in_corpus: np.ndarray, n_positive: int, n_corpus: int, doubt: float = 0.1) -> float:
    """The share of positives in the corpus: no set of texts has a smaller share of the corpus, over its share of the
    positives, than that. The sets are the texts with a term; of all terms the one with the least upper bound is taken."""
    if not len(in_positive) or not n_corpus:
        return 0.5
    p, u = in_positive / n_positive, in_corpus / n_corpus
    slack = sum(math.sqrt(math.log(4 * len(p) / doubt) / (2 * n)) for n in (n_positive, n_corpus))
    best = int(np.argmin((u + slack) / p))
    return float(min(1.0, max(u[best] / p[best], 1 / n_corpus)))


def positives(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(text) of at most ``most`` documents labelled 1 and not held out, one for each id: that with the smallest text."""
    ids = labels.where((F.col(label) == 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_key")).distinct()
    chosen = ids.orderBy(F.xxhash64("_key", F.lit(12)), "_key").limit(most)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key")  # at most ``most`` ids
    return rows.groupBy("_key").agg(F.min("_text").alias("_text")).select("_text")


def text_counts(texts: DataFrame, known: list[str]) -> tuple[np.ndarray, int]:
    """In how many of the texts each known term is, and how many texts there are."""
    place = {t: i for i, t in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, have, n = finder(place), np.zeros(len(place) + 1, dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for x in b.column(0).to_pylist():
                have[list(find(x)[0])] += 1
        have[-1] = n
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], ["term", "n"])

    found = texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each candidate
    have = np.zeros(len(place) + 1, dtype=np.int64)
    for r in found:
        have[r["term"]] = r["n"]
    return have[:-1], int(have[-1])


def frequent_terms(texts: DataFrame, candidates: int) -> tuple[list[str], np.ndarray]:
    """The ``candidates`` most frequent terms of the texts, and the number of texts that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                own = sorted({t for w in set(WORD.findall(x.lower())) for t in terms_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["term"])

    counts = texts.mapInArrow(run, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    rows = counts.orderBy(F.col("n").desc(), "term").limit(candidates).collect()
    return [r["term"] for r in rows], np.array([r["n"] for r in rows], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, candidates: int = CANDIDATES, n_terms: int = TERMS, bag_rows: int = BAG_ROWS) -> Model | None:
    """A model from rows that are not held out; None without positives.

    At most ``max_positive`` labelled texts are learnt from, the same ones each time; the unlabelled side is every text.
    An id that is labelled both 1 and 0 counts as positive; of rows with one id the smallest text is learnt from as a
    positive, all of them as unlabelled; labels without id or value are left out. Null texts count as empty ones and
    long texts whole; other columns of ``docs`` play no part. An empty table, or labels of no document, give None.
    """
    small_batches(docs.sparkSession)
    toxic = written(positives(docs, labels, key, text, label, max_positive), "positives")
    n_positive = toxic.count()
    if not n_positive:
        return None
    names, in_positive = frequent_terms(toxic, candidates)
    corpus = docs.where(~held_out(F.col(key))).select(text)
    in_corpus, n_corpus = text_counts(corpus, names)
    p, u = in_positive / n_positive, in_corpus / n_corpus
    both = (in_positive + in_corpus) / (n_positive + n_corpus)
    spread = np.sqrt(both * (1 - both) * (1 / n_positive + 1 / n_corpus)) + 1e-12
    z = (p - u) / spread
    best = np.array([i for i in np.lexsort((names, -z))[:n_terms] if z[i] >= LEAST_Z] if names else [], dtype=int)
    terms = [names[i] for i in best]
    prior = estimated_prior(in_positive[best], in_corpus[best], n_positive, n_corpus)
    place = {t: i for i, t in enumerate(terms)}
    found = toxic.select(F.lit(0).alias("bag"), "_text").mapInArrow(vectors(place), VECTORS).collect()  # at most ``max_positive`` rows of ``n_terms`` numbers
    x = dense([(r["at"], r["x"]) for r in found], len(terms))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = trained(corpus, place, (x - centre) / scale, centre, scale, prior, max(1, math.ceil(n_corpus / bag_rows)))
    return Model(terms, centre, scale, w[:-1], float(w[-1]), prior)


def trained(corpus: DataFrame, place: dict[str, int], p: np.ndarray, centre: np.ndarray, scale: np.ndarray, prior: float, bags: int) -> np.ndarray:
    """The mean of the weights that the bags' classifiers have found, by their texts. A row's bag is the hash of its place in
    the scan, so that repeated rows never meet in one bag; texts of a bag with equal vectors are one row with a weight."""

    def train(t: pa.Table) -> pa.Table:
        rows = Counter(zip(t.column("at").to_pylist(), t.column("x").to_pylist(), strict=True))
        u = dense(sorted(rows), len(place))
        weight = np.array([rows[k] for k in sorted(rows)], dtype=float)
        w = fit_risk(p, (u - centre) / scale, weight, prior)
        return pa.table({"i": pa.array(range(len(w)), pa.int32()), "w": pa.array(w * t.num_rows, pa.float64()), "n": pa.array([t.num_rows] * len(w), pa.int64())})

    bag = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(bags)).cast("int").alias("bag")
    rows = corpus.select(bag, corpus.columns[0]).mapInArrow(vectors(place), VECTORS)
    found = rows.groupBy("bag").applyInArrow(train, "i int, w double, n long").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()  # a row for each weight
    return np.array([r["w"] for r in sorted(found, key=lambda r: r["i"])])


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out`` from 0 to 1, higher: toxic is likelier; null counts as the empty text, and a column named like
    ``out`` is replaced. Equal texts have equal scores. Without a model, that is without any confirmed text, all have 0."""
    small_batches(docs.sparkSession)
    rows = docs.drop(out)
    if model is None:
        return rows.withColumn(out, F.lit(0.0))
    at_text, names = rows.columns.index(text), rows.columns
    place = {t: i for i, t in enumerate(model.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(place)
        for b in batches:
            x = np.zeros((b.num_rows, len(place)))
            for i, t in enumerate(b.column(at_text).to_pylist()):
                at, values = vector(*find(t))
                x[i, at] = values
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("double")).schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with a score below ``threshold``, columns as given."""
    model, out = fit(docs, labels, key, text), fresh(docs, "_score")
    return score(docs, model, text, out).where(F.col(out) < threshold).drop(out)
