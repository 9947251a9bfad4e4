"""Quality classifier: a weak-label model, and a hashed linear scorer that learns from it.

Overlapping heuristic labellers vote good, bad or nothing on each whole text. Expectation-
maximisation over the counts of all documents' vote patterns (at most 3^labellers, whatever the input) estimates
how each labeller errs and gives each pattern the posterior of being good. A logistic scorer over
hashed features (byte trigrams and binned text statistics) learns those posteriors on at most
``SAMPLE`` distinct documents, the ones with the smallest hash of id and text, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import gram_counts, prefix_hash, slices, span_hash, split_runs, utf8
from .storage import aside, wider

DIM = 2048
SAMPLE = 4000
_ROWS = 256
#: Words of a window in which repeated words are counted; a longer text has several of equal length.
WINDOW = 600
_BYTES = np.arange(256)
_UPPER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_ALPHA = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Marks that prose has few of; sentence punctuation, quotes, brackets and hyphens are not among them.
_MARK = ~(_ALPHA | _DIGIT | _BLANK) & ~np.isin(_BYTES, [ord(c) for c in ".,;:?'\"()-"]) & (_BYTES > 32)
#: Statistics: (name, bad from, good up to); a share above the first is a vote for bad, one below the second for good.
LABELLERS = (
    ("marks", 0.03, 0.01),
    ("capitals", 0.30, 0.12),
    ("digits", 0.20, 0.08),
    ("word_length", 11.0, 8.5),
    ("marked_words", 0.08, 0.02),
    ("repeated_words", 0.80, 0.60),
    ("same_word_twice", 0.10, 0.03),
    ("repeated_lines", 0.50, 0.20),
    ("no_sentences", 0.99, 0.96),
)


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text, in the order of LABELLERS; all are 0 for an empty text."""
    size = np.diff(offsets)
    start, end, first = split_runs(~_BLANK[data], offsets)
    words = np.maximum(np.diff(first), 1)
    prefix = prefix_hash(data)
    word = span_hash(prefix, start, end)
    row = np.repeat(np.arange(len(size)), np.diff(first))
    marks = np.concatenate(([0], np.cumsum(_MARK[data])))
    full = np.concatenate(([0], np.cumsum((data == 46) | (data == 63))))
    twice = np.zeros(len(word), bool)
    twice[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    windows = -(-words // WINDOW)
    window = (np.cumsum(windows) - windows)[row] + (np.arange(len(word)) - first[:-1][row]) * windows[row] // words[row]
    order = np.lexsort((word, window))
    seen = np.zeros(len(word), bool)
    seen[1:] = (word[order][1:] == word[order][:-1]) & (window[order][1:] == window[order][:-1])
    ls, le, lf = split_runs(data != 10, offsets)
    lrow, lh = np.repeat(np.arange(len(size)), np.diff(lf)), span_hash(prefix, ls, le)
    lo = np.lexsort((lh, lrow))
    lseen = np.zeros(len(lh), bool)
    lseen[1:] = (lh[lo][1:] == lh[lo][:-1]) & (lrow[lo][1:] == lrow[lo][:-1])
    lines = np.maximum(np.diff(lf), 1)
    letters = np.maximum(_per_row(_ALPHA[data], offsets), 1)
    some = np.minimum(1, np.diff(first) / 30)  # the shares below say little about a few words
    return np.stack((
        _per_row(_MARK[data], offsets) / np.maximum(size, 1) * some,
        _per_row(_UPPER[data], offsets) / letters * some,
        _per_row(_DIGIT[data], offsets) / np.maximum(size, 1) * some,
        _per_row(end - start, first) / words * some,
        _per_row(marks[end] - marks[start] > 0, first) / words * some,
        _per_row(seen, first) / words * some,
        _per_row(twice, first) / words * some,
        _per_row(lseen, lf) / lines * np.minimum(1, lines / 6),
        (1 - _per_row(full[end] - full[start] > 0, first) / words) * some,
    ), 1)


def votes(stats: np.ndarray) -> np.ndarray:
    """0 bad, 1 nothing, 2 good."""
    bad, good = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
    return np.where(stats > bad, 0, np.where(stats <= good, 2, 1))


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def features(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Hashed features with length 1: trigrams in the lower half, binned statistics in the upper half."""
    grams = np.sqrt(gram_counts(data, offsets, DIM // 2))
    grams /= np.maximum(np.sqrt((grams * grams).sum(1, keepdims=True)), 1e-9)
    scale = np.array([x[1] for x in LABELLERS])
    bins = np.minimum(stats / scale * 8, 16).astype(np.int64)
    at = (bins + 1 + 41 * np.arange(stats.shape[1])) * 0x9E3779B1 % (1 << 32) * (DIM // 2) >> 32
    out = np.zeros((len(stats), DIM), np.float32)
    out[:, : DIM // 2] = grams
    np.add.at(out, (np.repeat(np.arange(len(stats)), stats.shape[1]), DIM // 2 + at.ravel()), 0.5)
    return out


class WeakLabels(NamedTuple):
    prior: float
    #: accuracy[c, j, v]: how often labeller j votes v on texts of class c (0 bad, 1 good).
    rates: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        log = [np.log(p) + np.log(self.rates[c][np.arange(v.shape[1]), v]).sum(1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def expectation_maximisation(v: np.ndarray, count: np.ndarray, rounds: int = 60) -> WeakLabels:
    """``v``: distinct vote patterns, ``count``: the documents with each. Starts where one vote for bad beats all others."""
    good = np.where((v == 0).any(1), 0.1, 0.9)
    model = WeakLabels(0.5, np.full((2, v.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        prior = float(np.clip((good * count).sum() / max(count.sum(), 1), 0.01, 0.99))
        rates = np.empty((2, v.shape[1], 3))
        for c, w in ((0, (1 - good) * count), (1, good * count)):
            for k in range(3):
                rates[c, :, k] = ((v == k) * w[:, None]).sum(0) + 0.5
            rates[c] /= rates[c].sum(1, keepdims=True)
        model = WeakLabels(prior, rates)
        good = model.posterior(v)
    return model


class Scorer(NamedTuple):
    labels: WeakLabels
    weights: np.ndarray
    bias: float


def _vote_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in slices(batches):
        pattern, n = np.unique(_pattern(votes(statistics(*utf8(batch.column("text"))))), return_counts=True)
        for p, k in zip(pattern.tolist(), n.tolist(), strict=True):
            total[p] = total.get(p, 0) + k
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["pattern", "n"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, rows=_ROWS):
        data, offsets = utf8(batch.column("text"))
        stats = statistics(data, offsets)
        x = features(data, offsets, stats)
        yield pa.RecordBatch.from_arrays([pa.array(_pattern(votes(stats)), pa.int64()), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["pattern", "x"])


def _unpack(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learn from ``docs`` (doc_id, text) without any labels. Null and repeated ids are fine; no documents give a scorer that is 0.5 throughout."""
    docs = docs.select("doc_id", "text")
    seen = docs.select("text").mapInArrow(_vote_counts, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    labels = expectation_maximisation(_unpack(np.array([r.pattern for r in seen], np.int64)), np.array([r.n for r in seen], float))
    # The ``sample`` smallest of the distinct hashes of id and text: rows that share an id differ by text, and rows alike in both count once.
    hashed = docs.select("text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    cut = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(cut)).groupBy("h").agg(F.first("text").alias("text")).select("text")
    rows = chosen.mapInArrow(_featurise, "pattern long, x binary").orderBy("pattern", "x").collect()
    weights, bias = np.zeros(DIM), 0.0
    if rows:
        x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
        y = labels.posterior(_unpack(np.array([r.pattern for r in rows], np.int64)))
        weights, bias = train(x, y)
    return Scorer(labels, weights, bias)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; both classes weigh the same."""
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    weight /= weight.sum()
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * vw) + b + 0.9 * vb, -60, 60))) - y) * weight
        vw = 0.9 * vw - rate * ((error @ x) + decay * w).astype(np.float32)
        vb = 0.9 * vb - rate * float(error.sum())
        w, b = w + vw, b + vb
    return w.astype(float), float(b)


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """``docs`` with ``weak_label`` (the label model's posterior) and ``quality`` (the scorer's probability of good).

    A null or empty text has no votes for bad and gets the scores of an empty text. Input columns of these names are replaced.
    """
    docs = docs.drop("weak_label", "quality")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text, rows=_ROWS):
            data, offsets = utf8(batch.column(text))
            stats = statistics(data, offsets)
            logit = features(data, offsets, stats) @ m.weights.astype(np.float32) + m.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.labels.posterior(votes(stats))), pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))).astype(float))], names=[*names, "weak_label", "quality"])

    df = docs.toDF(*names)
    return df.mapInArrow(run, wider(df, "weak_label double", "quality double")).toDF(*docs.columns, "weak_label", "quality")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a quality of ``threshold`` or more, with the columns of ``docs``."""
    plain, restored = aside(docs, "doc_id", "text")
    return restored(score(plain, fit(plain)).where(F.col("quality") >= threshold))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs)).select("doc_id", "weak_label", "quality", (F.col("quality") >= 0.5).alias("keep"))


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict[str, str] = {}
