"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's rating is one of ordered grades 0 < 1 < .. < K-1.  All grades
share one weight vector over hashed text features; ordered thresholds cut the
score: ``P(grade <= k) = sigmoid(theta_k - score)``.  From that come the
expected grade and the tail probability ``P(grade >= good)``; a document is
selected when its tail probability reaches ``min_tail``.

The model is fitted on at most ``max_train`` labelled rows, drawn by a hash of
the id (the same rows on every run).  Scoring covers every row and the whole
text.  The fitted model is ``n_features`` + K - 1 doubles.

Defined results: a NULL or empty text has no features and scores 0; rows with
a NULL label or id do not train; of several labels for one id the lowest
grade counts; with no labels, or one grade only, every document is kept with
tail probability 1; equal rows score alike; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import map_rows

N_FEATURES = 1 << 16
MAX_TRAIN = 12_000
MIN_TAIL = 0.35
#: A feature of fewer training rows than this has weight zero.
MIN_ROWS = 5
#: So has one whose score test against the model without features is below this.
MIN_Z = 4.0
L2 = 0.3
STEPS = 200

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
RESULT = [T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()),
          T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.DoubleType()),
          T.StructField("kept", T.BooleanType())]


class Hasher(dict):
    """token -> feature numbers of the token (low half) and of its prefix (high
    half), remembered; the memory is bounded by clearing it."""

    def __init__(self, n_features: int):
        super().__init__()
        self.n = n_features

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        word = token.lower()
        k = self.number(word) | self.number(word[:4] + "*") << 32
        self[token] = k
        return k

    def number(self, s: str) -> int:
        return zlib.crc32(s.encode("utf-8", "surrogatepass")) % (self.n - 2) + 2


def features(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a whole text: log-damped counts of hashed
    tokens and of their first four letters; feature 0: share of words in
    capitals, feature 1: share of words that repeat the word before."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.fromiter(map(hasher.__getitem__, tokens), np.int64, len(tokens))
    k, n = np.unique(np.concatenate([ids & 0xFFFFFFFF, ids >> 32]), return_counts=True)
    caps = sum(map(str.isupper, tokens)) / len(tokens)
    again = float(np.count_nonzero(ids[1:] == ids[:-1])) / len(tokens)
    return np.concatenate(([0, 1], k)), np.concatenate(([10 * caps, 10 * again], np.log1p(n)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def grade_probabilities(score: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(rows, K): P(grade = k)."""
    upto = np.concatenate([_sigmoid(theta[None, :] - score[:, None]), np.ones((len(score), 1))], axis=1)
    return np.diff(np.concatenate([np.zeros((len(score), 1)), upto], axis=1), axis=1)


def fit(indptr: np.ndarray, idx: np.ndarray, val: np.ndarray, grade: np.ndarray, n_grades: int,
        n_features: int = N_FEATURES, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by Adam on the penalised likelihood; thresholds
    are ``theta_0, theta_0 + exp(gap_1), ..`` and so stay ordered.  Features are
    screened first by a score test, and scaled by log(rows / rows with it)."""
    n = len(grade)
    rows = np.repeat(np.arange(n), np.diff(indptr))
    share = np.clip(np.array([(grade <= k).mean() for k in range(n_grades - 1)]), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    edge = np.concatenate([[0.0], share, [1.0]])
    slope = np.array([1 - edge[k] - edge[k + 1] for k in range(n_grades)])[grade]  # d log p / d score at score 0
    slope = slope - slope.mean()
    held = np.bincount(idx[val > 0], minlength=n_features)
    mean = np.bincount(idx, val, minlength=n_features) / n
    spread = np.bincount(idx, val * val, minlength=n_features) / n - mean ** 2
    z = np.abs(np.bincount(idx, val * slope[rows], minlength=n_features)) / np.sqrt(
        np.maximum(n * spread * slope.var(), 1e-12))
    idf = np.where((held >= MIN_ROWS) & (z >= MIN_Z), np.log(1 + n / np.maximum(held, 1)), 0.0)
    use = idf[idx] > 0
    rows, idx, val = rows[use], idx[use], val[use] * idf[idx[use]]
    cuts = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    w = np.zeros(n_features)
    m, v = np.zeros(n_features + len(cuts)), np.zeros(n_features + len(cuts))
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        s = np.bincount(rows, w[idx] * val, minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _sigmoid(edges[grade + 1] - s), _sigmoid(edges[grade] - s)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gs = (dhi - dlo) / p  # d(-log p) / d score
        gt = np.array([-(dhi[grade == k] / p[grade == k]).sum() + (dlo[grade == k + 1] / p[grade == k + 1]).sum()
                       for k in range(n_grades - 1)])
        gc = np.concatenate([[gt.sum()], np.exp(cuts[1:]) * np.cumsum(gt[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(idx, gs[rows] * val, minlength=n_features) + l2 * w, gc]) / n
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w -= move[:n_features]
        cuts -= move[n_features:]
    return w * idf, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))


def training_sample(docs: DataFrame, labels: DataFrame, grade: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, grade) of at most ``2 * max_train`` labelled ids (about ``max_train``),
    by id hash; of an id on several rows the text with the least hash."""
    rated = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), grade.cast("int").alias("grade"))
             .where("doc_id IS NOT NULL AND grade IS NOT NULL")
             .groupBy("doc_id").agg(F.min("grade").alias("grade")))
    n = rated.count()
    share = int((1 << 20) * min(1.0, max_train / max(n, 1)))
    chosen = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < share)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    # The chosen labels are bounded by max_train, so they may be broadcast.
    named = texts.join(F.broadcast(chosen.orderBy(F.xxhash64("doc_id")).limit(2 * max_train)), "doc_id")
    return named.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, grade: Column, max_train: int = MAX_TRAIN,
          n_features: int = N_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the bounded sample; features are made in the tasks, the driver
    gets at most 2 * ``max_train`` sparse rows."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("grade", T.IntegerType()),
              T.StructField("idx", T.BinaryType()), T.StructField("val", T.BinaryType())]

    def make():
        hasher = Hasher(n_features)

        def step(batch: pa.RecordBatch) -> dict:
            got = [features(t or "", hasher) for t in batch.column("text").to_pylist()]
            return {"idx": [k.astype(np.int32).tobytes() for k, _ in got],
                    "val": [v.astype(np.float32).tobytes() for _, v in got]}
        return step

    sample = training_sample(docs, labels, grade, max_train)
    rows = map_rows(sample, {"doc_id": F.col("doc_id"), "grade": F.col("grade"), "text": F.col("text")}, fields,
                    make).toArrow().sort_by([("doc_id", "ascending"), ("idx", "ascending")])
    y = rows.column("grade").to_numpy()
    if len(np.unique(y)) < 2:
        return np.zeros(n_features), np.zeros(0)
    grades = np.unique(y)  # grades that do not occur have no threshold of their own
    idx = [np.frombuffer(b, np.int32) for b in rows.column("idx").to_pylist()]
    val = [np.frombuffer(b, np.float32) for b in rows.column("val").to_pylist()]
    w, theta = fit(np.concatenate([[0], np.cumsum([len(i) for i in idx])]), np.concatenate(idx).astype(np.int64),
                   np.concatenate(val).astype(np.float64), np.searchsorted(grades, y), len(grades), n_features)
    # Thresholds of missing grades repeat their neighbour: those grades get probability 0.
    cuts = [theta[min(max(np.searchsorted(grades, k, side="right") - 1, 0), len(theta) - 1)] if k >= grades[0] else -np.inf
            for k in range(int(grades[-1]))]
    return w, np.array(cuts)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], good: int, min_tail: float = MIN_TAIL,
          carry: bool = False) -> DataFrame:
    """Per row: score, expected grade, ``P(grade >= good)`` and the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        w, theta = shared.value
        hasher = Hasher(len(w))

        def step(batch: pa.RecordBatch) -> dict:
            got = [features(t or "", hasher) for t in batch.column("text").to_pylist()]
            s = np.array([w[k] @ v for k, v in got])
            if not len(theta):
                one = np.ones(len(s))
                return {"score": s, "expected_grade": one * good, "p_tail": one, "kept": one > 0}
            p = grade_probabilities(s, theta)
            tail = p[:, good:].sum(axis=1)
            return {"score": s, "expected_grade": p @ np.arange(p.shape[1]), "p_tail": tail, "kept": tail >= min_tail}
        return step

    return map_rows(docs, {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text")}, RESULT, make, carry)


def rating() -> Column:
    """Graded rating of the ``labels`` table: toxic 0, low quality 1, good 2."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def quality_classifier(docs: DataFrame, labels: DataFrame, grade: Column | None = None, good: int = 2,
                       max_train: int = MAX_TRAIN, min_tail: float = MIN_TAIL, carry: bool = False) -> DataFrame:
    """Fit on ``labels`` (doc_id, ..) and score every row of ``docs`` (doc_id, text)."""
    model = train(docs, labels, rating() if grade is None else grade, max_train)
    return score(docs, model, good, min_tail, carry)
