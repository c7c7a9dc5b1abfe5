"""Quality scores by Bradley-Terry pairwise ranking.

Whole texts become a few counts and ratios. From labelled documents, pairs of a
document of label 1 and one of label 0 are preference pairs; a logistic loss on the
differences of their features gives the weights, and a document's score is their
product with its features. The cut is the quantile of the training scores that leaves
below it the share that label 0 has there; scores are moved so that it lies at CUT.

The fit reads at most MAX_LABELLED labelled documents (those of the least id hashes)
and MAX_PAIRS pairs; the features and scores cover every document whole. Documents
whose crc32 of the id leaves no rest mod 5 are never learned from.

Defined results: null and empty texts have the features of no words and a score as
any other; without labels of both kinds every score is 0.5; rows that repeat are
scored each; ids with several labels count by their mean; an empty table gives no
rows; texts of any length are read whole;
equal scores share a side of the cut; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read_table

MAX_LABELLED = 20_000
MAX_PAIRS = 60_000
CUT = 0.3
FOLDS = 5

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>{}[]\\^~=+@_/"
STOPS = b".,;:"
SHOUTS = b"!?"
FEATURES = 16


def features(text: str | None) -> list[float]:
    """Counts and ratios of the whole *text*."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * FEATURES

    def share(kinds: bytes) -> float:
        return (len(raw) - len(raw.translate(None, kinds))) / size

    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    top = counts.most_common(1)[0][1]
    return [
        1.0,
        math.log(n),
        float(lengths.mean()),
        math.log1p(float(lengths.std())),
        float((lengths <= 3).mean()),
        share(UPPER),
        share(DIGITS),
        share(SYMBOLS),
        share(STOPS),
        share(SHOUTS),
        math.log(len(counts)) / math.log(n + 1),
        top / n,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log(n / max(len(lines), 1)),
        math.log(float(lengths.max())),
        sum(1 for a, b in zip(words, words[1:]) if a == b) / n,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_of(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


class Ranker:
    """Weights over standardised features and over tenths of each feature's range."""

    BINS = 8

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.fitted = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.edges = [np.unique(np.quantile(c, np.arange(1, self.BINS) / self.BINS)) for c in x.T]
        wide = self.expand(x)
        rng = np.random.default_rng(seed)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        diff = wide[rng.choice(good, MAX_PAIRS)] - wide[rng.choice(bad, MAX_PAIRS)]
        self.weights = pairwise_fit(diff)
        raw = wide @ self.weights
        self.cut = float(np.quantile(raw, len(bad) / len(y)))

    def expand(self, x: np.ndarray) -> np.ndarray:
        blocks = [np.clip((x - self.mean) / self.scale, -5, 5)]
        for c, edges in zip(x.T, self.edges):
            blocks.append(np.eye(len(edges) + 1)[np.searchsorted(edges, c, side="right")])
        return np.concatenate(blocks, 1).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        raw = (self.expand(x) @ self.weights).astype(float) - self.cut + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def pairwise_fit(diff: np.ndarray, ridge: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Weights w that minimise mean log(1 + exp(-w.d)) + ridge |w|^2 / 2, by Newton steps."""
    n, k = diff.shape
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None].astype(np.float32)).sum(0, dtype=np.float64) / n + ridge * w
        curve = (diff * (p * (1 - p))[:, None].astype(np.float32)).T @ diff / n + ridge * np.eye(k)
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on at most MAX_LABELLED labelled documents outside the held-out fifth."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = (
        usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # MAX_LABELLED ids at most
    rows = texts.select("doc_id", "label", features_of("text").alias("x")).groupBy("doc_id").agg(F.first("label").alias("label"), F.max("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), FEATURES)
    return Ranker(x, np.array([r["label"] for r in rows], int))


def with_score(docs: DataFrame, ranker: Ranker, name: str = "score") -> DataFrame:
    """*docs* with a column *name* more; where they have one of that name, ours gets a longer one."""
    (name,) = fresh(docs.columns, name)

    @F.pandas_udf(T.DoubleType())
    def score_of(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), FEATURES)
        return pd.Series(ranker.score(x))

    return docs.withColumn(name, score_of("text"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """*docs*, all columns, without the documents scored below CUT."""
    (name,) = fresh(docs.columns, "score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) >= CUT).drop(name)


def op7_bradley_terry_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
