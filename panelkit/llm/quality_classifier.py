"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled documents of good quality, unlabelled ones are documents whose labels
are not looked at; labels of poor quality are never used. The class prior is estimated from both kinds: a model that tells positives from
unlabelled ones is fitted on half of them, and the other half is scored. Where the unlabelled documents that reach
a score are nearly all good, their share divided by the share of the positives that reach it is the prior; the score is chosen for which this
quotient and its margin of error are smallest. The risk
prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]) of a logistic model over shares
of characters, words and lines is minimised; where the second part turns negative, the step goes
back up on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.sampling import labelled_ids, unlabelled_ids
from panelkit.llm.text import documents_of, held_out, keep_where

FOLD = (5, 0)
THRESHOLD = 0.3
#: Most documents of either kind that the model is fitted on.
SAMPLE = 10_000
#: The prior where too few positives or unlabelled documents are held back (fewer than LEAST) to estimate it.
UNKNOWN, LEAST = 0.5, 20
_MARKS = [ord(c) for c in "!|#*$%&<>.,;:?@_=/\\()[]{}\"'"]


def features(text: str | None) -> list[float]:
    """Shares of the whole text's characters, words and lines; zeros for null or empty texts."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    shares = [
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        counts[128:].sum() / n,
        counts[10] / n,
        counts[32] / n,
        *(counts[_MARKS] / n),
        (len(lines) - len(set(lines))) / n_lines,
        (len(words) - len(set(words))) / n_words,
        sum(map(eq, words, words[1:])) / n_words,
    ]
    return [*np.sqrt(shares), np.log1p(len(data)), len(data) / n_words]


N_FEATURES = len(features(""))


@dataclass(frozen=True)
class Model:
    """A logistic model over standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[z, z * z / 8, np.ones(len(z))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.expand(x) @ self.weights)


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, penalty: float = 1e-3) -> Model:
    """Minimise the non-negative risk by full gradient steps (Adam). Without positives or unlabelled rows every score is the prior."""
    base = np.r_[positives, unlabelled] if len(positives) + len(unlabelled) else np.zeros((1, N_FEATURES))
    model = Model(base.mean(0), base.std(0) + 1e-6, np.zeros(2 * base.shape[1] + 1), prior)
    w = np.zeros(2 * base.shape[1] + 1)
    if not len(positives) or not len(unlabelled):
        w[-1] = np.log(prior / (1 - prior))
        return Model(model.mean, model.scale, w, prior)
    p, u = model.expand(positives), model.expand(unlabelled)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        as_negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        on_negative = u.T @ _sigmoid(u @ w) / len(u) - prior * p.T @ _sigmoid(p @ w) / len(p)
        on_positive = prior * p.T @ (_sigmoid(p @ w) - 1) / len(p)
        g = (on_positive + on_negative if as_negative >= 0 else -on_negative) + penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Model(model.mean, model.scale, w, prior)


def separator(positives: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05, penalty: float = 1e-2) -> Model:
    """A model that tells positives from unlabelled rows, both of equal weight."""
    base = np.r_[positives, unlabelled]
    model = Model(base.mean(0), base.std(0) + 1e-6, np.zeros(2 * base.shape[1] + 1), 0.5)
    p, u = model.expand(positives), model.expand(unlabelled)
    w = np.zeros(2 * base.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Model(model.mean, model.scale, w, 0.5)


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.9) -> float:
    """The share of good documents among the unlabelled, from the features of both samples; between 0.02 and 0.98.

    Every second row of either fits the separator; the others, which it has not seen, are counted. The margin of error of a share of n
    rows is that of Hoeffding's inequality.
    """
    p, u = positives[1::2], unlabelled[1::2]
    if len(p) < LEAST or len(u) < LEAST:
        return UNKNOWN
    model = separator(positives[::2], unlabelled[::2])
    p, u = np.sort(model.scores(p)), np.sort(model.scores(u))
    share_p = 1 - np.searchsorted(p, p) / len(p)
    share_u = 1 - np.searchsorted(u, p) / len(u)
    margin = sum(np.sqrt(np.log(4 / (1 - confidence)) / (2 * n)) for n in (len(p), len(u)))
    best = np.argmin((share_u + margin) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, bound: int = SAMPLE, prior: float | None = None) -> Model:
    """A model from at most `bound` trusted positives and `bound` unlabelled documents, none of them held out.

    Labels of null ids, null labels and labels without a document are left out. Of rows with equal ids one is used.
    """
    rows = documents_of(docs)
    positive = labelled_ids(labels, "quality", fold, bound, F.col("label") == 1).select("doc_id", F.lit(True).alias("positive"))
    chosen = positive.unionByName(unlabelled_ids(rows, fold, bound).withColumn("positive", F.lit(False)))

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [features(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "positive", "x"])

    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text").mapInArrow(measured, "doc_id long, positive boolean, x array<double>")
    found = sample.groupBy("doc_id", "positive").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, N_FEATURES)
    is_positive = found["positive"].to_numpy(bool)
    positives, unlabelled = x[is_positive], x[~is_positive]
    return fit(positives, unlabelled, estimate_prior(positives, unlabelled) if prior is None else prior)


def score(model: Model, text: Column) -> Column:
    """The score of a text as a column: 0 to 1, also for null and empty texts."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return scores(text)


def classify(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted. Repeated rows get equal scores; an empty table gives no rows."""
    model = train(docs, labels, fold)
    rows = documents_of(docs).select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of `threshold` or more."""
    model = train(docs, labels, fold)

    def good(texts: list) -> list[bool]:
        return (model.scores(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)) >= threshold).tolist()

    return keep_where(docs, "text", good)
