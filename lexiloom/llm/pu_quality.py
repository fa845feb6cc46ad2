"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled
web text.  The class prior is estimated by the best-bin rule: a first model
tells positives from unlabelled text, and in the bin of highest scores in which
the unlabelled share is smallest against the positives', that ratio bounds the
prior.  The rule is applied to held-out scores of ``SPLITS`` random halvings;
the median less its standard error is taken, since a prior too large makes the
final model call everything good, and one too small does little harm.  The
final model minimises the non-negative unbiased risk with it: the
risk of the positives, plus the larger of zero and the unlabelled text's
negative risk less the positives' part of it.

Features are measured on the whole text (letter cases, symbols, repetition,
word and line lengths) and cut into quantile bins, so that the model is linear
in indicators.

Scale: the model is fitted on at most ``SAMPLE`` positives and as many
unlabelled rows, those with the least hash of their id; scoring scans documents
once, without a shuffle.  The sample's ids are broadcast: their number is
bounded.

Cases: null and empty texts have features too and get a score.  Without
positives or without unlabelled rows every score is 0.5.  Rows with a null id
are scored and never learned from.  Labels of unknown ids and repeated labels
do no harm.  Other columns pass through; those named score and predicted are
replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.learning import fit_logistic, fold, sample, sigmoid

#: At most so many positives, and so many unlabelled rows, are learned from.
SAMPLE = 8_000
BINS = 12
FOLDS = 5
CUT = 0.3
#: Random halvings for the prior.
SPLITS = 5
RIDGE = 1e-3

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "marks", "shout_words", "marked_words", "distinct_words",
    "top_word", "repeated_lines", "line_words", "packed", "repeated_triples", "long_words", "sentence_ends",
)

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def features(text: str | None) -> np.ndarray:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = Counter(zip(words, words[1:], words[2:]))
    raw = text.encode()
    ascii_count = lambda table: len(raw) - len(raw.translate(None, table))
    return np.array([
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(_UPPER.findall(text)) / chars,
        ascii_count(b"0123456789") / chars,
        ascii_count(b"#*$%&|<>=+~^_@\\{}[]") / chars,
        ascii_count(b"!?;:,.\"'()-") / chars,
        sum(map(str.isupper, words)) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        len(counts) / n**0.85,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        sum(c for c in triples.values() if c > 1) / n,
        sum(len(w) > 14 for w in words) / n,
        ascii_count(b".") / n,
    ], np.float32)


@dataclass
class Model:
    edges: np.ndarray  # (features, bins - 1)
    weights: np.ndarray
    prior: float

    def score(self, measured: np.ndarray) -> np.ndarray:
        return sigmoid(_indicators(measured, self.edges) @ self.weights[:-1] + self.weights[-1])


def _edges(measured: np.ndarray) -> np.ndarray:
    return np.quantile(measured, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)


def _indicators(measured: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One indicator per feature and edge: whether the value lies above it."""
    return (measured[:, :, None] > edges[None, :, :]).reshape(len(measured), -1).astype(np.float32)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> tuple[float, float]:
    """Share of positives among the unlabelled, from held-out scores of a positive-unlabelled model; and its standard error."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = lambda scores: 1 - np.searchsorted(np.sort(scores), cuts) / len(scores)
    p, u = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin(np.where(p > 0.05, (u + slack) / np.maximum(p, 1e-9), np.inf))
    p, u = max(float(p[best]), 1e-9), max(float(u[best]), 1e-9)
    return u / p, u / p * float(np.sqrt((1 - u) / (u * len(unlabelled)) + (1 - p) / (p * len(positive))))


def prior_of(x: np.ndarray, positive: np.ndarray, splits: int = SPLITS) -> float:
    """The median estimate over random halvings, less its standard error."""
    found = []
    for k in range(splits):
        half = np.random.default_rng(k).permutation(len(x)) % 2 == 0
        scores = np.zeros(len(x))
        for part in (half, ~half):
            if positive[part].any() and not positive[part].all():
                w = fit_logistic(x[part], positive[part].astype(np.float32), ridge=2.0, steps=120)
                scores[~part] = sigmoid(x[~part] @ w[:-1] + w[-1])
        found.append(estimate_prior(scores[positive], scores[~positive]))
    share, error = sorted(found)[len(found) // 2]
    return float(np.clip(share - error, 0.02, 0.98))


def fit_non_negative(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the last for a constant) that minimise the non-negative risk with the logistic loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    p, u = x[positive], x[~positive]
    w = np.zeros(x.shape[1], np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        fp, fu = sigmoid(p @ w), sigmoid(u @ w)
        pull = p.T @ (fp - 1) / len(p)  # gradient of the positives' risk as positives
        away = u.T @ fu / len(u) - prior * (p.T @ fp) / len(p)  # and of the estimated negatives' risk
        risk = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        grad = prior * pull + away if risk >= 0 else -away
        grad = grad + ridge * w
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w = w - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, positive) and the features, of a bounded sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "positive": batch["positive"], "x": [features(t).tolist() for t in batch["text"]]})

    return docs.select("doc_id", "positive", "text").mapInPandas(run, "doc_id string, positive boolean, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE, folds: int = FOLDS) -> Model | None:
    """Learned from rows whose fold isn't 0: positives by label, and rows without a label."""
    learn = fold("doc_id", folds) != 0
    ids = docs.filter(learn).select("doc_id").distinct()
    named = labels.filter(learn).groupBy("doc_id").agg(F.max("quality").alias("best"), F.min("quality").alias("worst"))
    good = ids.join(named.filter("best = 1 and worst = 1").select("doc_id"), "doc_id")
    other = ids.join(labels.select("doc_id"), "doc_id", "left_anti")
    chosen = sample(good, n, "doc_id").withColumn("positive", F.lit(True)).unionByName(
        sample(other, n, "doc_id").withColumn("positive", F.lit(False))
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
    rows = sorted(measure(texts).collect(), key=lambda r: (r.positive, r.doc_id, r.x))
    positive = np.array([r.positive for r in rows], bool)
    if not positive.any() or positive.all():
        return None
    measured = np.array([r.x for r in rows], np.float32)
    edges = _edges(measured)
    x = _indicators(measured, edges)
    prior = prior_of(x, positive)
    return Model(edges, fit_non_negative(x, positive, prior), prior)


def score(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``cut`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [*[f for f in docs.schema.fields if f.name not in ("score", "predicted")],
         T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value
            scores = np.full(batch.num_rows, 0.5)
            if found is not None and batch.num_rows:
                scores = found.score(np.stack([features(t.as_py()) for t in batch.column("text")])).astype(np.float64)
            rest = batch.drop_columns([x for x in ("score", "predicted") if x in batch.schema.names])
            yield rest.append_column("score", pa.array(scores)).append_column("predicted", pa.array((scores >= cut).astype(np.int32)))

    return docs.mapInArrow(run, schema)
