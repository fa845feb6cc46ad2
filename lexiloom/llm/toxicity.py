"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other, and each model sees, beside
the words, the probabilities of the categories before it.  In training these
come from models that did not see the row (out-of-fold), so that a later model
learns how far to trust the earlier ones.  Folds go by the hash of the text, so
that copies are in one fold, and what depends on labels is chosen anew within
each: a model sees the words whose share of its category, in the rows it is
trained on, stands out of chance by ``MIN_SCORE`` standard deviations.

The categories come from the given labels alone: ``junk`` (labelled of low
quality), ``abuse`` (labelled toxic in a text that isn't junk) and ``toxic``
(labelled toxic), in this order; the last probability is the verdict.

Scale: fitted on at most ``SAMPLE`` labelled rows, those with the least hash of
their id, half of them toxic if there are so many; words are chosen from the
``VOCABULARY`` that are in most texts of the sample.  Scoring scans documents once, without a shuffle.

Cases: null and empty texts have no words and get the constant's probability.
Without rows of both toxicity labels every probability is 0; a category without
examples has probabilities near 0.  Conflicting labels count as toxic, and as
junk.  A null quality isn't junk.  Rows with a null id are scored and never
learned from, as are those of fold 0, which are held out.  Other columns pass
through; those of the output's names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.learning import apply_logistic, fit_logistic, fold, sample, sigmoid
from lexiloom.storage import materialize

SAMPLE = 6_000
VOCABULARY = 20_000
#: A word of the vocabulary is in so many texts of the sample.
MIN_TEXTS = 3
CATEGORIES = ("junk", "abuse", "toxic")
#: Folds by id, the first of them held out; and folds by text for the chain.
HOLD_OUT_FOLDS, FOLDS = 5, 5
RIDGE = 1.0
MIN_SCORE = 3.0
CUT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    index: dict[str, int]
    #: Of each category: weights of the words, then of the earlier probabilities and the constant.
    words: np.ndarray  # (words, categories)
    rest: list[np.ndarray]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the vocabulary's words in a text, in order, and their uses."""
        found = Counter(k for k in map(self.index.get, words_of(text)) if k is not None)
        at = np.array(sorted(found), np.int32)
        return at, np.array([found[k] for k in at], np.int32)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each category, in the chain's order."""
        sums = np.zeros((len(texts), len(self.rest)), np.float32)
        for i, text in enumerate(texts):
            at, uses = self.counts(text)
            sums[i] = np.log1p(uses, dtype=np.float32) @ self.words[at]
        out = np.zeros((len(texts), 0), np.float32)
        for j, w in enumerate(self.rest):
            out = np.hstack([out, sigmoid(sums[:, j] + out @ w[:-1] + w[-1])[:, None]])
        return out


@dataclass
class Sample:
    """Words of the rows to learn from, one entry per row and word."""

    row: np.ndarray
    word: np.ndarray
    uses: np.ndarray
    n: int  # rows
    size: int  # words

    def telling(self, y: np.ndarray, train: np.ndarray) -> np.ndarray:
        """The words whose rows in ``train`` have ``y`` more or less often than chance would."""
        inside = train[self.row]
        total = np.bincount(self.word[inside], minlength=self.size)
        with_y = np.bincount(self.word[inside & y[self.row]], minlength=self.size)
        rate = y[train].mean()
        spread = np.sqrt(np.maximum(total * rate * (1 - rate) * (1 - total / train.sum()), 1e-9))
        return np.flatnonzero((np.abs(with_y - total * rate) - 0.5 >= MIN_SCORE * spread) & (total >= MIN_TEXTS))

    def columns(self, words: np.ndarray, more: int) -> np.ndarray:
        """Logarithms of the uses of ``words`` by row, with places for ``more`` columns."""
        place = np.full(self.size, -1)
        place[words] = np.arange(len(words))
        kept = place[self.word] >= 0
        x = np.zeros((self.n, len(words) + more), np.float32)
        x[self.row[kept], place[self.word[kept]]] = np.log1p(self.uses[kept])
        return x


def fit_chain(rows: Sample, y: np.ndarray, part: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Weights of words and of the rest for each column of ``y``, and the earlier columns' out-of-fold probabilities.

    ``part`` is each row's fold.
    """
    earlier = np.zeros((rows.n, 0), np.float32)
    words, rest = np.zeros((rows.size, y.shape[1]), np.float32), []

    def one(j: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = rows.telling(y[:, j], train) if y[train, j].any() else np.zeros(0, np.int64)
        x = rows.columns(chosen, j)
        x[:, len(chosen) :] = earlier
        return chosen, x, fit_logistic(x[train], y[train, j].astype(np.float32), ridge=ridge, steps=150)

    for j in range(y.shape[1]):
        chosen, _, w = one(j, np.ones(rows.n, bool))
        words[chosen, j] = w[: len(chosen)]
        rest.append(w[len(chosen) :])
        if j + 1 < y.shape[1]:
            held = np.zeros((rows.n, 1), np.float32)
            for k in np.unique(part):
                _, x, w = one(j, part != k) if (part != k).any() else one(j, part == k)
                held[part == k, 0] = apply_logistic(w, x[part == k])
            earlier = np.hstack([earlier, held])
    return words, rest, earlier


def _vocabulary(texts: DataFrame) -> dict[str, int]:
    """The words that are in most texts, counted on the executors."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(set(words_of(text)))
        if found:
            yield pd.DataFrame({"word": list(found), "texts": list(found.values())})

    counted = texts.select("text").mapInPandas(seen, "word string, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))
    best = counted.filter(F.col("texts") >= MIN_TEXTS).orderBy(F.desc("texts"), "word").limit(VOCABULARY).collect()
    return {r.word: i for i, r in enumerate(best)}


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE, hold_out_folds: int = HOLD_OUT_FOLDS) -> Model | None:
    junk = F.max(F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0))) if "quality" in labels.columns else F.lit(0)
    known = (
        labels.filter((fold("doc_id", hold_out_folds) != 0) & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), junk.alias("junk"))
        .join(docs.select("doc_id").distinct(), "doc_id")
    )
    chosen = sample(known.filter("toxic = 1"), n // 2, "doc_id").unionByName(sample(known.filter("toxic = 0"), n // 2, "doc_id"))
    texts = materialize(
        docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
        .select("doc_id", "text", "toxic", "junk", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("part")),
        "toxicity-sample",
    )
    index = _vocabulary(texts)
    shared = docs.sparkSession.sparkContext.broadcast(Model(index, np.zeros((0, 0)), []))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [shared.value.counts(t) for t in batch["text"]]
            yield pd.DataFrame({
                "id": batch["doc_id"].astype(str), "toxic": batch["toxic"], "junk": batch["junk"], "part": batch["part"],
                "index": [c[0] for c in counts], "uses": [c[1] for c in counts],
            })

    found = texts.mapInPandas(count, "id string, toxic int, junk int, part int, index array<int>, uses array<int>").collect()
    found.sort(key=lambda r: (r.id, r["index"], r.uses))
    toxic, junk = np.array([r.toxic == 1 for r in found], bool), np.array([r.junk == 1 for r in found], bool)
    if not toxic.any() or toxic.all():
        return None
    flat = lambda name: np.fromiter((k for r in found for k in r[name]), np.int32)
    rows = Sample(np.repeat(np.arange(len(found)), [len(r.uses) for r in found]), flat("index"), flat("uses"), len(found), len(index))
    words, rest, _ = fit_chain(rows, np.stack([junk, toxic & ~junk, toxic], axis=1), np.array([r.part for r in found]))
    used = np.flatnonzero(words.any(axis=1))
    names = {i: w for w, i in index.items()}
    return Model({names[int(k)]: at for at, k in enumerate(used)}, words[used], rest)


def score(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """``docs`` without text, with p_junk, p_abuse, p_toxic and toxic (1 from ``cut`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [*[T.StructField(f"p_{c}", T.DoubleType()) for c in CATEGORIES], T.StructField("toxic", T.IntegerType())]
    names = {f.name for f in added} | {"text"}
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            chance = np.zeros((len(texts), len(CATEGORIES)))
            for i in range(0, len(texts) if shared.value is not None else 0, 256):
                chance[i : i + 256] = shared.value.predict(texts[i : i + 256])
            batch = batch.drop_columns(["text"])
            for j, c in enumerate(CATEGORIES):
                batch = batch.append_column(f"p_{c}", pa.array(chance[:, j]))
            yield batch.append_column("toxic", pa.array((chance[:, -1] >= cut).astype(np.int32)))

    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, T.StructType([*kept, *added]))
