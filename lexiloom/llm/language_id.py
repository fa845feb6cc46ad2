"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte 2- and 3-grams of its
lower-cased letters.  Each language has several centroids, found by spherical
k-means among its training texts.  The prediction is the language of the
centroid with the largest cosine.  Each centroid rejects texts that are farther
from it than nearly all of its own training texts; ``rejected`` tells so, with
the nearest language still named.

Scale: document frequencies cover all training rows and are summed per n-gram;
centroids are fitted on about ``SAMPLE`` texts, those with the least hash of
their id and text within each language, and at least 50 or all of each.  Every
language is learned.  Prediction scans documents once, without a shuffle, and
broadcasts only the centroids: ``CENTROIDS`` vectors of fixed size for each
language.

Cases: null texts and texts without a letter are ``und`` with score 0.  Rows
with a null id or language are predicted and never learned from; repeated rows
are clustered once.  Without training rows everything is ``und``.  Other columns
pass through; those named lang_pred, score and rejected are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.learning import fold

BUCKETS = 4096
#: At most so many texts are clustered; languages share them evenly.
SAMPLE = 4_000
CENTROIDS = 3
FOLDS = 3
HELD_OUT = 1
#: Share of a centroid's own texts that may lie beyond its radius.
TAIL = 0.002

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if 97 <= c <= 122 else 32 for c in range(128)]


def grams(text: str | None) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams, white space and marks as one kind of blank."""
    raw = _FOLD[np.frombuffer((text or "").lower().encode(), np.uint8)].astype(np.uint32)
    padded = np.concatenate(([32], raw, [32])).astype(np.uint32)
    padded = padded[np.concatenate(([True], (padded[1:] != 32) | (padded[:-1] != 32)))]
    two = padded[:-1] * np.uint32(0x01000193) ^ padded[1:]
    three = two[:-1] * np.uint32(0x01000193) ^ padded[2:]
    codes = np.concatenate([two, three]) * np.uint32(2654435761) >> np.uint32(20)
    return np.bincount(codes, minlength=BUCKETS)[:BUCKETS]


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length."""
    out = np.log1p(counts).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    radius: np.ndarray  # least cosine each accepts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, scores, rejected = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            cosines = vectors(np.stack([grams(t) for t in part]), self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            top = cosines[np.arange(len(part)), best]
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in part], bool)
            names += [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
            scores[i : i + 256] = np.where(lettered, np.clip(top, 0, 1), 0)
            rejected[i : i + 256] = ~lettered | (top < self.radius[best])
        return names, scores, rejected


def cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts; unit centroids."""
    chosen = [points.mean(axis=0)]
    chosen[0] = chosen[0] / max(np.linalg.norm(chosen[0]), 1e-12)
    while len(chosen) < min(k, len(points)):
        chosen.append(points[(points @ np.stack(chosen).T).max(axis=1).argmin()])
    centers = np.stack(chosen)
    for _ in range(rounds):
        own = (points @ centers.T).argmax(axis=1)
        sums = np.stack([points[own == j].sum(axis=0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents with each n-gram, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += grams(text) > 0
        yield pd.DataFrame({"gram": np.arange(BUCKETS), "docs": total})

    rows = docs.select("text").mapInPandas(run, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).collect()
    found = np.zeros(BUCKETS, np.int64)
    for r in rows:
        found[r.gram] = r.docs
    return found


def fit(docs: DataFrame, n: int = SAMPLE, k: int = CENTROIDS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model | None:
    """Learned from text and non-null lang of the rows whose fold isn't ``held_out``."""
    rows = docs.filter((fold("doc_id", folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()
    sizes = {r.lang: r.n for r in seen}
    if not sizes:
        return None
    each = max(50, n // len(sizes))
    reach = docs.sparkSession.createDataFrame([(r.lang, max(each / r.n, r.least)) for r in seen], "lang string, reach double")
    taken = (
        rows.select("doc_id", "lang", "text", place.alias("place")).join(F.broadcast(reach), "lang").filter("place <= reach")
        .groupBy("lang", "doc_id", "place").agg(F.first("text").alias("text"))
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [grams(t) for t in batch["text"]]
            kept = [np.flatnonzero(x) for x in found]
            yield pd.DataFrame(
                {"id": batch["doc_id"].astype(str), "lang": batch["lang"], "grams": [i.astype(np.int32) for i in kept], "counts": [x[i].astype(np.int32) for x, i in zip(found, kept)]}
            )

    chosen = taken.mapInPandas(count, "id string, lang string, grams array<int>, counts array<int>")
    sampled: dict[str, list] = {lang: [] for lang in sizes}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.id, r.grams, r.counts)):
        sampled[r.lang].append(r)
    frequency = document_frequencies(rows)
    idf = (np.log((1 + sum(sizes.values())) / (1 + frequency)) + 0.1).astype(np.float32)
    centers, names, radius = [], [], []
    for lang in sorted(sizes):
        own = sampled[lang]
        counts = np.zeros((len(own), BUCKETS), np.float32)
        for i, r in enumerate(own):
            counts[i, r.grams] = r.counts
        points = vectors(counts, idf)
        found = cluster(points, k)
        cosines = points @ found.T
        nearest = cosines.argmax(axis=1)
        for j in range(len(found)):
            mine = cosines[nearest == j, j]
            centers.append(found[j])
            names.append(lang)
            radius.append(float(np.quantile(mine, TAIL)) * 0.8 if len(mine) else 0.0)
    return Model(idf, np.stack(centers).astype(np.float32), names, np.array(radius)) if centers else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score (the cosine) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, scores, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
            if shared.value is not None and n:
                names, scores, rejected = shared.value.predict(batch.column("text").to_pylist())
            rest = batch.drop_columns([f.name for f in added if f.name in batch.schema.names])
            for field, values in zip(added, (pa.array(names, pa.string()), pa.array(scores), pa.array(rejected))):
                rest = rest.append_column(field.name, values)
            yield rest

    return docs.mapInArrow(run, schema)
