"""Near-duplicate join on word shingles: MinHash bands find candidates, full shingle sets decide.

  1. Each text becomes the set of hashes of its five-word shingles.  Texts with
     equal sets form a *class*; only its representative goes on, with the
     number of its copies.
  2. Bands of MinHash values are shuffled.  In each bucket every class is tied
     to the bucket's least one, its hub; a class's hubs are tied to the least
     of them.  The components of these ties hold every candidate pair.
  3. A component is compared as one group if that takes no more pairs than its
     buckets together; else bucket by bucket, where a pair counts in the first
     band it shares.  So a component that many small buckets have chained costs
     what its buckets cost, and a dense one is not compared once per band.
  4. Groups are dealt into blocks of bounded size; for each pair of blocks all
     pairs are compared on their full sets, which gives link counts and a
     spanning forest, never pairs.
  5. The components of the forests are the near-duplicate groups.

Bands and rows: the most rows per band with which ``recall`` is reached at the
threshold within ``max_hashes`` values.

Scale: exact copies meet by map-side aggregation.  Buckets that hold more than
a thousandth of all classes, which are a bounded number, get their hub by a
broadcast, so that their rows stay where they are.  A group of n different
texts in blocks of b is n * n / 2 comparisons, because every one of these links
is asked for, in n * n / (2 * b * b) tasks of bounded memory; each set is sent
n / b times and each task returns a row per class, counts that are summed
map-side.  Blocks grow with the group, from 256 to 1,024 classes.

Cases: null texts and texts without words have no shingles, no links and each
its own class.  A text of one to four words has one shingle, all its words.
Words are runs without ASCII white space, with A-Z lowered.  Repeated rows are
copies.  A null doc_id counts as a document; a class's id is the least id that
isn't null.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.components import components
from lexiloom.storage import materialize

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
#: Classes in a block: a group's sixteenth between these two; and at most so many shingles, unless one text has more.
BLOCK_CLASSES = (256, 1024)
BLOCK_SHINGLES = 1_000_000
#: A bucket with a larger share of the classes, and so many, gets its hub by a broadcast.
HOT_SHARE, HOT_CLASSES = 1000, 1000
#: Up to so many classes may be broadcast as keys; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at ``threshold`` with probability ``recall``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = max(1, len(words) - size + 1)
    mixed = np.full(count, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ one[k : k + count]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def band_hashes(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash per band of the set's MinHash values."""
    random = np.random.Generator(np.random.PCG64(20240229))
    shift = random.integers(0, 2**64, bands * rows, np.uint64)
    factor = random.integers(0, 2**64, bands * rows, np.uint64) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = (hashes[None, at : at + 4096] ^ shift[:, None]) * factor[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(bands, rows).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, threshold: float, recall: float, max_hashes: int) -> DataFrame:
    """doc_id, text_key, digest (null without shingles), n_shingles, bands; a row per row of ``docs``."""
    bands, rows = choose_bands(threshold, recall, max_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, hashes = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                hashes.append(band_hashes(found, bands, rows) if len(found) else np.zeros(0, np.int64))
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in hashes])))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int64()))],
                ["doc_id", "text_key", "digest", "n_shingles", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key long, digest binary, n_shingles int, bands array<long>"
    )


def bucket_rows(classes: DataFrame) -> DataFrame:
    """band, hash, digest, hub, n: a row for each class in a bucket of several classes, with the bucket's least class."""
    rows = classes.select("digest", F.posexplode("bands").alias("band", "hash"))
    hubs = materialize(
        rows.groupBy("band", "hash").agg(F.min("digest").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "hubs"
    )
    hot = F.col("n") > max(HOT_CLASSES, classes.count() // HOT_SHARE)  # at most HOT_SHARE of them in each band
    spread = rows.join(F.broadcast(hubs.filter(hot)), ["band", "hash"], "left")
    cold = spread.filter("hub is null").drop("hub", "n").join(hubs.filter(~hot), ["band", "hash"])
    return materialize(spread.filter("hub is not null").unionByName(cold), "buckets")


def _ties(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b): each class with its least hub, and its other hubs with that."""
    hubs = buckets.groupBy("digest").agg(F.collect_set("hub").alias("hubs"), F.min("hub").alias("b"))
    return hubs.select("b", F.explode(F.array_union(F.array("digest"), "hubs")).alias("a")).filter("a != b").select("a", "b").distinct()


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (with doc_id, text_key of a representative) and its text."""
    keys = members.select(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text"))
    same = F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("text_key") == F.col("k_text"))
    if members.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(keys, same, "left_semi")
    texts = found.groupBy(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text")).agg(F.first("text").alias("text"))
    return members.join(texts, same)


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over a few thousand shingles at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float32)
    width = max(256, 4_000_000 // n)
    for start in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, [start, start + width])
        ones = np.zeros((n, width), np.float32)
        ones[row[low:high], column[low:high] - start] = 1
        total += ones @ ones.T
    return total


def _compare(threshold: float, cross: bool, digests: list[bytes], copies: np.ndarray, sets: list[np.ndarray], half: np.ndarray, bands: np.ndarray):
    """Per class: linked classes, their documents, and the least class that its links reach within the group.

    A pair that shares one of the first ``bands.shape[1]`` bands is left to that band's bucket.
    """
    n = len(digests)
    inter = _intersections(sets)
    sizes = np.array([len(x) for x in sets], np.float32)
    linked = inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-4
    np.fill_diagonal(linked, False)
    if cross:
        linked &= half[:, None] != half[None, :]
    root = np.arange(n)  # digests are sorted, so the least place is the least digest
    reached = linked
    for band in bands.T:
        linked = linked & (band[:, None] != band[None, :])
    while True:
        near = np.where(reached, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return linked.sum(axis=1), linked.astype(np.int64) @ copies, root
        root = new


def _groups(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """digest, group (component, and band and hash where it is compared by buckets), band (-1 for whole components), blocks."""
    by_component = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles").cast("long")).alias("shingles"))
    own = members.select("digest", "component", "n_shingles")
    sized = (
        buckets.join(own, "digest").groupBy("component", "band", "hash")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles").cast("long")).alias("shingles"))
    )
    pairs = sized.groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    ways = by_component.join(pairs, "component").withColumn("whole", (F.col("n") <= BLOCK_CLASSES[0]) | (F.col("n") * F.col("n") <= F.col("pairs")))
    per_block = F.least(F.greatest(F.col("n") / 16, F.lit(float(BLOCK_CLASSES[0]))), F.lit(float(BLOCK_CLASSES[1])))
    blocks = F.greatest(F.ceil(F.col("n") / per_block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    whole = own.join(ways.filter("whole").select("component", blocks), "component").select(
        "digest", "component", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash"), "blocks"
    )
    parts = ways.filter("not whole").select("component").join(sized.select("component", "band", "hash", blocks), "component")
    split = (
        buckets.join(own, "digest").select("digest", "component", "band", "hash").join(parts, ["component", "band", "hash"])
        .select("digest", "component", "band", "hash", "blocks")
    )
    return whole.unionByName(split)


def links(docs: DataFrame, classes: DataFrame, buckets: DataFrame, threshold: float) -> DataFrame:
    """Per class with candidates, block pair and group: digest, root (another or the same class), class_links, doc_links."""
    sized = classes.select("digest", "doc_id", "text_key", "copies", "n_shingles", "bands").join(
        components(_ties(buckets)).select(F.col("node").alias("digest"), F.col("root").alias("component")), "digest"
    )
    members = materialize(sized, "candidates")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py()).tobytes() for x in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("set", pa.array(found, pa.binary()))

    with_sets = (
        _texts_of(docs, members).select("digest", "copies", "bands", "text")
        .mapInArrow(to_sets, "digest binary, copies long, bands array<long>, set binary")
    )
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = (
        with_sets.join(_groups(members, buckets), "digest").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component", "band", "hash", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "own", "digest", "copies", F.slice("bands", F.lit(1), F.greatest("band", F.lit(0))).alias("before"), "set",
        )
    )

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("digest")
        digests = rows.column("digest").to_pylist()
        own = rows.column("own").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")]
        before = np.array(rows.column("before").to_pylist(), np.int64).reshape(len(digests), -1)
        cross = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        classes_linked, docs_linked, root = _compare(threshold, cross, digests, rows.column("copies").to_numpy(), sets, own, before)
        return pa.table(
            {
                "digest": pa.array(digests, pa.binary()),
                "root": pa.array([digests[r] for r in root], pa.binary()),
                "class_links": pa.array(classes_linked, pa.int64()),
                "doc_links": pa.array(docs_linked, pa.int64()),
            }
        )

    return dealt.groupBy("component", "band", "hash", "low", "high").applyInArrow(
        compare, "digest binary, root binary, class_links long, doc_links long"
    )


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    doc_id; text_key; class_id: least doc_id of the documents joined by links;
    copy_id: least doc_id with an equal shingle set; n_copies: documents with
    it; n_links: other documents at ``threshold`` or more, copies among them;
    n_class_links: different shingle sets at ``threshold`` or more; first: the
    least of its group (its repeated rows too).
    """
    signed = materialize(signatures(docs, threshold, recall, max_hashes), "signatures")
    best = F.min(_rank("doc_id", "text_key"))
    classes = materialize(
        signed.filter(F.col("digest").isNotNull()).groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .select("digest", "best.doc_id", "best.text_key", "copies", "n_shingles", "bands"),
        "classes",
    )
    found = materialize(links(docs, classes, bucket_rows(classes), threshold), "links")
    counts = found.groupBy("digest").agg(F.sum("class_links").alias("class_links"), F.sum("doc_links").alias("doc_links"))
    roots = components(found.filter(F.col("digest") != F.col("root")).select(F.col("digest").alias("a"), F.col("root").alias("b")))
    grouped = (
        classes.select("digest", F.col("doc_id").alias("copy_id"), "copies", _rank("doc_id", "text_key").alias("rank"))
        .join(counts, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest"))
    )
    ids = (
        roots.join(classes.select(F.col("digest").alias("node"), _rank("doc_id", "text_key").alias("rank")), "node")
        .groupBy("root").agg(F.min("rank").alias("group_rank"))
    )
    named = grouped.join(ids, "root", "left").select(
        F.col("digest").alias("of"), "copy_id", "copies", F.coalesce("group_rank", "rank").alias("best"),
        F.coalesce("class_links", F.lit(0)).alias("class_links"), F.coalesce("doc_links", F.lit(0)).alias("doc_links"),
    )
    alone = F.col("digest").isNull()
    return signed.select("doc_id", "text_key", "digest").join(named, F.col("digest") == F.col("of"), "left").select(
        "doc_id", "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("doc_links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_class_links"),
        (alone | (_rank("doc_id", "text_key") == F.col("best"))).alias("first"),
    )


def _rank(doc_id: str, text_key: str):
    """Orders documents by id, those without one last."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(text_key).alias("text_key"))


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least doc_id.

    Rows without words are groups of their own and all stay.  Columns of any name pass through.
    """
    chosen = materialize(
        near_duplicates(docs.select("doc_id", "text"), **options).filter("first")
        .groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"), F.max("n_copies").alias("n_copies")),
        "chosen",
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("row_text"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row_text") == F.col("text_key"))
    once = rows.join(chosen.filter("times = 1 or n_copies = 1"), same, "left_semi").select("row.*")
    repeated = chosen.filter("times > 1 and n_copies > 1")
    if repeated.isEmpty():
        return once
    again = rows.join(repeated, same, "left_semi").groupBy("row.doc_id", "row_text").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(again)
