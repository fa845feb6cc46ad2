"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding
  1. Every text is split into pre-tokens.  About a million of them form a
     *piece*; within it equal pre-tokens meet before the shuffle, so a word is
     sent once.  Words are dealt by hash into buckets; a row carries a piece's
     words of one bucket, packed.
  2. The rows are shuffled by bucket, so all of a word's rows meet, and each
     distinct word is encoded once.
  3. The ids are shuffled back by piece, where they join the places of their
     words.  Places are found by splitting once more and go to their piece
     directly: they outweigh words and ids, and splitting is cheap.

Decoding joins each id with the table of token bytes.

Scale: each shuffle moves a word once per piece, and packed rows keep that
below the size of the text.  The most common word has one entry per piece, so
no bucket is hot; a piece has a bounded number of tokens, so no group is large;
buckets grow in number with the partitions.  Only the vocabulary, whose size is
fixed, is broadcast.

Pieces are cut by the rows' own contents, whatever batches Spark hands them
over in.  The splitting must give the same pieces when it is run again, so pass
a stored table or a plan whose row order is stable; a fingerprint of each
piece's words is compared, and a difference is an error.

Cases: null and empty texts have no ids and decode to nothing.  Rows may
repeat, any column but ``text`` may be null or have any name; all are carried
along unread.  A column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A piece ends with the text that brings it to so many pre-tokens or rows.
PIECE_TOKENS = 1_000_000
PIECE_ROWS = 20_000


# --- splitting -----------------------------------------------------------------------------


@cache
def _class(prop: str, end: int) -> str:
    """The characters below ``end`` of a Unicode property, as the inside of a class for ``re``."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, end)]))
    escape = lambda c: f"\\U{ord(c):08x}"
    return "".join(f"{escape(m[0][0])}-{escape(m[0][-1])}" for m in regex.finditer(rf"\p{{{prop}}}+", everything))


@cache
def _compiled(pattern: str, end: int) -> re.Pattern[str]:
    r"""``pattern`` for Python's quick ``re``: \p{L}, \p{N}, \s and \S are written out, for texts of characters below ``end``."""
    blank = _class("White_Space", end)
    inside = {r"\p{L}": _class("L", end), r"\p{N}": _class("N", end), r"\s": blank}

    def one(m: re.Match[str]) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\p\{[LN]\}|\\s", lambda x: inside[x[0]], m[0])
        return f"[^{blank}]" if m[0] == r"\S" else f"[{inside[m[0]]}]"

    return re.compile(re.sub(r"\[[^]]*\]|\\p\{[LN]\}|\\s|\\S", one, pattern))


def splitter(pattern: str):
    """A function from a text to its pre-tokens.

    Ranges beyond 16 bits make ``re`` slow, so texts without such characters get a pattern without them.
    """
    short, full = _compiled(pattern, 0x10000).findall, _compiled(pattern, 0x110000).findall
    return lambda text: (short if len(text.encode("utf-16-le")) == 2 * len(text) else full)(text)


# --- packed places -------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned numbers, seven bits each with a flag for more; and where each begins, with the end."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28, 35):
        sizes += values >= (1 << bits)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[starts[:-1][has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, starts


def unpack(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    parts = (data & 127).astype(np.int64) << (7 * place)
    return np.add.reduceat(parts, starts) if len(ends) else np.zeros(0, np.int64)


def _squeeze(data: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else data.tobytes())


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbers(data: bytes) -> np.ndarray:
    return unpack(np.frombuffer(_spread(data), np.uint8))


def _packed(values: np.ndarray) -> bytes:
    return _squeeze(pack(values)[0])


#: A row of a piece: in a bucket its words there (text and lengths, later ids and their numbers; a fingerprint as counts); in
#: bucket -1 its documents (token counts, other columns), all places by word, and the sum of the fingerprints as places' head.
_ROWS = "piece string, bucket int, words binary, lengths binary, counts binary, places binary"
_ARROW = pa.schema([("piece", pa.string()), ("bucket", pa.int32()), *[(x, pa.binary()) for x in ("words", "lengths", "counts", "places")]])


def _ordered(words: list[str], buckets: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Each pre-token's number among the distinct ones, those ordered by bucket, and their buckets."""
    index: dict[str, int] = {}
    number = index.setdefault
    ids = np.fromiter((number(w, len(index)) for w in words), np.int64, len(words))
    bucket = np.fromiter((xxhash.xxh32_intdigest(w.encode()) % buckets for w in index), np.int64, len(index))
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty(len(index), np.int64)
    rank[by_bucket] = np.arange(len(index))
    distinct = list(index)
    return rank[ids], [distinct[k] for k in by_bucket], bucket[by_bucket]


def _rows(name: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array(x, f.type) for x, f in zip(columns, list(_ARROW)[1:])]], schema=_ARROW)


def _by_bucket(distinct: list[str], bucket: np.ndarray) -> Iterator[tuple[int, list[str], str, int]]:
    """Bucket, words, their text and its fingerprint."""
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(distinct))
    for low, high in zip(cuts, cuts[1:]):
        own = distinct[low:high]
        text = "".join(own)
        yield int(bucket[low]), own, text, xxhash.xxh64_intdigest(text.encode(), len(own))


def _word_rows(name: str, words: list[str], counts: list[int], others: list[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    _, distinct, bucket = _ordered(words, buckets)
    return _rows(name, [
        (k, _squeeze(text.encode()), _packed(np.fromiter(map(len, own), np.int64, len(own))), mark.to_bytes(8, "little"), b"")
        for k, own, text, mark in _by_bucket(distinct, bucket)
    ])


def _place_rows(name: str, words: list[str], counts: list[int], others: list[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    ids, distinct, bucket = _ordered(words, buckets)
    marks = sum(mark for *_, mark in _by_bucket(distinct, bucket)) % 2**64
    order = np.argsort(ids, kind="stable")
    gaps = np.diff(order, prepend=0)
    heads = np.flatnonzero(np.diff(ids[order], prepend=-1))
    gaps[heads] = order[heads]
    times = np.diff(np.append(heads, len(order)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, others[0].schema) as out:
        for part in others:
            out.write_batch(part)
    places = marks.to_bytes(8, "little") + _packed(gaps)
    return _rows(name, [(-1, _squeeze(sink.getvalue().to_pybytes()), _packed(times), _packed(np.array(counts, np.int64)), places)])


# --- vocabulary ----------------------------------------------------------------------------


def read_ranks(path: str) -> bytes:
    """The rank file at the driver: base64 token and rank in each line."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


_kept: dict[tuple[str, str], object] = {}


def _once(kind: str, key: bytes, make):
    """One per worker process."""
    name = (kind, hashlib.sha256(key).hexdigest())
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={})


# --- operators -----------------------------------------------------------------------------


def encode(docs: DataFrame, ranks: bytes, pattern: str, to: str = "ids", piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """``docs`` with ``text`` replaced by its token ids, as array<int> in column ``to``."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(ranks)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(to_rows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, task, k = splitter(pattern), TaskContext.get().partitionId(), 0
            words, counts, others = [], [], []
            for batch in batches:
                texts, rest, begin = batch.column("text"), batch.drop_columns(["text"]), 0
                for i in range(batch.num_rows):
                    found = find(texts[i].as_py() or "")
                    words += found
                    counts.append(len(found))
                    if len(words) >= piece_tokens or len(counts) >= PIECE_ROWS:
                        yield to_rows(f"{task}-{k}", words, counts, [*others, rest.slice(begin, i + 1 - begin)], buckets)
                        words, counts, others, begin, k = [], [], [], i + 1, k + 1
                if begin < batch.num_rows:
                    others.append(rest.slice(begin))
            if counts:
                yield to_rows(f"{task}-{k}", words, counts, others, buckets)

        return run

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _once("encoder", vocabulary.value, lambda: _encoder(vocabulary.value, pattern)).encode_ordinary
        now, known = -2, {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    now, known = row["bucket"], {}
                text, at, coded = _spread(row["words"]).decode(), 0, []
                for size in _numbers(row["lengths"]).tolist():
                    word = text[at : at + size]
                    at += size
                    if word not in known:
                        known[word] = ids_of(word)
                    coded.append(known[word])
                row["words"] = _packed(np.array([i for ids in coded for i in ids], np.int64))
                row["lengths"] = _packed(np.fromiter(map(len, coded), np.int64, len(coded)))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def lay_out(rows: pa.Table) -> pa.Table:
        flat, size, marks = [], [], 0
        for row in sorted(rows.to_pylist(), key=lambda r: r["bucket"]):
            if row["bucket"] < 0:
                others = pa.ipc.open_stream(_spread(row["words"])).read_all()
                each, counts, gaps = _numbers(row["lengths"]), _numbers(row["counts"]), _numbers(row["places"][8:])
                marks -= int.from_bytes(row["places"][:8], "little")
            else:
                marks += int.from_bytes(row["counts"], "little")
                flat.append(_numbers(row["words"]))
                size.append(_numbers(row["lengths"]))
        flat, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (flat, size))
        if marks % 2**64 or len(size) != len(each):
            raise ValueError("the two splittings of the input differ: its rows must come in a stable order")
        total = int(counts.sum())
        at = np.concatenate(([0], np.cumsum(size)))[:-1]
        word_at = np.empty(total, np.int64)
        word_at[_running(gaps, each)] = np.repeat(np.arange(len(size)), each)
        sizes = size[word_at]
        ends = np.cumsum(sizes)
        pick = np.arange(int(ends[-1]) if total else 0) - np.repeat(ends - sizes, sizes) + np.repeat(at[word_at], sizes)
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat[pick], pa.int32()))
        return others.append_column(to, ids) if others.num_columns else pa.table({to: ids})

    kept = [f for f in docs.schema.fields if f.name not in ("text", to)]
    schema = T.StructType([*kept, T.StructField(to, T.ArrayType(T.IntegerType()))])
    rows = docs.select(*[f.name for f in kept], "text")
    coded = (
        rows.select("text").mapInArrow(deal(_word_rows), _ROWS)
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode_words, _ROWS)
    )
    # the places come first in the union, so that their tasks are numbered as those that made the words
    return rows.mapInArrow(deal(_place_rows), _ROWS).union(coded).groupBy("piece").applyInArrow(lay_out, schema)


def _running(gaps: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Running sums of ``gaps``, begun anew after each group of ``each`` numbers."""
    if not len(gaps):
        return gaps
    sums = np.cumsum(gaps)
    starts = np.concatenate(([0], np.cumsum(each)))[:-1]
    before = np.where(starts > 0, sums[starts - 1], 0)
    return sums - np.repeat(before, each)


def decode(coded: DataFrame, ranks: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ids in column ``to``."""
    vocabulary = coded.sparkSession.sparkContext.broadcast(ranks)

    def table() -> list[bytes]:
        by_id = {i: token for token, i in parse_ranks(vocabulary.value).items()}
        return [by_id.get(i, b"") for i in range(max(by_id) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _once("table", vocabulary.value, table).__getitem__
        for batch in batches:
            lists = batch.column(ids)
            out = [b"".join(map(token, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in lists]
            rest = batch.drop_columns([to]) if to in batch.schema.names else batch
            yield rest.append_column(to, pa.array(out, pa.binary()))

    kept = [f for f in coded.schema.fields if f.name != to]
    return coded.mapInArrow(run, T.StructType([*kept, T.StructField(to, T.BinaryType())]))
