"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all benchmark items, over words, is built once per worker.
Each document's words stream through it; the length of the longest match that
ends at a word tells which windows of ``window`` item words end there.  A
document word inside any occurrence of a window is *hit*; items shorter than a
window count as one window.

A lossless screen goes before the automaton: words are numbered by the
vocabulary of the items, and only runs in which every neighbouring pair of
words is also a pair of neighbours in some item, and which are as long as the
shortest window, are streamed.  Elsewhere no window can occur.

Scale: documents are scanned once, without a shuffle.  Items are cut into
overlapping pieces that hold all their windows, and the pieces are dealt into
shards of about ``shard_words`` words, so a worker's automaton and what passes
the driver have a bounded size however large the benchmark or an item is; with
more than one shard each shard scans the documents, and the hit spans are
merged per document.

Cases: null and empty texts have no words and are never contaminated.  Items
without words match nothing.  Rows of one item_id are one item; those with a
null id are one item without a name, last in ``items``.  An empty benchmark
leaves every document clean.  Rows may repeat; each is judged alone.  Columns
of any name pass through :func:`decontaminate`; :func:`match_documents`
replaces those of its output's names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.storage import materialize

#: A word of a UTF-8 text whose A-Z were lowered: ASCII digits and letters, and all beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

WINDOW = 13
#: Words of benchmark items in one automaton: about 0.2 GB of Python objects.
SHARD_WORDS = 200_000
#: Words of a longer item's pieces.
ITEM_WORDS = 20_000
#: A document is contaminated when at least one word in so many is hit.
MAX_COVERAGE = 20


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []  # bytes.lower() lowers A-Z only


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    done: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if done and start <= done[-1][1]:
            done[-1] = (done[-1][0], max(done[-1][1], end))
        else:
            done.append((start, end))
    return done


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` for the matches of length at most ``length[p] + 1``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def walk(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each word; unknown words are negative."""
        arcs, link, length = self.next, self.link, self.length
        state = matched = 0
        for word in sequence:
            while state and word not in arcs[state]:
                state = link[state]
                matched = length[state]
            target = arcs[state].get(word)
            if target is not None:
                state, matched = target, matched + 1
            yield state, matched

    def suffix_state(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` words of a match in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


class Matcher:
    """Finds item windows in documents."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        sequences = [(item, [number(w, len(self.vocabulary)) for w in words_of(text)]) for item, text in items]
        sequences = [(item, ids) for item, ids in sequences if ids]
        self.automaton = SuffixAutomaton()
        for _, ids in sequences:
            self.automaton.add(ids)
        #: By state: items of which a window, or the whole if shorter, ends there; by length.
        self.ends: dict[int, dict[int, list[str | None]]] = {}
        pairs: set[int] = set()
        size = len(self.vocabulary)
        for item, ids in sequences:
            pairs.update(a * size + b for a, b in zip(ids, ids[1:]))
            need = min(window, len(ids))
            for state, matched in self.automaton.walk(ids):
                if matched >= need:
                    found = self.ends.setdefault(self.automaton.suffix_state(state, need), {}).setdefault(need, [])
                    if item not in found:
                        found.append(item)
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.shortest = min((min(window, len(ids)) for _, ids in sequences), default=0)

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """[start, end) of the stretches in which a window may lie."""
        known = ids >= 0
        if self.shortest == 1:
            yield 0, len(ids)
            return
        keys = ids[:-1].astype(np.int64) * len(self.vocabulary) + ids[1:]
        both = known[:-1] & known[1:]
        place = np.searchsorted(self.pairs, keys[both])
        joined = both.copy()
        joined[both] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == keys[both] if len(self.pairs) else False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start + 1 >= self.shortest:
                yield int(start), int(end) + 1

    def match(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str | None], int]:
        """Word count, merged hit spans [start, end) in words, items and the longest match within the screened runs."""
        words = words_of(text)
        if not words or not self.shortest or len(words) < self.shortest:
            return len(words), [], set(), 0
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        longest = 0
        link, length, ends = self.automaton.link, self.automaton.length, self.ends
        for start, end in self._runs(ids):
            for at, (state, matched) in enumerate(self.automaton.walk(ids[start:end].tolist()), start + 1):
                longest = max(longest, matched)
                if matched < self.shortest:
                    continue
                widest = 0
                while state and length[state] >= self.shortest:
                    for size, names in ends.get(state, {}).items():
                        if size <= matched:
                            items.update(names)
                            widest = max(widest, size)
                    state = link[state]
                if widest:
                    spans.append((at - widest, at))
        return len(words), joined_spans(spans), items, longest


_matchers: dict[str, Matcher] = {}


def _matcher(items: list[tuple[str | None, str]], window: int) -> Matcher:
    """One per worker process and shard."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, window)
    return _matchers[key]


def pieces(text: str | None, window: int, size: int) -> Iterator[tuple[str, int]]:
    """(text, words) of the parts of an item, which overlap so that each window is whole in one of them."""
    words = words_of(text)
    if len(words) <= size:
        if words:
            yield b" ".join(words).decode(), len(words)
        return
    for start in range(0, len(words) - window + 1, size - window + 1):
        part = words[start : start + size]
        yield b" ".join(part).decode(), len(part)


def shards(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list[DataFrame]:
    """(item, text, n): the items' pieces dealt into parts of about ``shard_words`` words; cut and counted on the executors."""
    size = max(2 * window, min(ITEM_WORDS, shard_words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(item, *part) for item, text in zip(batch["item"], batch["text"]) for part in pieces(text, window, size)]
            yield pd.DataFrame(rows, columns=["item", "text", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    sized = materialize(items.mapInPandas(run, "item string, text string, n long"), "benchmark")
    parts = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // shard_words))
    if parts == 1:
        return [sized]
    return [sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


FOUND = ("n_words", "spans", "items", "longest")
_TYPES = ("long", "array<struct<s:int,e:int>>", "array<string>", "int")
_ARROW = (pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string()), pa.int32())


def _free(name: str, taken: list[str]) -> str:
    """``name``, longer by as many underscores as make it differ from all names ``taken``."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


def match_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, names: tuple[str, ...] = FOUND
) -> DataFrame:
    """``docs`` with n_words, spans (hit words, [s, e)), items and longest, or other ``names`` for these.

    ``longest`` is the longest match among stretches that may hold a window.
    """
    added = [f"`{name}` {kind}" for name, kind in zip(names, _TYPES)]
    clash = {x.lower() for x in names}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash])

    def scan(part: DataFrame, rows: DataFrame) -> DataFrame:
        items = [(r.item, r.text) for r in part.select("item", "text").toLocalIterator()]
        shared = rows.sparkSession.sparkContext.broadcast(items)  # at most one shard

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, window)
            for batch in batches:
                found = [matcher.match(x.as_py()) for x in batch.column("text")]
                columns = (
                    [x[0] for x in found],
                    [[{"s": s, "e": e} for s, e in x[1]] for x in found],
                    [sorted(x[2] - {None}) + [None] * (None in x[2]) for x in found],
                    [x[3] for x in found],
                )
                for name, kind, values in zip(names, _ARROW, columns):
                    batch = batch.append_column(name, pa.array(values, kind))
                yield batch

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T._parse_datatype_string(", ".join(added)).fields]))

    parts = shards(benchmark, window, shard_words)
    if len(parts) == 1:
        return scan(parts[0], docs)
    row = _free("row_of", [*docs.columns, *names])
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    found = None
    for part in parts:
        rows = scan(part, numbered.select(row, "text")).drop("text")
        found = rows if found is None else found.unionByName(rows)
    n_words, spans, items, longest = names
    merged = found.groupBy(row).agg(
        F.max(n_words).alias(n_words),
        merge_spans(F.flatten(F.collect_list(spans))).alias(spans),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
        F.max(longest).alias(longest),
    )
    named = F.concat(F.filter(items, lambda x: x.isNotNull()), F.filter(items, lambda x: x.isNull()))
    return numbered.join(merged.withColumn(items, named), row).drop(row)


def merge_spans(spans):
    """Overlapping and touching [s, e) spans joined, in order."""
    def join(done, x):
        last = F.get(done, F.size(done) - 1)
        return F.when((F.size(done) > 0) & (last["e"] >= x["s"]),
                      F.concat(F.slice(done, F.lit(1), F.size(done) - 1),
                               F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
                      ).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<s:int,e:int>>"), join)


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


def contaminated(coverage: int = MAX_COVERAGE, n_words: str = "n_words", spans: str = "spans"):
    hit = n_hit(spans)
    return (hit > 0) & (coverage * hit >= F.col(n_words))


def remove_spans(text: str | None, spans: list[dict[str, int]]) -> str | None:
    """``text`` without the hit words and what stands between them."""
    if not text or not len(spans):
        return text
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at : places[span["s"]][0]])
        at = places[span["e"] - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = MAX_COVERAGE) -> DataFrame:
    """``docs`` without contaminated documents; hit spans of the others are cut out, and n_chars follows."""
    names = tuple(_free(x, docs.columns) for x in FOUND)
    n_words, spans = names[:2]
    kept = match_documents(docs, benchmark, window, names=names).filter(~contaminated(coverage, n_words, spans))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(spans).to_pylist()
            rest = batch.drop_columns(list(names))
            hit = [i for i, x in enumerate(found) if x]
            if hit:
                texts = batch.column("text").to_pylist()
                for i in hit:
                    texts[i] = remove_spans(texts[i], found[i])
                rest = _replaced(rest, "text", texts)
                if "n_chars" in rest.schema.names:
                    sizes = rest.column("n_chars").to_pylist()
                    for i in hit:
                        sizes[i] = len(texts[i])
                    rest = _replaced(rest, "n_chars", sizes)
            yield rest

    return kept.mapInArrow(cut, docs.schema)


def _replaced(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    field = batch.schema.field(at)
    return batch.set_column(at, field, pa.array(values, field.type))
