"""Token counts by greedy longest match in linear time, without building pieces.

A trie of the vocabulary gets failure links: where a word cannot go on from a
node, the link leads to the node of what remains after the pieces that greedy
matching would have cut off by then, and the number of those *popped* pieces is
stored with the link.  Reading a word is then one step per byte, and its count
is the sum of the popped counts.

Scale: documents are scanned once, without a shuffle; only the vocabulary,
whose size is fixed, is broadcast.  Counts of recent words are kept in a table
of bounded size, so common words are read once.

Cases: null and empty texts have no words.  A word that cannot be covered by
pieces counts as one unknown piece, as word-piece tokenizers do.  An empty
vocabulary makes every word unknown.  Other columns pass through.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexiloom.llm.byte_bpe import _once, parse_ranks

#: Words whose counts a worker remembers.
REMEMBERED = 300_000


class PieceCounter:
    """The automaton; ``first`` are pieces that begin a word, ``rest`` those that go on with it."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes] | None = None) -> None:
        #: node * 256 + byte -> node
        self.step: dict[int, int] = {}
        self.ends = [False]
        self.start = self.inner = 0
        self._insert(first, 0)
        if rest is not None:
            self.ends.append(False)
            self.inner = len(self.ends) - 1
            self._insert(rest, self.inner)
        self._link()

    def _insert(self, pieces: Iterable[bytes], root: int) -> None:
        for piece in pieces:
            node = root
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.ends.append(False)
                    self.step[key] = len(self.ends) - 1
                node = self.step[key]
            self.ends[node] = self.ends[node] or node != root

    def _link(self) -> None:
        """fail[v] is -1 where greedy matching is stuck; popped[v] counts pieces cut off on the way."""
        n = len(self.ends)
        self.fail, self.popped = [-1] * n, [0] * n
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, node in self.step.items():
            below[key >> 8].append((key & 255, node))
        queue = deque({self.start, self.inner})
        while queue:
            parent = queue.popleft()
            for byte, node in below[parent]:
                if self.ends[node]:
                    self.fail[node], self.popped[node] = self.inner, 1
                else:
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and (at << 8 | byte) not in self.step:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.step[at << 8 | byte], count
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; -1 if it can't be covered."""
        step, fail, popped = self.step, self.fail, self.popped
        node, count = self.start, 0
        for byte in word:
            while (at := step.get(node << 8 | byte)) is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = at
        while node not in (self.start, self.inner):
            count += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return count


def count_pieces(docs: DataFrame, ranks: bytes, lead: bytes = b" ") -> DataFrame:
    """``docs`` without ``text``, with n_words, n_tokens and n_unknown.

    The vocabulary is that of a rank file; a word is a run without ASCII white
    space, with ``lead`` in front, as it stands in running text.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _once("pieces", vocabulary.value, lambda: PieceCounter(parse_ranks(vocabulary.value))).count
        known: dict[bytes, int] = {}
        for batch in batches:
            sums = []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                if len(known) > REMEMBERED:
                    known.clear()
                counts = []
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = known[word] = count(lead + word)
                    counts.append(n)
                unknown = counts.count(-1)
                sums.append((len(words), sum(counts) + 2 * unknown, unknown))  # each -1 becomes 1
            out = batch.drop_columns(["text"])
            for name, values in zip(("n_words", "n_tokens", "n_unknown"), zip(*sums) if sums else ((), (), ())):
                out = out.append_column(name, pa.array(values, pa.int64()))
            yield out

    added = ("n_words", "n_tokens", "n_unknown")
    kept = [f for f in docs.schema.fields if f.name not in ("text", *added)]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in added]])
    return docs.select(*[f.name for f in kept], "text").mapInArrow(run, schema)
