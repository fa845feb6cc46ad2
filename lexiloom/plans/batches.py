"""Rows through Python a few at a time: a worker holds a piece of a batch as objects, however many rows Arrow sends at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: A piece has at most so many rows, and on average so many bytes in Arrow; what is given back, so many cohorts or 256 characters each.
ROWS, BYTES, WEIGHT = 256, 1 << 20, 2048


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows; nested columns arrive as arrays of dicts, maps as lists of pairs."""
    for batch in batches:
        n = max(1, min(ROWS, BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, n):
            piece = batch.slice(at, n)
            columns = [c.to_pandas(integer_object_nulls=True) if pa.types.is_nested(c.type) else c.to_pylist() for c in piece.columns]
            for values in zip(*columns):
                yield dict(zip(piece.schema.names, values))


def batches_of(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of a bounded size; a row is never cut."""
    piece: list[dict] = []
    weight = 0
    for row in rows:
        piece.append(row)
        weight += len(row.get("cohorts") or ()) + len(row.get("text") or "") // 256
        if len(piece) >= ROWS or weight >= WEIGHT:
            yield pa.RecordBatch.from_pylist(piece, schema=schema)
            piece, weight = [], 0
    if piece:
        yield pa.RecordBatch.from_pylist(piece, schema=schema)
