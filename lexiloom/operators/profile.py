"""Rule profiles: how often each rule and each of its tests matched or failed, and a window where it matched."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiloom.plans.batches import rows_of
from lexiloom.plans.grammar import Grammar, parse
from lexiloom.plans.kernel import Applicator, Options
from lexiloom.plans.rows import window_of

COLUMNS = ["rule", "kind", "line", "context", "num_match", "num_fail", "example_doc", "example_win"]
SCHEMA = "rule int, kind string, line int, context int, num_match long, num_fail long, example_doc long, example_win int"


def profile(windows: DataFrame, grammar: str | Grammar, options: Options | None = None) -> DataFrame:
    """A row for each rule (``context`` is null) and for each of its tests (``context`` counts from 1).

    Counts are summed per partition before the shuffle, so what is shuffled is bounded by
    the grammar times the partitions.  A test under NEGATE counts as matched where what it negates holds.
    """
    g = parse(grammar) if isinstance(grammar, str) else grammar
    arrow = to_arrow_schema(T._parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for r in g.rules():
            for k in range(len(r.tests) + 1):
                total[r.number, k] = [r.number, r.kind, r.line, k or None, 0, 0, None, None]
        for row in rows_of(batches):
            done = Applicator(g, options)
            done.run([window_of(row)])
            seen = {(number, 0): x for number, x in done.counts.items()} | {(number, k + 1): x for (number, k), x in done.test_counts.items()}
            for key, (hit, miss) in seen.items():
                if key in total:
                    total[key][4] += hit
                    total[key][5] += miss
                    here = (row["doc_id"], row["win"])
                    if hit and row["doc_id"] is not None and (total[key][6] is None or here < (total[key][6], total[key][7])):
                        total[key][6:] = here
        yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, x)) for x in total.values()], schema=arrow)

    return merge(windows.mapInArrow(run, SCHEMA))


def merge(*profiles: DataFrame) -> DataFrame:
    """One profile of several runs of the same grammar: counts are summed, of examples the first window stays."""
    rows = profiles[0]
    for p in profiles[1:]:
        rows = rows.unionByName(p)
    example = F.min(F.when(F.col("example_doc").isNotNull(), F.struct("example_doc", "example_win"))).alias("example")
    sums = rows.groupBy("rule", "kind", "line", "context").agg(F.sum("num_match").alias("num_match"), F.sum("num_fail").alias("num_fail"), example)
    return sums.select("rule", "kind", "line", "context", "num_match", "num_fail", "example.example_doc", "example.example_win")


def coverage(profiled: DataFrame) -> DataFrame:
    """Rules and tests with the share of tries that matched; unused ones have 0."""
    tries = F.col("num_match") + F.col("num_fail")
    return profiled.withColumn("share", F.coalesce(F.col("num_match") / F.nullif(tries, F.lit(0)), F.lit(0.0))).withColumn("used", F.col("num_match") > 0)


def report(profiled: DataFrame, grammar: str) -> str:
    """The grammar's text as HTML, each rule's line with its counts; the rows collected are no more than rules and tests."""
    found = {}
    for r in profiled.collect():
        found.setdefault(r.line, []).append((r.rule, r.context or 0, r.kind, r.num_match, r.num_fail, r.example_doc, r.example_win))
    out = ["<!DOCTYPE html>", "<html><head><meta charset='utf-8'><title>Coverage</title></head><body><table>"]
    for number, text in enumerate(grammar.split("\n"), 1):
        rows = sorted(found.get(number, []))
        used = "" if not rows else "unused" if not any(x[3] for x in rows if not x[1]) else "used"
        notes = "; ".join(
            f"{kind if not context else f'test {context}'}: {hit} of {hit + miss}" + (f", first in {doc}:{win}" if doc is not None and not context else "")
            for _, context, kind, hit, miss, doc, win in rows
        )
        out.append(f"<tr class='{used}'><td>{number}</td><td><pre>{escape(text)}</pre></td><td>{escape(notes)}</td></tr>")
    return "\n".join([*out, "</table></body></html>"]) + "\n"
