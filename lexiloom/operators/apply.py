"""Apply a grammar to window rows.

What the grammar reads and writes decides how:

* no coupling between windows: the kernel on each partition as it lies, no shuffle;
* coupling (span tests, variables, new windows, relations): rows are dealt and sorted by document,
  and the kernel takes one document after the other, as a stream.

Grammars whose rules are all set-based run without Python on windows of plain
readings, by :func:`lexiloom.plans.columns.apply_columns`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from lexiloom.plans.batches import batches_of, rows_of
from lexiloom.plans.grammar import Grammar, Rule, TagSet, Test, parse
from lexiloom.plans.kernel import Applicator, Options, Window
from lexiloom.plans.rows import window_of, window_row
from lexiloom.schema import window_schema

FEWEST = 32  # tasks, where executors may not have come yet


def _tests(t: Test, g: Grammar, opened: frozenset[str] = frozenset()) -> Iterator[Test]:
    """A test with its alternatives, its links, and the templates it names at any depth."""
    yield t
    for x in (*t.ors, *([t.link] if t.link else [])):
        yield from _tests(x, g, opened)
    if t.template and t.template in g.templates and t.template not in opened:
        yield from _tests(g.templates[t.template], g, opened | {t.template})


def _sets(s: TagSet | None, g: Grammar, seen: set[str]) -> Iterator[TagSet]:
    if s is None:
        return
    yield s
    for p in s.parts:
        yield from _sets(p, g, seen)
    if s.op in ("name", "unify_tag", "unify_set") and s.name in g.sets and s.name not in seen:
        seen.add(s.name)
        yield from _sets(g.sets[s.name], g, seen)


def couples_windows(g: Grammar, options: Options) -> bool:
    """Whether a window's result can depend on other windows of its document."""
    if options.always_span:
        return True
    seen: set[str] = set()

    def rule_couples(r: Rule) -> bool:
        if r.kind in ("SETVARIABLE", "REMVARIABLE", "DELIMIT", "COPYCOHORT", "EXTERNAL") or "RELATION" in r.kind:
            return True
        tests = [x for t in (*r.tests, *r.dep_tests) for x in _tests(t, g)]
        if any(t.has("span", "span_left", "span_right") or t.relation for t in tests):
            return True
        sets = [r.target, r.maplist, r.sublist, *(s for t in tests for s in (t.target, t.barrier, t.cbarrier))]
        if any(tag.kind == "var" for s in sets for x in _sets(s, g, seen) for tag in x.tags()):
            return True
        return any(rule_couples(x) for x in r.nested)

    return any(rule_couples(r) for r in g.rules())


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in four tasks a core, within the session's shuffle partitions but no fewer than cores.

    A number is given, or the runtime would join partitions of few bytes: windows are small and cost much time in Python.
    More tasks than these gain nothing, as each has a tenth of a second of its own.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(FEWEST, 4 * cores))), *keys)


def apply_grammar(
    windows: DataFrame, grammar: str | Grammar, options: Options | None = None,
    external: Callable[[str, Window], bool] | None = None, per_document: bool | None = None,
) -> DataFrame:
    """``windows`` (see :mod:`lexiloom.schema`) after the grammar."""
    g = parse(grammar) if isinstance(grammar, str) else grammar
    o = options or Options()
    together = couples_windows(g, o) if per_document is None else per_document
    schema = window_schema()
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches)
        return batches_of(documents(rows) if together else single(rows), arrow)

    def documents(rows: Iterator[dict]) -> Iterator[dict]:
        for doc_id, found in groupby(rows, lambda r: r["doc_id"]):
            done = Applicator(g, o, external).run([window_of(r) for r in found])
            yield from (window_row(doc_id, k, w) for k, w in enumerate(done, 1))

    def single(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            done = Applicator(g, o, external).run([window_of(row)])
            yield window_row(row["doc_id"], row["win"], done[0])

    if together:
        # Spark leaves the exchange out where the rows already lie by document
        windows = dealt(windows, "doc_id").sortWithinPartitions("doc_id", "win")
    return windows.mapInArrow(run, schema)
