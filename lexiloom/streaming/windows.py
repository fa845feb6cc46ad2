"""Grammars over streams.

Windows that don't depend on each other need no state: the same plan as in
batch runs on the stream.  Variables that carry over windows are state per
document; a retired window is never visited again, so there is no late data
beyond the order in which windows arrive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiloom.operators.apply import apply_grammar
from lexiloom.plans.grammar import parse
from lexiloom.plans.kernel import Applicator, Options, Window
from lexiloom.plans.rows import window_of, window_row
from lexiloom.schema import FIELDS, window_schema


def apply_stateless(stream: DataFrame, grammar: str) -> DataFrame:
    """A grammar without coupling between windows, on a stream of window rows."""
    return apply_grammar(stream, grammar, per_document=False)


def continue_ids(windows: list[Window], start: int) -> None:
    """Shifts a micro-batch's ids, and what refers to them, to go on from ``start`` where they begin anew."""
    cohorts = [c for w in windows for c in w.all[1:]]
    given = [c.gid for c in cohorts if c.gid]
    by = start - min(given, default=start)
    if by <= 0:
        return
    for c in cohorts:
        c.gid += by if c.gid else 0
        c.dep_parent = c.dep_parent + by if c.dep_parent else c.dep_parent
        c.relations = {name: {g + by for g in found} for name, found in c.relations.items()}


def apply_with_variables(stream: DataFrame, grammar: str, options: Options | None = None) -> DataFrame:
    """A grammar with variables: per document their values, and the ids given so far, are kept between micro-batches."""
    g = parse(grammar)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = Applicator(g, options)
        if state.exists:
            done.variables, done.next_gid = json.loads(state.get[0]), state.get[1]
        rows = pd.concat(list(frames)).sort_values("win", kind="stable").to_dict("records")
        arrived = [window_of(r) for r in rows]
        continue_ids(arrived, done.next_gid)
        windows = done.run(arrived)
        state.update((json.dumps(done.variables), done.next_gid))
        numbers = [r["win"] for r in rows] + [rows[-1]["win"]] * (len(windows) - len(rows))
        yield pd.DataFrame([window_row(key[0], n, w) for n, w in zip(numbers, windows)], columns=FIELDS)

    return stream.groupBy("doc_id").applyInPandasWithState(run, window_schema(), "variables string, next_gid long", "append", GroupStateTimeout.NoTimeout)


def carry_variables(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Per user and ten minutes of event time, the events by type: late rows beyond ``delay`` are dropped."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", "10 minutes").alias("w"), "user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n")).select("user_id", "event_type", F.col("w.start").alias("since"), "n")
    )
