"""Connected components of a graph given by its edges, by contraction.

Each round every node joins the neighbour of least rank (itself among them),
and the edges are rewritten to the nodes joined; loops and repeated edges go.
Ranks are hashes drawn anew each round, so a path shrinks by a constant share
a round, and a star of any size in one round.  Rounds grow with the logarithm of the
largest component, and their tables shrink with the edges that are left.

Each round is a stored table; nothing but whether edges are left reaches the
driver.  The tables of earlier rounds are removed once the last is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of ``edges`` (a, b); the root is a component's least node.

    Null ends are dropped; loops and repeated edges do no harm; no edges, no rows.
    """
    left = materialize(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    written, steps, first = [left], [], left
    while not left.isEmpty():
        step = materialize(_joined(left, len(steps)), "steps")
        low = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        high = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = materialize(
            left.join(low, "a").join(high, "b").filter("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        steps.append(step)
        written += [step, left]
    if not steps:
        return first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    ends = steps[0].select("node", F.col("to").alias("end"))
    for step in steps[1:]:
        moved = step.select(F.col("node").alias("end"), "to")
        ends = ends.join(moved, "end", "left").select("node", F.coalesce("to", "end").alias("end"))
    least = ends.groupBy("end").agg(F.min("node").alias("root"))
    found = materialize(ends.join(least, "end").select("node", "root"), "components")
    discard(*written)
    return found


def _joined(edges: DataFrame, turn: int) -> DataFrame:
    """(node, to): the node or neighbour of least rank."""
    rank = lambda x: F.struct(F.xxhash64(F.lit(turn), x).alias("rank"), x.alias("node"))
    pair = lambda u, v: F.struct(F.col(u).alias("node"), F.least(rank(F.col(u)), rank(F.col(v))).alias("best"))
    both: Column = F.explode(F.array(pair("a", "b"), pair("b", "a")))
    return edges.select(both.alias("e")).groupBy("e.node").agg(F.min("e.best").alias("best")).select("node", F.col("best.node").alias("to"))
