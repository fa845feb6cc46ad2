"""Multi-party chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered once more:
that speaker's turns as the assistant's, the others' as turns of named users.
The mask covers what the assistant is to learn: the content of its turns and
the mark that ends them.

Everything is DataFrame operations; no row passes through Python.

Scale: a dialogue is rendered whole, in one row per participant.  One of more
than ``PART_TURNS`` turns is stored in parts, consecutive stretches of the same
rendering that give it when joined in order; no turn is cut.  Such long
dialogues are found by a count with map-side aggregation and put in order by a
global sort over ranges, so that one that holds a third of all rows is spread over
tasks; turns repeated in all columns are counted first and sorted once.  The
turns of all others meet in one shuffle, and the rotation happens after that,
within the row.

Cases: a null text is empty; a null turn counts as turn 0; turns with a null or
empty role are rendered as a user's without a name and aren't a participant's;
system turns stay system turns and have no perspective of their own.  Equal
turns are ordered by role and text; repeated rows are repeated turns.  Null
conversation ids make one conversation.  A conversation without participants
gives no rows.  The control marks are broken up where a text contains them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.storage import materialize

#: Turns of a dialogue in one row.
PART_TURNS = 1000
BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _escaped(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column) -> Column:
    named = F.when(role != "", F.concat(F.lit("user name="), role)).otherwise("user")
    return F.concat(
        F.lit(BEGIN), F.when(role == SYSTEM, SYSTEM).when(role == speaker, "assistant").otherwise(named), F.lit("\n")
    )


def _named(role: Column) -> Column:
    return (role != "") & (role != SYSTEM)


def _short(turns: DataFrame) -> DataFrame:
    """(conv_id, part, turns, speaker) of dialogues that one row holds."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda x: x["role"]), _named))
    return whole.select("conv_id", F.lit(0).cast("long").alias("part"), "turns", F.explode(speakers).alias("speaker"))


def _long(turns: DataFrame, part_turns: int) -> DataFrame:
    """The same of longer ones; places come from a global sort and the counts of its partitions."""
    order = ["conv_id", "turn", "role", "text"]
    once = turns.groupBy(*order).agg(F.count(F.lit(1)).alias("times"))
    ranged = materialize(once.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranged.groupBy("conv_id", "range").agg(F.sum("times").alias("n")).select(
        F.col("conv_id").alias("b_conv"), F.col("range").alias("b_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    )
    within = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
    placed = (
        ranged.withColumn("end", F.sum("times").over(within))
        .join(begins, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("range") == F.col("b_range")))
        .withColumn("end", F.col("begin") + F.col("end")).withColumn("start", F.col("end") - F.col("times"))
    )
    first = F.floor(F.col("start") / part_turns)
    cut = placed.withColumn("part", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / part_turns))))
    inside = F.least("end", (F.col("part") + 1) * part_turns) - F.greatest("start", F.col("part") * part_turns)
    parts = materialize(
        cut.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", inside.cast("int").alias("times")))).alias("turns")),
        "parts",
    )
    repeated = F.flatten(F.transform("turns", lambda x: F.array_repeat(F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")), x["times"])))
    speakers = once.filter(_named(F.col("role"))).groupBy(F.col("conv_id").alias("s_conv"), F.col("role").alias("speaker")).agg(F.lit(1).alias("one"))
    # keys first, so that the parts of one dialogue are dealt by part
    keys = parts.select(F.col("conv_id").alias("k_conv"), F.col("part").alias("k_part")).join(speakers, F.col("k_conv").eqNullSafe(F.col("s_conv")))
    same = F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("part") == F.col("k_part"))
    return parts.join(keys, same).select("conv_id", "part", repeated.alias("turns"), "speaker")


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation and participant, or more where a conversation has over ``part_turns`` turns.

    conv_id, speaker, part (from 0), n_turns, text, mask (array of struct
    start, end: character places in ``text``, the end exclusive).
    """
    rows = turns.select(
        "conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), _escaped(F.col("role")).alias("role"), _escaped(F.col("text")).alias("text")
    )
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = materialize(counted.filter(F.col("n") > part_turns).select(F.col("conv_id").alias("l_conv")), "long")
    is_long = F.col("conv_id").eqNullSafe(F.col("l_conv"))
    if long.isEmpty():
        joined = _short(rows)
    else:
        joined = _short(rows.join(long, is_long, "left_anti")).unionByName(_long(rows.join(long, is_long, "left_semi"), part_turns))
    speaker = F.col("speaker")
    pieces = F.transform(
        "turns",
        lambda x: F.struct(
            _head(x["role"], speaker).alias("head"), x["text"].alias("body"),
            ((x["role"] == speaker) & (x["role"] != SYSTEM)).alias("own"),
        ),
    )
    return (
        joined.select("conv_id", "speaker", "part", pieces.alias("pieces"))
        .select(
            "conv_id", "speaker", "part",
            F.size("pieces").alias("n_turns"),
            F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("text"),
            _mask(F.col("pieces")).alias("mask"),
        )
    )


def _mask(pieces: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["head"])
        end = start + F.length(x["body"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda done: done["spans"])
