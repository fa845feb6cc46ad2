"""Quality rules: per-text base rules and cross-document line frequency.

Everything here is DataFrame operations; no row passes through Python.

*Base rules* look at one text: too few words, or too many words inside
repeated three-word windows.

*Line frequency.*  Lines are normalised (white space collapsed, trimmed, lower
case), hashed, and the distinct documents that hold them are counted per host.
Exact copies of a text count as one document; texts that differ count each,
near copies too.  A line is above the limits when more than ``max_docs``
different documents of the host hold it.  Lines above the limits are removed,
and a document of which less than ``min_left`` of the words stay is rejected
as depleted.

Scale: the text is read once and reduced to a small table of counts and line
hashes.  Counting shuffles (host, line) pairs after map-side aggregation, so a
line found in a third of all documents sends one row per task.

Cases: a null text has no words and no lines; it fails the base rules.  A null
host is a host of its own.  Repeated rows get equal verdicts.  Other columns of
the input, of any name, pass through :func:`clean` untouched and are ignored by
:func:`judge`.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import materialize

#: A word: anything but the space and the control white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 20
MIN_LEFT = 0.3
#: Up to so many repeated windows are looked up one by one.
FEW_REPEATS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_key(line: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, BLANKS, " "))))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _lines(text: Column) -> Column:
    """The ``\\n``-split lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more.

    The windows' hashes are sorted so that equal ones meet.  If few hashes
    repeat, the windows are looked up among them; else windows are sorted with
    their places, so that a long text of repeats stays n log n.  The places of
    repeated windows, in order, cover three words each less the overlap.
    """
    none = F.lit(0).cast("long")

    def cover(places: Column) -> Column:
        nexts = F.slice(places, 2, F.size(places))
        gaps = F.zip_with(places, nexts, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, none, lambda total, x: total + x)

    def by_sorting(hashes: Column) -> Column:
        def repeated(marked: Column) -> Column:
            def found(x: Column, i: Column) -> Column:
                before, after = F.get(marked, i - 1)["h"], F.get(marked, i + 1)["h"]
                return before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"])

            return F.sort_array(F.transform(F.filter(marked, found), lambda x: x["i"]))

        return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)

    def by_lookup(hashes: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, F.get(hashes, i)))

    def windows(hashes: Column) -> Column:
        def counted(twice: Column) -> Column:
            places = F.when(F.size(twice) <= FEW_REPEATS, by_lookup(hashes, twice)).otherwise(by_sorting(hashes))
            return F.when(F.size(twice) == 0, none).otherwise(let(places, cover))

        repeats = let(F.sort_array(hashes), lambda x: F.array_distinct(F.filter(x, lambda h, i: (i > 0) & (h == F.get(x, i - 1)))))
        return let(repeats, counted)

    def hashed(one: Column) -> Column:
        mix = lambda i: F.get(one, i).bitwiseXOR(F.shiftleft(F.get(one, i + 1), 1)).bitwiseXOR(F.shiftleft(F.get(one, i + 2), 2))
        return let(F.transform(F.sequence(F.lit(0), F.size(one) - 3), mix), windows)

    return F.when(F.size(words) < 4, none).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def base_counts(docs: DataFrame) -> DataFrame:
    """Per row: ids, the base rules' counts and the line hashes; no text.

    Columns: doc_id, source, text_key, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        "source",
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        _lines(text).alias("kept_lines"),
    )
    words, lines = F.col("words"), F.col("kept_lines")
    counted = split.select(
        "doc_id",
        "source",
        text_key(F.col("text")).alias("text_key"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.transform(
            lines, lambda x: F.struct(line_key(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))
        ).alias("lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def lines_above_limits(base: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(source, line) of the lines above the limits.

    A first count over all pairs leaves the few lines that enough rows hold;
    only these are then counted by different text.
    """
    held = base.select(
        "source", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")
    )
    often = (
        held.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs)
        .select(F.col("source").alias("often_source"), F.col("line").alias("often_line"))
    )
    texts = (
        held.join(often, F.col("source").eqNullSafe(F.col("often_source")) & (F.col("line") == F.col("often_line")), "left_semi")
        .groupBy("source", "line", "text_key").agg(F.lit(1).alias("one"))
    )
    counts = texts.groupBy("source", "line").agg(F.count(F.lit(1)).alias("documents"))
    return counts.filter(F.col("documents") > max_docs).select("source", "line")


def _removed(base: DataFrame, above: DataFrame) -> DataFrame:
    """Per (source, text_key) with lines above the limits: their words and hashes."""
    marks = above.select(F.col("source").alias("above_source"), F.col("line").alias("above_line"))
    rows = base.groupBy("source", "text_key").agg(F.first("lines").alias("lines"))
    return (
        rows.select("source", "text_key", F.explode("lines").alias("x"))
        .select("source", "text_key", "x.line", "x.words")
        .join(marks, F.col("source").eqNullSafe(F.col("above_source")) & (F.col("line") == F.col("above_line")), "left_semi")
        .groupBy(F.col("source").alias("r_source"), F.col("text_key").alias("r_text_key"))
        .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    )


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): counts and verdict.

    Returns doc_id, source, text_key, the base counts, base_failed,
    removed_words, removed_lines (hashes) and kept.
    """
    base = materialize(base_counts(docs), "line-base")
    removed = _removed(base, lines_above_limits(base, max_docs))
    joined = base.drop("lines").join(
        removed,
        F.col("source").eqNullSafe(F.col("r_source")) & (F.col("text_key") == F.col("r_text_key")),
        "left",
    )
    words = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    depleted = (F.col("n_words") - words) < F.lit(min_left) * F.col("n_words")
    return joined.select(
        "doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        words.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def clean(docs: DataFrame, **limits: float) -> DataFrame:
    """The kept rows of ``docs`` without the lines above the limits, with n_chars to match.

    All columns of ``docs`` stay, in their order and whatever their names.
    """
    verdicts = (
        judge(docs.select("doc_id", "text", "source"), **limits)
        .filter("kept").groupBy("source", "text_key").agg(F.first("removed_lines").alias("lines"))
    )
    row = F.col("row")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    joined = rows.join(verdicts, row["source"].eqNullSafe(F.col("source")) & (F.col("key") == F.col("text_key")), "inner")
    left = F.array_join(F.filter(F.split(row["text"], "\n", -1), lambda x: ~F.array_contains(F.col("lines"), line_key(x))), "\n")
    changed = row.withField("text", left)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(left).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.size("lines") == 0, row).otherwise(changed).alias("row")).select("row.*")
