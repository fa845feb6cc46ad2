"""Windows of tokens from the text of ``documents``, by Columns only.

White space is collapsed, a window ends after a token that ends in ``. ! ?``,
and a window of more than ``HARD_LIMIT`` tokens is cut.  Nothing is shuffled:
a text becomes its windows within its row, so a window is ready for whatever
works on windows.  Null and empty texts give no windows.

Each token gets candidate readings by a small fixed lexicon of endings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARD_LIMIT = 500

# The words and endings of the lexicon.
DETERMINERS = ["the", "The", "a", "la", "La", "le", "der", "die", "el"]
VERB_ENDS, NOUN_ENDS, PLURAL_ENDS, ADJECTIVE_ENDS = ["ed", "en", "er", "ing"], ["tion", "nt", "st", "ou", "in", "at"], ["s"], ["ly", "ble", "le", "al"]
SHORT = 3  # letters; no determiner has more
#: The same as patterns: an ending may be followed by one full stop or comma.
VERB, NOUN, PLURAL, ADJECTIVE = (f"({'|'.join(x)})[.,]?$" for x in (VERB_ENDS, NOUN_ENDS, PLURAL_ENDS, ADJECTIVE_ENDS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row or element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tags_of(stem: str, before: list[list[str]], after: list[list[str]]) -> list[list[str]]:
    """The readings of a stem by its endings, between others."""
    some = lambda ends: any(stem.endswith(x) for x in ends)
    verb = ["V", "PST"] if stem.endswith("ed") else ["V", "PRS"]
    kinds = [(VERB_ENDS, verb), (NOUN_ENDS, ["N", "SG"]), (PLURAL_ENDS, ["N", "PL"]), (ADJECTIVE_ENDS, ["ADJ"])]
    return [*before, *[tags for ends, tags in kinds if some(ends)], *after]


def readings(word: Column) -> Column:
    """array<array<string>>: the tags of each candidate reading.

    The longest ending that a stem has decides, as the others are endings of it; so each answer is a constant.
    Endings of two letters and determiners are looked up in a list, which is one call where a chain of conditions is many.
    """
    constant = lambda found: F.array(*[F.array(*map(F.lit, tags)) for tags in found])
    every = sorted({*VERB_ENDS, *NOUN_ENDS, *PLURAL_ENDS, *ADJECTIVE_ENDS}, key=lambda x: (-len(x), x))
    two = [x for x in every if len(x) == 2]
    # a longer ending that says the same as its last two letters isn't asked
    longer = [x for x in every if len(x) > 2 and tags_of(x, [], []) != tags_of(x[-2:], [], [])]
    first, later = [x for x in longer if x[-2:] in two], [x for x in longer if x[-2:] not in two] + [x for x in every if len(x) < 2]

    def listed(value: Column, keys: list[str], answers: list[list[list[str]]]) -> Column:
        """The answer to the key that the value equals, or NULL."""
        return F.get(F.array(*map(constant, answers)), F.find_in_set(value, F.lit(",".join(keys))) - 1)

    def chain(stem: Column, endings: list[str], after: list[list[str]], otherwise: Column) -> Column:
        for x in reversed(endings):
            otherwise = F.when(F.endswith(stem, F.lit(x)), constant(tags_of(x, [], after))).otherwise(otherwise)
        return otherwise

    def by_ending(stem: Column, after: list[list[str]], none: Column) -> Column:
        known = listed(F.substring(stem, -2, 2), two, [tags_of(x, [], after) for x in two])
        return chain(stem, first, after, F.coalesce(known, chain(stem, later, after, none)))

    def stemmed(after: list[list[str]]) -> Column:
        none = constant(after or [["X"]])
        marked = F.endswith(word, F.lit(".")) | F.endswith(word, F.lit(","))  # no ending has one of them
        bare = let(F.substring(word, F.lit(1), F.length(word) - 1), lambda stem: by_ending(stem, after, none))
        return by_ending(word, after, F.when(marked, bare).otherwise(none))

    determiner = listed(word, DETERMINERS, [tags_of(x, [["DET"]], []) for x in DETERMINERS])
    return F.when(F.length(word) <= SHORT, F.coalesce(determiner, stemmed([["PRP"]]))).otherwise(stemmed([]))


def words(text: Column) -> Column:
    """The text with single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\n\r]+", " "))


def windows(docs: DataFrame, hard_limit: int = HARD_LIMIT) -> DataFrame:
    """(doc_id, win, part, words): a row per window; parts of a window beyond the limit are numbered from 0."""
    sentences = F.split(F.regexp_replace(words(F.col("text")), "([.!?]) ", "$1\n"), "\n")
    rows = docs.select("doc_id", F.posexplode(sentences).alias("place", "sentence")).select(
        "doc_id", (F.col("place") + 1).alias("win"), F.filter(F.split("sentence", " "), lambda x: x != "").alias("words")
    )
    cut = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / hard_limit).cast("int"))
    return (
        rows.filter(F.size("words") > 0)
        .select("doc_id", "win", F.explode(cut).alias("part"), "words")
        .select("doc_id", "win", "part", F.slice("words", F.col("part") * hard_limit + 1, F.lit(hard_limit)).alias("words"))
    )


def cohorts(found: DataFrame) -> DataFrame:
    """``windows`` with ``cohorts``: array of struct wf, rds; a token's place is its index + 1."""
    return found.select(
        "doc_id", "win", "part",
        F.transform("words", lambda w: F.struct(w.alias("wf"), readings(w).alias("rds"))).alias("cohorts"),
    )


def full_windows(found: DataFrame) -> DataFrame:
    """``cohorts`` in the full window schema, for the kernel."""
    from lexiloom.schema import COHORT, READING, SUB

    empty = F.array().cast(f"array<{READING}>")
    reading = lambda tags, word, i: F.struct(
        ((i + 1) * 1000).cast("int").alias("rno"), F.concat(F.array(F.concat(F.lit('"'), word, F.lit('"'))), tags).alias("tags"),
        F.lit(None).cast("string").alias("mapping"), F.lit(False).alias("mapped"), F.lit(False).alias("noprint"), F.lit(False).alias("immutable"),
        F.array().cast("array<int>").alias("hit_by"), F.array().cast(f"array<{SUB}>").alias("subs"),
    )
    cohort = F.transform(
        "cohorts",
        lambda c, k: F.struct(
            (k + 1).cast("long").alias("gid"), F.concat(F.lit('"<'), c["wf"], F.lit('>"')).alias("wordform"), F.array().cast("array<string>").alias("static_tags"),
            F.lit(0).cast("long").alias("dep_self"), F.lit(None).cast("long").alias("dep_parent"), F.create_map().cast("map<string,array<bigint>>").alias("relations"),
            F.lit("").alias("text"), F.lit("").alias("wblank"), F.lit(False).alias("removed"),
            F.transform(c["rds"], lambda r, i: reading(r, c["wf"], i)).alias("readings"), empty.alias("deleted"), empty.alias("delayed"), empty.alias("hidden"),
        ),
    )
    return found.select(
        "doc_id", (F.col("win") * 1000 + F.col("part")).cast("int").alias("win"), F.lit("").alias("text"), F.lit("").alias("text_post"), F.lit(False).alias("flush_after"),
        F.create_map().cast("map<string,string>").alias("vars_set"), F.array().cast("array<string>").alias("vars_rem"), cohort.cast(f"array<{COHORT}>").alias("cohorts"),
    )
