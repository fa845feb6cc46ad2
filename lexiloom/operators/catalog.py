"""Queries over tokens of ``documents``: grammars as Columns, each with its SQL.

A query is a row per window, so results stay small against the text; all work
happens within the window's row and no query here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.plans import columns
from lexiloom.plans.grammar import Grammar, parse
from lexiloom.sources import documents
from lexiloom.storage import table

Query = Callable[[SparkSession, str], DataFrame]

# --- SQL building blocks ----------------------------------------------------------------------

_DETS = ", ".join(f"'{x}'" for x in documents.DETERMINERS)
SQL_WINDOWS = r"""
n AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g')) AS norm FROM documents),
s AS (SELECT doc_id, string_split(regexp_replace(norm, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS ss FROM n),
s1 AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1)::INT AS win FROM s),
s2 AS (SELECT doc_id, win, list_filter(string_split(sentence, ' '), lambda x: x <> '') AS ws FROM s1),
s3 AS (SELECT doc_id, win, ws, unnest(range(0, (len(ws) - 1) // 500 + 1))::INT AS part FROM s2 WHERE len(ws) > 0),
w AS (SELECT doc_id, win, part, ws[part * 500 + 1 : part * 500 + 500] AS words FROM s3)"""
SQL_TOKENS = (
    SQL_WINDOWS
    + f""",
t AS (SELECT doc_id, win, part, unnest(words) AS wf, generate_subscripts(words, 1)::INT AS pos FROM w),
r0 AS (SELECT *, list_filter([
   CASE WHEN wf IN ({_DETS}) THEN ['DET'] END,
   CASE WHEN regexp_matches(wf, '{documents.VERB}') THEN CASE WHEN regexp_matches(wf, 'ed[.,]?$') THEN ['V', 'PST'] ELSE ['V', 'PRS'] END END,
   CASE WHEN regexp_matches(wf, '{documents.NOUN}') THEN ['N', 'SG'] END,
   CASE WHEN regexp_matches(wf, '{documents.PLURAL}') THEN ['N', 'PL'] END,
   CASE WHEN regexp_matches(wf, '{documents.ADJECTIVE}') THEN ['ADJ'] END,
   CASE WHEN length(wf) <= 3 AND wf NOT IN ({_DETS}) THEN ['PRP'] END], lambda x: x IS NOT NULL) AS rs FROM t),
tok AS (SELECT doc_id, win, part, pos, wf, CASE WHEN len(rs) = 0 THEN [['X']] ELSE rs END AS rds FROM r0)"""
)
WINDOW = "PARTITION BY doc_id, win, part ORDER BY pos"


def has(tags: str, of: str = "rds") -> str:
    """SQL: some reading has all these tags."""
    cond = " AND ".join(f"list_contains(r, '{x}')" for x in tags.split())
    return f"(len(list_filter({of}, lambda r: {cond})) > 0)"


def careful(tags: str, of: str = "rds") -> str:
    cond = " AND ".join(f"list_contains(r, '{x}')" for x in tags.split())
    return f"(len(list_filter({of}, lambda r: {cond})) = len({of}))"


_SHOW = "array_to_string(list_transform(rds, lambda r: array_to_string(r, ' ')), '|')"


def edited_sql(rds: str, extra: str = "") -> str:
    """Windows after ``rds`` replaced the readings; ``extra`` are more columns of the token rows."""
    return f"""WITH {SQL_TOKENS},
x AS (SELECT *{', ' + extra if extra else ''} FROM tok),
y AS (SELECT doc_id, win, part, pos, {rds} AS rds FROM x)
SELECT doc_id, win, part, string_agg({_SHOW}, ' ' ORDER BY pos) AS tags FROM y GROUP BY ALL"""


def hits_sql(cond: str, extra: str = "") -> str:
    """Windows with the places where ``cond`` holds."""
    return f"""WITH {SQL_TOKENS},
x AS (SELECT *{', ' + extra if extra else ''} FROM tok)
SELECT doc_id, win, part, string_agg(CASE WHEN {cond} THEN pos::VARCHAR END, ',' ORDER BY pos) AS hits
FROM x GROUP BY ALL HAVING count(CASE WHEN {cond} THEN 1 END) > 0"""


# --- Spark building blocks --------------------------------------------------------------------


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.cohorts(documents.windows(table(spark, sf_dir, "documents").select("doc_id", "text")))


def show(found: DataFrame) -> DataFrame:
    """A string of each window's readings."""
    one = lambda c: F.array_join(F.transform(c["rds"], lambda r: F.array_join(r, " ")), "|")
    return found.select("doc_id", "win", "part", F.array_join(F.transform("cohorts", one), " ").alias("tags"))


def rules(grammar: str) -> Query:
    return lambda spark, sf_dir: show(columns.apply_columns(windows(spark, sf_dir), grammar))


def shown_if(found: DataFrame, name: str, value: Column, condition: str) -> DataFrame:
    """doc_id, win, part and ``value`` where ``condition`` holds; through a one-element explode, so that the filter doesn't compute it anew."""
    return found.select("doc_id", "win", "part", F.explode(F.array(value)).alias(name)).filter(condition)


def places(found: DataFrame, good: Callable[[Column, Column, columns.View], Column], tests: tuple = (), g: Grammar | None = None) -> DataFrame:
    """Windows with the places (from 1) at which ``good(place from 0, cohorts, view for the tests)`` holds."""
    at = lambda c, view: F.transform(c, lambda _, i: F.when(good(i, c, view), (i + 1).cast("string")))
    hits = columns.let(F.col("cohorts"), lambda c: columns.seen(tests, g, c, lambda view: at(c, view)))
    return shown_if(found, "hits", F.array_join(hits, ","), "hits != ''")


def context(test: str, definitions: str = "") -> Query:
    """Places from which a test succeeds."""
    g = parse(f"{definitions} SELECT (*) IF {test};")
    tests = g.rules()[0].tests

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def good(i: Column, c: Column, view: columns.View) -> Column:
            found = [columns.test(t, g, i, F.size(c), view).isNotNull() for t in tests]
            out = found[0]
            for x in found[1:]:
                out = out & x
            return out

        return places(windows(spark, sf_dir), good, tests, g)

    return run


def matching(set_expression: str, definitions: str = "") -> Query:
    """Places whose cohort has a reading in a set."""
    g = parse(f"{definitions} SELECT {set_expression};")
    target = g.rules()[0].target
    return lambda spark, sf_dir: places(windows(spark, sf_dir), lambda i, c, _: columns.cohort_matches(target, g, F.get(c, i)))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# --- windows ----------------------------------------------------------------------------------


def tokenize_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "win", "part", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("tokens"))


register("tokenize_plain", tokenize_plain, f"WITH {SQL_WINDOWS} SELECT doc_id, win, part, len(words)::INT AS n_tokens, array_to_string(words, ' ') AS tokens FROM w")


def window_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.groupBy("doc_id").agg(
        F.countDistinct("win").alias("n_windows"), F.sum(F.size("words")).alias("n_tokens"), F.max(F.size("words")).alias("longest")
    )


register("window_delimiters", window_delimiters, f"WITH {SQL_WINDOWS} SELECT doc_id, count(DISTINCT win) AS n_windows, sum(len(words))::BIGINT AS n_tokens, max(len(words))::INT AS longest FROM w GROUP BY doc_id")


def window_hard_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), hard_limit=20)
    return found.select("doc_id", "win", "part", F.size("words").alias("n_tokens"), F.get("words", F.lit(0)).alias("first_token"))


register("window_hard_limit", window_hard_limit, f"WITH {SQL_WINDOWS.replace('500', '20')} SELECT doc_id, win, part, len(words)::INT AS n_tokens, words[1] AS first_token FROM w")

# --- sets -------------------------------------------------------------------------------------

_LISTS = "LIST NOUN = (N SG) (N PL); LIST VERB = V; LIST PLUR = PL; LIST PAST = PST;"
register("list_match", matching("NOUN", _LISTS), hits_sql(f"{has('N SG')} OR {has('N PL')}"))
register("set_union", matching("NOUN OR VERB", _LISTS), hits_sql(f"{has('N')} OR {has('V')}"))
register("set_plus", matching("NOUN + PLUR", _LISTS), hits_sql(has("N PL")))
register("set_minus", matching("VERB - PAST", _LISTS), hits_sql("len(list_filter(rds, lambda r: list_contains(r, 'V') AND NOT list_contains(r, 'PST'))) > 0"))
register("set_failfast", matching("VERB ^ PAST OR NOUN", _LISTS), hits_sql("len(list_filter(rds, lambda r: NOT list_contains(r, 'PST') AND (list_contains(r, 'V') OR list_contains(r, 'N')))) > 0"))
register("set_difference", matching("A \\ B", "LIST A = V N ADJ; LIST B = N DET;"), hits_sql(f"{has('V')} OR {has('ADJ')}"))
register("set_intersection", matching("A ∩ B", "LIST A = V N ADJ; LIST B = N DET;"), hits_sql(has("N")))
register("set_symmetric_difference", matching("A ∆ B", "LIST A = V N ADJ; LIST B = N DET;"), hits_sql(f"{has('V')} OR {has('ADJ')} OR {has('DET')}"))
register("tag_failfast", matching("(^PST V) OR (PRP)"), hits_sql(f"len(list_filter(rds, lambda r: (list_contains(r, 'V') AND NOT list_contains(r, 'PST')) OR list_contains(r, 'PRP'))) > 0"))
register("tag_any", matching("(*)"), hits_sql("true"))
register("tag_wordform", matching('("<the>")'), hits_sql("wf = 'the'"))
register("tag_regex", matching('("<t.*(on|er)>"r)'), hits_sql("regexp_matches(wf, '^t.*(on|er)$')"))
register("tag_regex_unanchored", matching("(/^P[SR]/r)"), hits_sql("len(list_filter(list_concat([[wf]], rds), lambda r: len(list_filter(r, lambda x: regexp_matches(x, '^P[SR]'))) > 0)) > 0"))
register("tag_icase", matching('("<the>"i)'), hits_sql("lower(wf) = 'the'"))
register("line_regex", matching("(/V P/l)"), hits_sql("len(list_filter(rds, lambda r: regexp_matches(wf || ' ' || array_to_string(r, ' '), 'V P'))) > 0"))

# --- quantifiers and tests --------------------------------------------------------------------


def lag(cond: str, n: int = 1) -> str:
    return f"coalesce({'lag' if n > 0 else 'lead'}({cond}, {abs(n)}) OVER ({WINDOW}), false)"


def nearest(cond: str, right: bool, start: int = 1) -> str:
    """Place of the nearest cohort that meets ``cond``."""
    if right:
        return f"min(CASE WHEN {cond} THEN pos END) OVER ({WINDOW} ROWS BETWEEN {start} FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"max(CASE WHEN {cond} THEN pos END) OVER ({WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND {start} PRECEDING)"


register("ctx_normal", context("(0 (N))"), hits_sql(has("N")))
register("ctx_careful", context("(0C (N))"), hits_sql(careful("N")))
register("ctx_not", context("(NOT 0 (N))"), hits_sql(f"NOT {has('N')}"))
register("ctx_not_outside", context("(NOT 1 (N))"), hits_sql("NOT b", f"{lag(has('N'), -1)} AS b"))
register("ctx_negate", context("(NEGATE -1 (DET) LINK 1 (N))"), hits_sql(f"NOT (a AND {has('N')})", f"{lag(has('DET'))} AS a"))
register("ctx_offset", context("(-1 (DET))"), hits_sql("a", f"{lag(has('DET'))} AS a"))
register("ctx_offset_far", context("(2 (V))"), hits_sql("a", f"{lag(has('V'), -2)} AS a"))
register("ctx_absolute", context("(@1 (DET))"), hits_sql("a", f"first_value({has('DET')}) OVER ({WINDOW}) AS a"))
register("ctx_absolute_end", context("(@-1 (N))"), hits_sql("a", f"last_value({has('N')}) OVER ({WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a"))
register("ctx_scan_first", context("(1* (V))"), hits_sql("a IS NOT NULL", f"{nearest(has('V'), True)} AS a"))
register("ctx_scan_left", context("(-2* (DET))"), hits_sql("a IS NOT NULL", f"{nearest(has('DET'), False, 2)} AS a"))
register("ctx_self", context("(1*S (V))"), hits_sql("a IS NOT NULL", f"{nearest(has('V'), True, 0).replace('0 FOLLOWING', 'CURRENT ROW')} AS a"))
_SCAN_LINK = f"""WITH {SQL_TOKENS}, f AS (SELECT *, {has('V')} AS v, {lag(has('N'), -1)} AS n1 FROM tok),
x AS (SELECT *, min(CASE WHEN v THEN pos END) OVER later AS first_v, min(CASE WHEN v AND n1 THEN pos END) OVER later AS first_both
      FROM f WINDOW later AS ({WINDOW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, win, part, string_agg(CASE WHEN COND THEN pos::VARCHAR END, ',' ORDER BY pos) AS hits FROM x GROUP BY ALL HAVING count(CASE WHEN COND THEN 1 END) > 0"""
register("ctx_scan_first_link", context("(1* (V) LINK 1 (N))"), _SCAN_LINK.replace("COND", "first_v = first_both"))
register("ctx_scan_all_link", context("(1** (V) LINK 1 (N))"), _SCAN_LINK.replace("COND", "first_both IS NOT NULL"))
register("ctx_barrier", context("(1* (V) BARRIER (DET))"), hits_sql("a <= coalesce(b, a)", f"{nearest(has('V'), True)} AS a, {nearest(has('DET'), True)} AS b"))
register("ctx_careful_barrier", context("(-1* (DET) CBARRIER (N))"), hits_sql("a >= coalesce(b, a)", f"{nearest(has('DET'), False)} AS a, {nearest(careful('N'), False)} AS b"))
register("ctx_none", context("(NONE 1* (V))"), hits_sql("a IS NULL", f"{nearest(has('V'), True)} AS a"))
register("ctx_none_barrier", context("(NOT 1* (V) BARRIER (DET))"), hits_sql("a IS NULL OR b < a", f"{nearest(has('V'), True)} AS a, {nearest(has('DET'), True)} AS b"))
register("ctx_all", context("(ALL 1* (N) OR (V) OR (ADJ) OR (DET) OR (PRP))"), hits_sql("a IS NULL AND b", f"{nearest(f'NOT ({has(chr(78))} OR {has(chr(86))} OR {has(chr(65) + chr(68) + chr(74))} OR {has(chr(68) + chr(69) + chr(84))} OR {has(chr(80) + chr(82) + chr(80))})', True)} AS a, lead(true) OVER ({WINDOW}) IS NOT NULL AS b"))
register("ctx_link", context("(-1 (DET) LINK -1 (PRP))"), hits_sql("a AND b", f"{lag(has('DET'))} AS a, {lag(has('PRP'), 2)} AS b"))
register("ctx_template", context("(T:np)", "TEMPLATE np = (-1 (DET));"), hits_sql("a", f"{lag(has('DET'))} AS a"))
register("ctx_or", context("((-1 (DET)) OR (1 (V)))"), hits_sql("a OR b", f"{lag(has('DET'))} AS a, {lag(has('V'), -1)} AS b"))
register("ctx_shorthand", context("([(DET), (ADJ), (N)])"), hits_sql(f"{has('DET')} AND a AND b", f"{lag(has('ADJ'), -1)} AS a, {lag(has('N'), -2)} AS b"))
register("bag_of_tags", context("(B (DET) + (PST))"), hits_sql("a AND b", f"bool_or({has('DET')}) OVER (PARTITION BY doc_id, win, part) AS a, bool_or({has('PST')}) OVER (PARTITION BY doc_id, win, part) AS b"))

# --- rules ------------------------------------------------------------------------------------


def kept(cond: str, allowed: str = "true", drop: bool = False) -> str:
    """SQL: the readings that (don't) meet ``cond``, where some but not all do."""
    want = f"list_filter(rds, lambda r: {'NOT ' if drop else ''}({cond}))"
    n = f"len(list_filter(rds, lambda r: {cond}))"
    return f"CASE WHEN {allowed} AND {n} > 0 AND {n} < len(rds) THEN {want} ELSE rds END"


_N, _V = "list_contains(r, 'N')", "list_contains(r, 'V')"
register("select_rule", rules("SELECT (N) IF (-1 (DET));"), edited_sql(kept(_N, "a"), f"{lag(has('DET'))} AS a"))
register("remove_rule", rules("REMOVE (V) IF (-1 (DET));"), edited_sql(kept(_V, "a", True), f"{lag('wf IN (' + _DETS + ')')} AS a").replace("REMOVE", ""))
register("iff_rule", rules("IFF (N) IF (0 (DET) OR (PRP));"), edited_sql(f"CASE WHEN {has('DET')} OR {has('PRP')} THEN {kept(_N)} ELSE {kept(_N, drop=True)} END"))
register("wordform_rule", rules('"<der>" REMOVE (V);'), edited_sql(kept(_V, "wf = 'der'", True)))
register("add_rule", rules("ADD (x) (N) IF (-1 (DET));"), edited_sql(f"CASE WHEN a THEN list_transform(rds, lambda r: CASE WHEN {_N} THEN list_append(r, 'x') ELSE r END) ELSE rds END", f"{lag(has('DET'))} AS a"))
register("map_rule", rules("MAP (@A @B) (N PL);"), edited_sql("flatten(list_transform(rds, lambda r: CASE WHEN list_contains(r, 'N') AND list_contains(r, 'PL') THEN [list_append(r, '@A'), list_append(r, '@B')] ELSE [r] END))"))
register("replace_rule", rules("REPLACE (NOM) (N SG);"), edited_sql("list_transform(rds, lambda r: CASE WHEN list_contains(r, 'N') AND list_contains(r, 'SG') THEN ['NOM'] ELSE r END)"))
register("substitute_rule", rules("SUBSTITUTE (V) (VERB FIN) (PST);"), edited_sql("list_transform(rds, lambda r: CASE WHEN list_contains(r, 'PST') THEN flatten(list_transform(r, lambda x: CASE WHEN x = 'V' THEN ['VERB', 'FIN'] ELSE [x] END)) ELSE r END)"))
register("append_rule", rules("APPEND (PROP N) (X);"), edited_sql(f"CASE WHEN {has('X')} THEN list_append(rds, ['PROP', 'N']) ELSE rds END"))
register("copy_rule", rules("COPY (ADJ) EXCEPT (PST) (V PST);"), edited_sql("flatten(list_transform(rds, lambda r: CASE WHEN list_contains(r, 'PST') THEN [r, list_append(list_filter(r, lambda x: x <> 'PST'), 'ADJ')] ELSE [r] END))"))
register("rule_sequence", rules("SELECT (N) IF (-1 (DET)); REMOVE (PRP) IF (0 (DET));"), edited_sql(kept("list_contains(r, 'PRP')", has("DET"), True).replace("rds", "r2"), f"{lag(has('DET'))} AS a").replace("y AS (", f"z AS (SELECT * EXCLUDE (rds), {kept(_N, 'a')} AS r2 FROM x), y AS (").replace("AS rds FROM x)\nSELECT", "AS rds FROM z)\nSELECT"))


def section_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noun reading wins where the next cohort is a sure noun; certainty moves left, a place per pass."""
    return show(columns.to_fixpoint(windows(spark, sf_dir), "SECTION SELECT (N) IF (1C (N));"))


register("section_fixpoint", section_fixpoint, edited_sql(kept(_N, "a IS NOT NULL AND (b IS NULL OR a < b)"), f"{nearest(careful('N'), True)} AS a, {nearest('NOT ' + has('N'), True)} AS b"))
