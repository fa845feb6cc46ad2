"""Scans and trees over long windows: what is read per place does not grow with the window; the one sequence left cuts windows at the limit."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import catalog, relational
from lexiloom.operators.apply import apply_grammar
from lexiloom.plans import columns
from lexiloom.plans.kernel import Options
from lexiloom.sources import documents

SCANS = [
    "1* (B)", "-1* (B) BARRIER (C)", "1** (B) LINK 1 (C)", "-2** (B) LINK -1 (C) BARRIER (C)", "1*S (B)", "-1*S (C) BARRIER (B)", "NOT 1* (B) BARRIER (C)",
    "NOT -2* (C)", "1*C (B) CBARRIER (C)", "2* (B) LINK -1* (C) LINK 1** (B) LINK 1 (C)", "NEGATE -1* (B) LINK 1* (C)", "NONE -1* (B) BARRIER (C)",
]


@pytest.mark.parametrize("scan", SCANS)
def test_scans_equal_the_kernel(spark, scan):
    draw = random.Random(scan)
    rows = [(k, 1, 0, [(f"w{i}", [[x] for x in sorted(draw.sample("ABC", draw.randint(1, 3)))]) for i in range(draw.randint(1, 12))]) for k in range(60)]
    found = spark.createDataFrame(rows, "doc_id long, win int, part int, cohorts array<struct<wf:string,rds:array<array<string>>>>")
    rule = f"ADD (t) (A) IF ({scan});"
    fast = {r.doc_id: [[list(x) for x in c.rds] for c in r.cohorts] for r in columns.apply_columns(found, rule).collect()}
    slow = {r.doc_id: [[x.tags[1:] for x in c.readings] for c in r.cohorts] for r in apply_grammar(documents.full_windows(found), rule, Options(max_runs=1)).collect()}
    assert fast == slow and any("t" in x for w in fast.values() for c in w for x in c)


@pytest.mark.parametrize("name", ["ctx_self", "ctx_scan_all_link", "ctx_scan_first_link", "ctx_barrier", "ctx_none_barrier", "ctx_careful_barrier"])
def test_no_place_lists_the_others(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1 and "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["dep_ancestors", "dep_descendants"])
def test_no_node_lists_its_path(spark, sf_dir, name):
    plan = relational.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1


def test_readings_of_every_ending(spark):
    ends = [*documents.VERB_ENDS, *documents.NOUN_ENDS, *documents.PLURAL_ENDS, *documents.ADJECTIVE_ENDS, "x", "on", "ng", "é"]
    words = sorted({b + e + m for b in ("", "a", "ab", "abcd", "ñu") for e in [*ends, *documents.DETERMINERS] for m in ("", ".", ",", "..", ",.", "!")} - {""})

    def plain(w: str) -> list[list[str]]:
        stem = w[:-1] if w[-1] in ".," else w
        det = w in documents.DETERMINERS
        return documents.tags_of(stem, [["DET"]] if det else [], [["PRP"]] if len(w) <= 3 and not det else []) or [["X"]]

    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", documents.readings(F.col("w")).alias("r")).collect()
    assert {r.w: [list(x) for x in r.r] for r in found} == {w: plain(w) for w in words}


def test_what_only_takes_readings_begins_where_tests_hold():
    """Rules whose failing tests can come true while they run are folded over all places that they can change."""
    from lexiloom.plans.grammar import parse

    def only(text: str) -> bool:
        g = parse(text)
        return columns.only_takes(g.rules()[0], g)

    assert all(map(only, ["SELECT (N) IF (-1 (DET));", "REMOVE (N) IF (-1** (DET) LINK 1 (V));", "SELECT (N) IF (1* (V));", "REMOVE (N) - (PL) IF ((1 (V)) OR (-1 (DET)));"]))
    later = ["NOT -1 (DET)", "-1C (DET)", "1* (V) BARRIER (DET)", "1* (V) LINK 1 (N)", "NEGATE 1 (V)", "1 (V) LINK NOT 1 (N)", "B (V) - (PST)", "-1* (V) CBARRIER (N)"]
    assert not any(only(f"SELECT (N) IF ({x});") for x in later) and not only("IFF (N) IF (-1 (DET));") and not only("ADD (x) (N) IF (-1 (x));")
