"""Plans: round trips, relabelling, Columns against the kernel, profiles, streams."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import profile
from lexiloom.operators.apply import apply_grammar, couples_windows
from lexiloom.plans import columns, relabel, writer
from lexiloom.plans.grammar import parse
from lexiloom.plans.kernel import Applicator, Options
from lexiloom.sources import cg_text, documents, streams

GRAMMAR = """
DELIMITERS = "<.>" ;
LIST NOUN = N (PROP SG) ;
SET X = NOUN - (PL) OR (V) + (PRS) ;
TEMPLATE np = (-1 (DET)) ;
BEFORE-SECTIONS
MAP (@A) NOUN IF (T:np) ;
SECTION
SELECT:s1 X IF (-1*C (DET) BARRIER (V) LINK NOT 1 (X)) (NEGATE 1 (V)) ;
"<a>" REMOVE UNSAFE ("b"i) IF ((1 (N)) OR (-1 (V))) ;
SUBSTITUTE (A) (B C) (D) ;
SETPARENT (N) TO (1** (V)) ;
WITH (N) IF (1 (V)) { ADD (t) (*) IF (0 (_C1_)) ; } ;
MOVE (N) AFTER (1* (V)) ;
"""


def test_grammar_round_trip():
    once = writer.grammar(parse(GRAMMAR))
    assert writer.grammar(parse(once)) == once
    stream = '"<a>"\n\t"a" DET\n"<b>"\n\t"b" N\n\t"b" V PRS\n"<c>"\n\t"c" V\n\t"c" D A\n'
    runs = [cg_text.format_windows(Applicator(g).run(cg_text.parse(stream, g))) for g in (parse(GRAMMAR), parse(once))]
    assert runs[0] == runs[1]


def test_relabel():
    g = relabel.relabel(parse("LIST A = x (x y) z ; SELECT A ;"), "MAP (n m) (x) ;")
    assert {tuple(sorted(t.text for t in m)) for m in g.sets["A"].members} == {("z",), ("m", "n"), ("m", "n", "y")}
    s = relabel.relabel(parse("SELECT (x y) OR (z) ;"), "LIST Q = a b ; SET R = Q - (c) ; MAP R (x) ;")
    assert "R + (y)" in writer.tag_set(s.rules()[0].target)


RULES = [
    "SELECT (A) IF (-1 (B));", "SELECT (A) IF (NOT -1 (B));", "REMOVE (A) IF (1C (B));", "REMOVE (B) IF (-1* (A) BARRIER (C));",
    "REMOVE (C) IF (1** (A) LINK 1 (B));", "IFF (A) IF (1* (B) LINK NOT 1 (C));", "SELECT (B) IF (NEGATE 1 (A) LINK 1 (B));",
    "REMOVE (B) IF (NOT 1* (C));", "REMOVE (A) IF (@1 (B)) (-1*S (C));", "ADD (t) (A) IF (-1 (t) OR (B));", "SELECT (A) OR (B) - (C) IF (1 (*));",
    "SELECT (C) IF ((1 (A)) OR (-1 (B)));", "REMOVE (A) IF (NONE -1* (B) BARRIER (C));", "REMOVE (A) IF (1* (C) CBARRIER (B));",
]


@pytest.mark.parametrize("rule", RULES)
def test_columns_equal_the_kernel(spark, rule):
    """Random small windows; one pass of one rule, which both run in the same order."""
    draw = random.Random(rule)
    rows = [(k, 1, 0, [(f"w{i}", [[x] for x in sorted(draw.sample("ABC", draw.randint(1, 3)))]) for i in range(draw.randint(1, 7))]) for k in range(60)]
    found = spark.createDataFrame(rows, "doc_id long, win int, part int, cohorts array<struct<wf:string,rds:array<array<string>>>>")
    fast = {r.doc_id: [[list(x) for x in c.rds] for c in r.cohorts] for r in columns.apply_columns(found, rule).collect()}
    slow_rows = apply_grammar(documents.full_windows(found), rule, Options(max_runs=1)).collect()
    slow = {r.doc_id: [[x.tags[1:] for x in c.readings] for c in r.cohorts] for r in slow_rows}
    assert fast == slow


def test_fixpoint_of_a_long_run(spark):
    """A sure noun at the end of the longest window settles all before it; what never settles raises."""
    rows = [(k, 1, 0, [("w", [["N"], ["V"]])] * (n - 1) + [("w", [["N"]])]) for k, n in enumerate((1, 2, 130, documents.HARD_LIMIT))]
    found = spark.createDataFrame(rows, "doc_id long, win int, part int, cohorts array<struct<wf:string,rds:array<array<string>>>>")
    done = columns.to_fixpoint(found, "SECTION SELECT (N) IF (1C (N));").collect()
    assert {r.doc_id: [[list(x) for x in c.rds] for c in r.cohorts] for r in done} == {k: [[["N"]]] * len(c) for k, _, _, c in rows}
    with pytest.raises(RuntimeError):
        columns.to_fixpoint(found, "SECTION SELECT (N) IF (1C (N));", max_runs=100)


def test_coupling_decides_the_plan():
    plain = ["SELECT (N) IF (-1 (DET));", "ADD (x) (N);"]
    coupled = ["SELECT (N) IF (-1*W (DET));", "SETVARIABLE (a) (b) (N);", "SELECT (N) IF (0 (VAR:x));", "DELIMIT (N);", "SELECT (N) IF (r:a (N));"]
    assert not any(couples_windows(parse(g), Options()) for g in plain)
    assert all(couples_windows(parse(g), Options()) for g in coupled)


def test_no_shuffle_for_columns(spark, sf_dir):
    from lexiloom.operators import catalog

    plan = catalog.QUERIES["select_rule"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_profile(spark):
    texts = spark.createDataFrame([(k, '"<a>"\n\t"a" N\n\t"a" V\n') for k in range(6)], "doc_id long, text string")
    rows = streams.read_texts(texts, "cg")
    found = profile.profile(rows, "REMOVE (X);\nSELECT (N);")
    twice = {r.rule: r for r in profile.coverage(profile.merge(found, found)).collect()}
    assert (twice[2].num_match, twice[1].num_match, twice[1].used) == (12, 0, False) and twice[1].num_fail > 0


def test_external():
    def command(name, window):
        assert name == "tagger"
        window.cohorts[1].readings[0].tags.append("seen")
        return True

    g = parse('EXTERNAL ONCE "tagger" (N);')
    out = Applicator(g, external=command).run(cg_text.parse('"<a>"\n\t"a" N\n', g))
    assert "seen" in out[0].cohorts[1].readings[0].tags


def test_streaming(spark, tmp_path):
    from lexiloom.streaming import windows as streaming

    texts = spark.createDataFrame([(1, '<STREAMCMD:SETVAR:m=x>\n"<a>"\n\t"a" N\n"<.>"\n"<b>"\n\t"b" N\n')], "doc_id long, text string")
    batch = streams.read_texts(texts, "cg", 'DELIMITERS = "<.>"; SELECT (q);')
    for n in (1, 2):
        batch.filter(F.col("win") == n).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    source = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.apply_with_variables(source, "ADD (hit) (N) IF (0 (VAR:m=x));").writeStream.format("memory").queryName("cg_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = spark.table("cg_out").collect()
    assert sorted(c.wordform for r in found for c in r.cohorts if "hit" in c.readings[0].tags) == ['"<a>"', '"<b>"']
