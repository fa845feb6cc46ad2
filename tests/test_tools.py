"""Options, arguments, enclosures, marks, XML trees, syntax trees and reports."""

from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import profile
from lexiloom.plans.grammar import GrammarError, parse
from lexiloom.plans.kernel import Applicator, Options
from lexiloom.plans.tree import syntax_tree
from lexiloom.plans.writer import grammar as grammar_text
from lexiloom.sources import codecs
from lexiloom.sources.streams import read_texts
from tests.test_kernel import DUCK, run, tags

NESTED = "".join(f'"<{w}>"\n\t"{w}" word\n' for w in ("a", "(", "b", "(", "c", ")", ")", "d"))


@pytest.mark.parametrize(
    "rule, hit",
    [
        ("ADD ENCL_INNER (@i) (word);", "(b(c))"),  # each span when it comes back, brackets included
        ("ADD ENCL_OUTER (@o) (word);", "a(b)d"),  # while the inner span is back, the outer one lies outside of it
        ("ADD ENCL_FINAL (@f) (word);", "a(b(c))d"),
        ("ADD ENCL_ANY (@f) (word);", "a(b(c))d"),
    ],
)
def test_enclosure_flags(rule, hit):
    found = tags(run('PARENTHESES = ("<(>" "<)>") ;\n' + rule, NESTED))
    marked = [r[0].split('"')[1] for r in found if "@" in r[0]]
    assert marked == list(hit)


def test_flags_without_enclosures():
    plain = '"<a>"\n\t"a" word\n'
    g = 'PARENTHESES = ("<(>" "<)>") ;\n'
    assert "@f" in run(g + "ADD ENCL_FINAL (@f) (word);", plain)  # nothing was cut out: the flag waits for nothing
    assert "@o" in run(g + "ADD ENCL_OUTER (@o) (word);", plain)
    assert "@i" not in run(g + "ADD ENCL_INNER (@i) (word);", plain)


def test_marks_between_tests():
    """A mark lasts for one test unless the rule remembers it."""
    rule = "SELECT {} (N) IF (1X (PRS)) (0 (*) LINK jM (PRS));"
    assert [len(r) for r in tags(run(rule.format(""), DUCK))] == [1, 2, 2, 1]
    assert [len(r) for r in tags(run(rule.format("REMEMBERX"), DUCK))] == [1, 1, 2, 1]
    assert [len(r) for r in tags(run(rule.format("REMEMBERX RESETX"), DUCK))] == [1, 2, 2, 1]


def test_strict_tags():
    base = "STRICT-TAGS += N V ;\n"
    assert parse(base + 'LIST A = N V "x" "<y>" <z> /q/r ;').sets["A"]
    assert parse(base + "SELECT N ;").rules()[0].target.tags()[0].text == "N"  # a declared tag may stand as a set
    with pytest.raises(GrammarError, match="line 2.*STRICT-TAGS"):
        parse(base + "LIST A = Q ;")
    for option, tag in [("strict-wordforms", '"<y>"'), ("strict-baseforms", '"x"'), ("strict-secondary", "<z>"), ("strict-regex", "/q/r"), ("strict-icase", '"x"i')]:
        with pytest.raises(GrammarError):
            parse(f"OPTIONS += {option} ;\n{base}LIST A = {tag} ;")
    with pytest.raises(GrammarError, match="unknown option"):
        parse("OPTIONS += strict ;")


def test_list_tags_and_undefined_sets():
    assert parse("LIST-TAGS += N ;\nSELECT N ;").rules()
    for text in ("SELECT N ;", "SELECT $$N ;", "SELECT (N) IF (1 M) ;"):
        with pytest.raises(GrammarError, match="defined set"):
            parse(text)
    twice = "LIST A = DET ;\nSECTION\nADD (one) A ;\nUNDEF-SETS = A ;\nLIST A = PUNCT ;\nADD (two) A ;"
    found = tags(run(twice, DUCK))
    assert found[0] == ['"the" DET one'] and found[3] == ['"." PUNCT two']


def test_own_arguments():
    g = parse("CMDARGS += --num-windows 4 --sections 1 ;\nCMDARGS-OVERRIDE += --trace ;\nSECTION\nREMOVE (SG);\nSECTION\nREMOVE (PL);")
    assert (Applicator(g).o.num_windows, Applicator(g).o.trace) == (4, True)
    assert Applicator(g, Options(num_windows=3, trace=False)).o.num_windows == 3
    assert parse(grammar_text(g)).cmdargs == g.cmdargs
    with pytest.raises(ValueError, match="unknown argument"):
        Applicator(parse("CMDARGS += --nothing ;"))
    sizes = lambda o: [len(r) for r in tags(run("SECTION\nREMOVE (SG);\nSECTION\nREMOVE (PL);", DUCK, options=o))]
    assert sizes(Options(sections=1)) == [1, 1, 2, 1] and sizes(Options(sections="2-2")) == [1, 2, 1, 1] and sizes(Options()) == [1, 1, 1, 1]
    assert sizes(Options(sections="1,2")) == [1, 1, 1, 1]


def test_corrections_off():
    g = "SUBSTITUTE (SG) (X) (SG);\nADD (@m) (SG);"
    assert "X" not in run(g, DUCK, options=Options(no_corrections=True)) and "@m" not in run(g, DUCK, options=Options(no_mappings=True))


def test_safe_setparent():
    g = "OPTIONS += safe-setparent ;\nSETPARENT (N) TO (-1 (DET)) ;"
    assert "SAFE" in parse(g).rules()[0].flags and "SAFE" not in parse(g.split("\n")[1]).rules()[0].flags


def test_xml_trees():
    windows = codecs.read_matxin("^duck/duck<n><sg>/duck<vb>$ [^x$] ^R&D/r<n>+d<n># x$^*odd/*odd$")
    assert [c.wordform for c in windows[0].all[1:]] == ['"<duck>"', '"<R&D>"', '"<*odd>"']
    assert [r.tags[:3] for r in windows[0].all[1].readings] == [['"duck"', "n", "sg"], ['"duck"', "vb"]]
    assert windows[0].all[2].readings[0].tags[:4] == ['"r# x"', "n", '"d"', "n"] and windows[0].all[3].readings[0].tags[:2] == ['"*odd"']
    g = parse("SETPARENT (*) TO (@1 (*)); SETPARENT (sg) TO (2 (*));")  # the first two hang on each other's heads in a loop or not
    done = Applicator(g).run(windows)
    root = ET.fromstring(codecs.write_matxin(done))
    assert sorted(n.get("form") for n in root.iter("NODE")) == ["*odd", "R&D", "duck"]
    assert root.find("SENTENCE").get("alloc") == "0" and {n.get("si") for n in root.iter("NODE")} == {""}


def test_syntax_tree():
    g = 'LIST N = N "x"i ;\nSET M = N - (A B) ;\nTEMPLATE t = (1 N) ;\nSECTION\n"<w>"r SELECT:name UNSAFE N IF (NOT -1* M BARRIER N LINK 1 (*)) (T:t) ;'
    root = ET.fromstring(syntax_tree(parse(g)).split("\n", 1)[1])
    rule = root.find("Section/Rule")
    assert (rule.get("type"), rule.get("name"), rule.get("l")) == ("SELECT", "name", "5")
    assert rule.find("Flag").get("t") == "UNSAFE" and len(rule.findall("Context")) == 2
    assert rule.find("Context/Link/Context/Position").get("t") == "1" and root.find("Template/Context/Position").get("t") == "1"
    assert [t.get("t") for t in root.find("SetDefinition").iter("Tag")] == ["A", "B"]


def test_profile_of_tests(spark):
    g = "SECTION\nSELECT (N) IF (-1 (DET)) (NEGATE 1 (X));\nREMOVE (Q);"
    windows = read_texts(spark.createDataFrame([(1, DUCK), (2, DUCK), (3, None)], "doc_id long, text string"), "cg")
    once = profile.profile(windows, g)
    rows = {(r.rule, r.context): (r.num_match, r.num_fail, r.example_doc, r.example_win) for r in once.collect()}
    # two passes over each document: the first noun is chosen in the first pass, the second one fails in both
    assert rows[1, 1] == (2, 4, 1, 1) and rows[1, 2][:2] == (0, 2) and rows[1, 2][2] is None
    assert rows[2, None][0] == 0
    twice = {(r.rule, r.context): r.num_match for r in profile.merge(once, once).collect()}
    assert twice[1, 1] == 2 * rows[1, 1][0]
    html = profile.report(once, g)
    assert "test 1: 2 of 6" in html and "class='unused'" in html and html.count("<tr") == 3


def test_ids_go_on_over_batches(spark, tmp_path):
    from lexiloom.streaming import windows as streaming

    for n in (1, 2):
        rows = read_texts(spark.createDataFrame([(7, DUCK)], "doc_id long, text string"), "cg").withColumn("win", F.lit(n))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    g = "SETPARENT (N) TO (-1 (DET)); ADDRELATION (k) (N) TO (-1 (DET));"
    q = streaming.apply_with_variables(source, g).writeStream.format("memory").queryName("ids_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = sorted((r.win, [c.gid for c in r.cohorts], [c.dep_parent for c in r.cohorts if c.dep_parent], [c.relations for c in r.cohorts if c.relations]) for r in spark.table("ids_out").collect())
    firsts = [gids[0] for _, gids, _, _ in found]
    assert len({g for _, gids, _, _ in found for g in gids}) == 8
    assert [parents for _, _, parents, _ in found] == [[firsts[0]], [firsts[1]]]
    assert [relations[0] for _, _, _, relations in found] == [{"k": [firsts[0]]}, {"k": [firsts[1]]}]
