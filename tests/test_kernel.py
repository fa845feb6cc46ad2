"""Small grammars on small streams of our own."""

import pytest

from lexiloom.plans.grammar import GrammarError, parse
from lexiloom.plans.kernel import Applicator, Options
from lexiloom.sources import cg_text


def run(grammar, stream, trace=False, options=None, **limits):
    g = parse(grammar)
    windows = Applicator(g, options).run(cg_text.parse(stream, g, **limits))
    return cg_text.format_windows(windows, g, trace)


def tags(out):
    """Readings by cohort, without word forms."""
    found = []
    for line in out.split("\n"):
        if line.startswith('"<'):
            found.append([])
        elif line.startswith("\t"):
            found[-1].append(line.strip())
    return found


DUCK = '''"<the>"
	"the" DET
"<duck>"
	"duck" N SG
	"duck" V INF
"<dives>"
	"dive" V PRS
	"dive" N PL
"<.>"
	"." PUNCT
'''


@pytest.mark.parametrize(
    "rule, want",
    [
        ("SELECT (N) IF (-1 (DET));", [1, 1, 2, 1]),
        ("REMOVE (N) IF (-1 (DET));", [1, 1, 2, 1]),
        ("REMOVE (V);", [1, 1, 1, 1]),
        ("REMOVE (DET);", [1, 2, 2, 1]),
        ("SELECT (X);", [1, 2, 2, 1]),
        ("IFF (N) IF (-1 (DET));", [1, 1, 1, 1]),
        ("SELECT (V) IF (NOT -1 (DET));", [1, 2, 1, 1]),
        ("SELECT (V) IF (-1C (N));", [1, 2, 2, 1]),
        ('"<duck>" REMOVE (V);', [1, 1, 2, 1]),
        ("SELECT (V) IF (-1* (DET) BARRIER (N));", [1, 1, 1, 1]),  # the first cohort lost its N before the second is tested
        ("SELECT (V) IF (-1* (DET) BARRIER (INF));", [1, 1, 2, 1]),
        ("SELECT (N) IF (-1* (DET) CBARRIER (SG));", [1, 1, 2, 1]),
        ("SELECT (V) IF (1* (PUNCT) LINK -1 (PRS));", [1, 1, 1, 1]),
        ("SELECT (V) IF (-1** (DET) LINK NOT 1 (X));", [1, 1, 1, 1]),
        ("SELECT (V) IF (0* (PUNCT)) (NEGATE -1 (DET) LINK 1 (N));", [1, 2, 1, 1]),
        ("SELECT (V) IF (@1 (DET));", [1, 1, 1, 1]),
        ("SELECT (V) IF (B (PRS) + (INF));", [1, 1, 1, 1]),
        ("SELECT (V) IF (1 (<<<));", [1, 2, 1, 1]),
        ("SELECT (V) IF ((1 (PUNCT)) OR (-1 (DET)));", [1, 1, 1, 1]),
        ("SELECT (V) IF (NONE 1* (PUNCT));", [1, 2, 2, 1]),
        ("SELECT (V) IF (ALL 1* (*));", [1, 1, 1, 1]),
        ("LIST X = (N SG) V; SELECT X - (INF) IF (-1 (DET));", [1, 1, 2, 1]),
        ("SET X = (V) + (PRS) OR (SG); SELECT X;", [1, 1, 1, 1]),
        ("SELECT (/^PR/r);", [1, 2, 1, 1]),
        ('SELECT ("DIVE"i) + (N);', [1, 2, 1, 1]),
        ("SET A = (N) \\ (N); SELECT A;", [1, 2, 2, 1]),
        ("TEMPLATE t = (-1 (DET)); SELECT (V) IF (T:t);", [1, 1, 2, 1]),
        ("SELECT [(V), (PUNCT)];", None),
    ],
)
def test_readings_left(rule, want):
    if want is None:
        with pytest.raises(GrammarError):
            run(rule, DUCK)
        return
    assert [len(x) for x in tags(run('DELIMITERS = "<.>";\n' + rule, DUCK))] == want


def test_rules_see_earlier_effects():
    stream = '"<a>"\n\t"a" DET\n"<b>"\n\t"b" N\n\t"b" V\n"<c>"\n\t"c" N\n\t"c" V\n'
    assert [len(x) for x in tags(run("SELECT (N) IF (NOT -1 (V));", stream))] == [1, 1, 1]


def test_section_runs_until_nothing_changes():
    stream = "".join(f'"<{w}>"\n\t"{w}" A\n\t"{w}" B\n' for w in "wxyz") + '"<e>"\n\t"e" B\n'
    assert tags(run("SECTION REMOVE (A) IF (1C (B));", stream)) == [[f'"{w}" B'] for w in "wxyze"]


@pytest.mark.parametrize(
    "rule, want",
    [
        ("ADD (@S) (N);", [['"d" N SG @S'], ['"r" V']]),
        ("MAP (@S @O) (N); ADD (@X) (N);", [['"d" N SG @S', '"d" N SG @O'], ['"r" V']]),
        ("ADD (x y) BEFORE (SG) (N);", [['"d" N x y SG'], ['"r" V']]),
        ("REPLACE (M) (N);", [['"d" M'], ['"r" V']]),
        ("SUBSTITUTE (N SG) (P) (N);", [['"d" P'], ['"r" V']]),
        ("SUBSTITUTE (*) (t) (V);", [['"d" N SG'], ['"r" V t']]),
        ("SUBSTITUTE (N) (*) (N);", [['"d" SG'], ['"r" V']]),
        ('APPEND ("d" V) (N);', [['"d" N SG', '"d" V'], ['"r" V']]),
        ("COPY (PL) BEFORE (SG) (N) - (PL);", [['"d" N SG', '"d" N PL SG'], ['"r" V']]),
        ("COPY (PL) EXCEPT (SG) (N);", [['"d" N SG', '"d" N PL'], ['"r" V']]),
        ("PROTECT (N); REPLACE (M) (N);", [['"d" N SG'], ['"r" V']]),
        ("MAP (@S) (N); UNMAP (N);", [['"d" N SG'], ['"r" V']]),
        ('SUBSTITUTE ("d"r) ("e") (N);', [['"e" N SG'], ['"r" V']]),
        ('ADD (VSTR:<$1-%u$1>) ("(.)"r) + (N);', [['"d" N SG <d-D>'], ['"r" V']]),
    ],
)
def test_tag_edits(rule, want):
    assert tags(run(rule, '"<d>"\n\t"d" N SG\n"<r>"\n\t"r" V\n')) == want


def test_dependencies():
    stream = '"<a>"\n\t"a" X #1->2\n"<b>"\n\t"b" Y #2->0\n"<c>"\n\t"c" Z #3->2\n'
    hit = lambda test: [x[0].endswith("!") for x in (t or [""] for t in [[r.split(" #")[0] for r in c] for c in tags(run(f"ADD (!) (*) IF {test};", stream))])]
    assert hit("(p (Y))") == [True, False, True]
    assert hit("(c (Z))") == [False, True, False]
    assert hit("(s (Z))") == [True, False, False]
    assert hit("(cr (Z))") == [False, True, False]
    assert hit("(NONE c (Q))") == [True, True, True]
    out = run("SETPARENT (Z) TO (-1* (X)); SETPARENT (X) TO (1* (Z));", stream)
    assert "#3->1" in out and "#1->2" in out  # the second would close a loop
    assert "#1->3" in run("SETCHILD (Z) TO (-2 (X));", stream)
    assert "->" not in tags(run("REMPARENT (X);", stream))[0][0]


def test_relations():
    out = run("ADDRELATION (r) (X) TO (1* (Z)); ADD (!) (*) IF (r:r (Z));", '"<a>"\n\t"a" X\n"<b>"\n\t"b" Y\n"<c>"\n\t"c" Z\n')
    assert tags(out)[0] == ['"a" X ! ID:1 R:r:3']


STREAM = '"<a>"\n\t"a" X\n"<b>"\n\t"b" Y\n"<c>"\n\t"c" Z\n'


@pytest.mark.parametrize(
    "rule, want",
    [
        ("REMCOHORT (Y);", ["a", "c"]),
        ('ADDCOHORT ("<n>" "n" N) BEFORE (Y);', ["a", "n", "b", "c"]),
        ('ADDCOHORT ("<n>" "n" N) AFTER (Y);', ["a", "b", "n", "c"]),
        ("MOVE (X) AFTER (1* (Z));", ["b", "c", "a"]),
        ("MOVE (Z) BEFORE (-1* (X));", ["c", "a", "b"]),
        ("SWITCH (X) WITH (2 (Z));", ["c", "b", "a"]),
        ('SPLITCOHORT ("<p>" "p" P "<q>" "q" Q) (Y);', ["a", "p", "q", "c"]),
        ('MERGECOHORTS ("<ab>" "ab" M) (X) WITH (1 (Y));', ["ab", "c"]),
        ("COPYCOHORT (new) (X) TO AFTER (1* (Z));", ["a", "b", "c", "a"]),
        ("CopyCohort (new) Before (X) - (new) From (1* (Z));", ["c", "a", "b", "c"]),
        ("Move (Z) Before (-1* (X)) ;", ["c", "a", "b"]),
    ],
)
def test_restructuring(rule, want):
    assert [x[2:-2] for x in run(rule, STREAM).split("\n") if x.startswith('"<')] == want


def test_delimit_and_windows():
    out = run("DELIMIT (Y);", STREAM)
    assert out.count("\n\n") == 1 and out.index('"<c>"') > out.index("\n\n")
    g = parse('DELIMITERS = "<.>"; SOFT-DELIMITERS = "<,>"; SELECT (x);')
    words = lambda s: "".join(f'"<{w}>"\n\t"{w}" w\n' for w in s)
    sizes = lambda s, **k: [len(w.cohorts) - 1 for w in cg_text.parse(words(s), g, **k)]
    assert sizes("ab.c.") == [3, 2]
    assert sizes("ab,cdef.", soft_limit=4, hard_limit=6) == [3, 5]
    assert sizes("abcdefgh", soft_limit=4, hard_limit=6) == [6, 2]


def test_variables_and_commands():
    stream = '<STREAMCMD:SETVAR:mode=x>\n"<a>"\n\t"a" A\n<STREAMCMD:FLUSH>\n"<b>"\n\t"b" A\n<STREAMCMD:IGNORE>\n"<i>"\n\t"i" A\n<STREAMCMD:RESUME>\n"<c>"\n\t"c" A\n<STREAMCMD:EXIT>\n"<d>"\n'
    out = run("ADD (hit) (A) IF (0 (VAR:mode=x));", stream)
    assert tags(out) == [['"a" A hit'], ['"b" A'], ['"i" A'], ['"c" A']]
    assert tags(run("SETVARIABLE (k) (v) (X); ADD (hit) (Z) IF (0 (VAR:k=v)); REMVARIABLE (k) (Z); ADD (no) (Z) IF (0 (VAR:k));", STREAM))[2] == ['"c" Z hit']


def test_numeric_tags():
    stream = '"<a>"\n\t"a" <W=50>\n\t"a" <W=40>\n\t"a" <W=10>\n'
    assert len(tags(run("SELECT (<W>=40>);", stream))[0]) == 2
    assert tags(run("SELECT (<W=MAX>);", stream)) == [['"a" <W=50>']]
    assert len(tags(run("REMOVE (<W<MAX-15>);", stream))[0]) == 2


def test_unification():
    stream = '"<a>"\n\t"a" N SG\n\t"a" N PL\n"<b>"\n\t"b" V PL\n'
    assert tags(run("LIST NUM = SG PL; SELECT $$NUM + (N) IF (1 $$NUM + (V));", stream))[0] == ['"a" N PL']
    assert tags(run("LIST S = SG; LIST P = PL; SET BOTH = S OR P; SELECT &&BOTH + (N) IF (1 &&BOTH + (V));", stream))[0] == ['"a" N PL']


def test_subreadings_and_trace():
    stream = '"<ab>"\n\t"a" X\n\t\t"b" Y\n\t"c" Z\n'
    assert tags(run("SELECT SUB:1 (Y);", stream)) == [['"a" X', '"b" Y']]
    assert ";\t\"c\" Z SELECT:1:pick" in run("SELECT:pick (X);", stream, trace=True)


def test_with_jump_and_delayed():
    assert tags(run("WITH (X) IF (1 (Y)) { ADD (t) (*) IF (0 (_TARGET_)); ADD (w) (*) IF (0 (_C1_)); } ;", STREAM)) == [['"a" X t'], ['"b" Y w'], ['"c" Z']]
    assert tags(run("SECTION JUMP (end) (X); ADD (skipped) (*); ANCHOR end; ADD (done) (X);", STREAM)) == [['"a" X done'], ['"b" Y'], ['"c" Z']]
    assert len(tags(run("REMOVE DELAYED (N) IF (-1 (DET)); RESTORE (N) (N);", DUCK))[1]) == 2


def test_parentheses():
    stream = "".join(f'"<{w}>"\n\t"{w}" w\n' for w in "a(b)c")
    g = 'PARENTHESES = ("<(>" "<)>"); ADD (x) ("<a>") IF (1 ("<c>")); ADD (in) ("<b>") IF (L (*)) (R (*));'
    assert tags(run(g, stream))[0] == ['"a" w x'] and tags(run(g, stream))[2] == ['"b" w in']


def test_span():
    two = '"<a>"\n\t"a" A\n"<.>"\n\t"." P\n"<b>"\n\t"b" B\n'
    d = 'DELIMITERS = "<.>"; '
    assert tags(run(d + "ADD (hit) (A) IF (1* (B));", two))[0] == ['"a" A']
    assert tags(run(d + "ADD (hit) (A) IF (1*W (B));", two))[0] == ['"a" A hit']
    assert tags(run(d + "ADD (hit) (B) IF (-1*< (A));", two))[2] == ['"b" B hit']


def test_options():
    assert len(tags(run("SELECT (N);\nSECTION\nSELECT (DET);", DUCK, options=Options(sections=1)))[1]) == 1
    assert tags(run("REMOVE (DET);", DUCK, options=Options(unsafe=True)))[0] == []


def test_look_flags_and_numeric_branches():
    assert tags(run("REMOVE (V); ADD LOOKDELETED (x) (DET) IF (1 (INF)); ADD (y) (DET) IF (1 (INF));", DUCK))[0] == ['"the" DET x']
    stream = '"<a>"\n\t"a" N\n"<b>"\n\t"b" V <W=5>\n"<c>"\n\t"c" V\n'
    assert tags(run("ADD (x) (N) IF (1f (V <W>3>)) (2f (V <W>3>)); ADD (y) (N) IF (2 (V <W>3>));", stream))[0] == ['"a" N x']
    assert tags(run("ADD (x) (N) IF (*1 (<W>3>));", stream))[0] == ['"a" N x']


def test_external_once_and_always():
    """ONCE calls its command once per window, ALWAYS for each token that the rule meets."""
    for mode, times in (("ONCE", 2), ("ALWAYS", 6)):
        g = parse(f'DELIMITERS = "<.>"; EXTERNAL {mode} "cmd" (N) OR (DET) OR (V);')
        calls = []
        Applicator(g, None, lambda command, w: calls.append(command)).run(cg_text.parse(DUCK + DUCK, g))
        assert len(calls) == times and set(calls) == {"cmd"}


def test_rules_left_out():
    grammar = "SELECT:noun (N) IF (-1 (DET)); REMOVE:plural (N PL);"
    assert len(tags(run(grammar, DUCK))[1]) == 1
    for options, left in ((Options(nrules="^pl"), 2), (Options(nrules="n|pl"), 1), (Options(nrules_v="n"), 2), (Options(nrules_v="x"), 1)):
        assert len(tags(run(grammar, DUCK, options=options))[1]) == left


def test_self_no_barrier():
    """With the option, a barrier does not stop a scan at its own start; N then asks for the opposite."""
    rule = lambda n: f"REMOVE (V) IF (1*S{n} (PUNCT) BARRIER (N SG));"
    for option, n, left in (("", "", 2), ("", "N", 1), ("OPTIONS = self-no-barrier;", "", 1), ("OPTIONS = self-no-barrier;", "N", 2)):
        assert len(tags(run(f"{option} {rule(n)}", DUCK))[1]) == left


def test_coupling_through_nested_templates():
    from lexiloom.operators.apply import couples_windows

    nested = parse("TEMPLATE a = (1W (N)); TEMPLATE b = ((T:a) OR (-1 (V))); SELECT (N) IF (T:b);")
    assert couples_windows(nested, Options())
    assert not couples_windows(parse("TEMPLATE a = (1 (N)); TEMPLATE b = ((T:a) OR (-1 (V))); SELECT (N) IF (T:b);"), Options())


@pytest.mark.parametrize(
    "text, name",
    [
        ('"<a>"\n\t"a" N\n', "cg"), ('"<a>"\n', "plain"), ("a\t[b] N\n", "niceline"), ('a \t"b" N\n', "niceline"), ("^a/b<n>$ ", "apertium"), ("^a/b$", "plain"),
        ("a\tb+N\n", "fst"), ('{"w": "a"}\n', "jsonl"), (' {"w": 1}', "plain"), ("Just words.\n", "plain"),
    ],
)
def test_formats_are_told_by_their_head(text, name):
    from lexiloom.sources.codecs import detect

    assert detect(text) == name


class Counted(list):
    """Cohorts that count how often they are searched for one."""

    searched = 0

    def __iter__(self):
        Counted.searched += 1
        return super().__iter__()

    def index(self, *a):
        Counted.searched += 1
        return super().index(*a)

    def __contains__(self, x):
        Counted.searched += 1
        return super().__contains__(x)


@pytest.mark.parametrize("grammar", ["MAP (@X) (N) IF (1 (N));", "ADDRELATION (k) (N) TO (1 (N)); SETRELATION (k) (N) TO (-1 (N));", "SETVARIABLE (v) (1) (N); MAP (@X) (N) IF (0 (VAR:v));", "ADDRELATION (k) (N) TO (1 (N)); MAP (@R) (N) IF (r:k (N));"])
def test_long_window_is_not_searched(grammar):
    """A cohort's place is remembered, or work grows with the square of the window."""
    g = parse(grammar)
    w = cg_text.parse('"<a>"\n\t"a" N\n' * 200, g)[0]
    w.cohorts, Counted.searched = Counted(w.cohorts), 0
    Applicator(g).run([w])
    assert Counted.searched < 10  # not once per cohort


def test_relations_with_numbers_twice():
    """A number that two cohorts have means the first one in the window, as before any was remembered."""
    g = parse("ADDRELATION (k) (N) TO (1 (V)); MAP (@R) (N) IF (r:k (V));")
    w = cg_text.parse('"<a>"\n\t"a" N\n"<b>"\n\t"b" V\n"<c>"\n\t"c" N\n"<d>"\n\t"d" V\n', g)[0]
    for c, gid in zip(w.cohorts[1:], [5, 6, 7, 6]):
        c.gid = gid
    w.cohorts[2].readings[0].tags[-1] = "X"  # the first with number 6 is no V
    done = Applicator(g).run([w])[0]
    assert [c.relations for c in done.cohorts[1:]] == [{}, {}, {"k": {6}}, {}] and done.cohorts[3].readings[0].mapping == ""


def test_delimit_prepares_once(monkeypatch):
    """What follows a border isn't prepared again at every border, unless a rule has acted."""
    prepared = []
    split = Applicator.split_mappings
    monkeypatch.setattr(Applicator, "split_mappings", lambda self, r: prepared.append(1) or split(self, r))
    g = parse("DELIMIT (N);")
    done = Applicator(g).run(cg_text.parse('"<a>"\n\t"a" N\n' * 200, g))
    assert len(done) == 200 and len(prepared) == 200
    assert all([len(w.cohorts) == len(w.all) == 2 and w.cohorts[1].readings[0].tags[-1] == "<<<" and w.cohorts[1].window is w for w in done])
    g = parse("MAP (@X) (N); DELIMIT (N);")
    assert "".join(x for w in Applicator(g).run(cg_text.parse('"<a>"\n\t"a" N\n' * 3, g)) for c in w.cohorts[1:] for x in [c.readings[0].mapping]) == "@X@X@X"
