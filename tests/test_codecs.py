"""Readers and writers of the stream formats."""

import pytest

from lexiloom.sources import cg_text, codecs

CG = '"<Dogs>"\n\t"dog" N PL\n\t"dog" V PRS\n"<run>"\n\t"run" V\n"<.>"\n\t"." P\n'


@pytest.mark.parametrize("name", ["cg", "niceline", "apertium", "jsonl", "fst"])
def test_round_trip(name):
    there = codecs.convert(CG, name, "cg")
    # a line of FST output is told by its tags, and only without the weight that we write
    assert codecs.detect(there.replace("\t0.0", "") if name == "fst" else there) == name
    back = codecs.convert(there, "cg", name)
    keep = lambda text: [x for x in text.split("\n") if x.startswith(('"<', "\t"))]
    assert [x.replace(" <W:0.000000>", "") for x in keep(back)] == keep(CG)


def test_plain():
    words = [c.wordform[2:-2] for w in codecs.read_plain('He said: "(Go)!" NATO iPod') for c in w.cohorts[1:]]
    assert words == ["He", "said", ":", '"', "(", "Go", ")", "!", '"', "NATO", "iPod"]
    tags = [c.readings[0].tags for w in codecs.read_plain("He NATO iPod A x", add_tags=True) for c in w.cohorts[1:]]
    assert [t[1:-1] if t[-1] == "<<<" else t[1:] for t in tags] == [["<first-upper>"], ["<first-upper>", "<all-upper>"], ["<mixed-upper>"], ["<first-upper>", "<all-upper>"], []]


def test_apertium_parts():
    ws = codecs.read_apertium(r"[[w]]^a\/b<x>/c<n>+d<v># e/*z$ [<b>]^q/*q$")
    a, q = [c for w in ws for c in w.cohorts[1:]]
    assert a.wordform == '"<a/b>"' and a.static == ["x"] and a.wblank == "[[w]]"
    assert a.readings[0].base == '"d# e"' and a.readings[0].next.base == '"c"'
    assert q.readings[0].base == '"*q"'
    assert codecs.cased("abc", "XYZ") == "ABC" and codecs.cased("abc", "Xy") == "Abc"


def test_fst_weights_and_unknown():
    ws = codecs.read_fst("ab\ta+N#b+V\t0.5\nab\tab+?\tinf\n\nx\t+?\tinf\n", factor=2.0)
    ab, x = [c for w in ws for c in w.cohorts[1:]]
    assert ab.readings[0].tags[:3] == ['"b"', "V", "<W:1.000000>"] and ab.readings[0].next.tags == ['"a"', "N"] and not x.readings


def test_jsonl_skips_bad_lines():
    ws = codecs.read_jsonl('{"w":"a","rs":[{"l":"a","ts":["N"]}]}\nnot json\n[1]\n{"cmd":"SETVAR:x=1"}\n{"w":"b","ds":1,"dp":0}\n')
    assert [c.wordform for w in ws for c in w.cohorts[1:]] == ['"<a>"', '"<b>"']


def test_dependencies_and_relations_get_global_ids():
    text = '"<a>"\n\t"a" X #1->2 ID:7 R:r:9\n"<b>"\n\t"b" Y #2->0 ID:9\n"<c>"\n\t"c" Z #3->8\n'
    a, b, c = [x for w in cg_text.parse(text) for x in w.cohorts[1:]]
    assert (a.dep_parent, b.dep_parent, c.dep_parent) == (b.gid, 0, None)
    assert a.relations == {"r": {b.gid}}


def test_multiwords():
    ws = cg_text.parse('"<in spite>"\n\t"spite" "<spite>" N\n\t\t"in" "<in >" P\n')
    assert [c.wordform for c in codecs.split_multiwords(ws)[0].cohorts[1:]] == ['"<in>"', '"<spite>"']


def test_matxin():
    ws = cg_text.parse('"<a>"\n\t"a" X #1->2\n"<b>"\n\t"b" Y #2->0\n')
    # every node has alloc and si, and nodes are indented by their depth below the sentence
    assert '    <NODE ord="2" alloc="0" form="b" lem="b" mi="Y" si="">\n      <NODE ord="1" alloc="0" form="a"' in codecs.write_matxin(ws)


def test_streams(spark):
    from lexiloom.operators.apply import apply_grammar
    from lexiloom.sources import streams

    texts = spark.createDataFrame([(1, CG), (2, None), (3, "")], "doc_id long, text string")
    rows = streams.read_texts(texts, "cg", 'DELIMITERS = "<.>"; SELECT (x);')
    out = streams.write_texts(apply_grammar(rows, "SELECT (N);"), "niceline").collect()
    assert [r.text for r in out] == ["Dogs\t[dog] N PL\nrun\t[run] V\n.\t[.] P\n"]
