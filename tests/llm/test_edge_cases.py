"""Nulls, empty and long texts, repeated rows, empty tables and extra columns, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import (
    byte_bpe, chat_format, decontaminate, html_text, jaccard_join, language_id, piece_counts, pu_quality, quality_rules, toxicity,
)

P = pytest.importorskip("public_tokenizers")
RANKS = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
#: Other columns bear names that operators use for themselves.
OTHER = ["score", "word", "spans", "n_words", "items", "row_of", "v_lines", "v_source", "c_doc", "text_key", "lines", "row", "key", "ids", "toxic"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in OTHER)
LONG = "one two three four five six seven " * 3000


def docs_of(spark, empty=False):
    rows = [
        (1, "The cat sat on the mat and it was good. " * 5, "en", "a", 200, "x", "y", "z"),
        (1, "The cat sat on the mat and it was good. " * 5, "en", "a", 200, "x", "y", "z"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, None, None, None),
        (None, LONG, "fr", None, len(LONG), None, None, None),
        (5, " \n\t ", None, "b", 4, None, None, None),
        (6, "été ß 漢字 🙂 \x00 !!", "de", "b", 14, None, None, None),
    ]
    rows = [(*r[:5], *[None if r[0] is None else f"{name} {r[0]}" for name in OTHER]) for r in rows]
    return spark.createDataFrame([] if empty else rows, DOCS)


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "rules": lambda s, d: quality_rules.judge(d),
    "clean": lambda s, d: quality_rules.clean(d),
    "encode": lambda s, d: byte_bpe.decode(byte_bpe.encode(d, RANKS, P.PATTERN), RANKS),
    "pieces": lambda s, d: piece_counts.count_pieces(d, RANKS),
    "match": lambda s, d: decontaminate.match_documents(
        d, s.createDataFrame([(1, "one two three four five"), (2, None), (None, "x"), (3, "!")], "item_id long, text string")
    ),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([], "item_id long, text string")),
    "quality": lambda s, d: pu_quality.score(d, pu_quality.fit(d, labels_of(s))),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels_of(s))),
    "language": lambda s, d: language_id.predict(d, language_id.fit(d)),
    "jaccard": lambda s, d: jaccard_join.near_duplicates(d),
    "keep_one": lambda s, d: jaccard_join.keep_one(d),
}
ROWS = {"clean": 0, "keep_one": 6}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    found = OPERATORS[name](spark, docs_of(spark)).collect()
    assert len(found) == ROWS.get(name, 7)
    replaced = {"score", "toxic", "spans", "n_words", "items", "ids"}
    for r in found:
        for other in set(OTHER) - replaced if {"word", "row"} <= set(r.__fields__) else ():
            assert r[other] == (None if r.doc_id is None else f"{other} {r.doc_id}")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs_of(spark, empty=True)).collect() == []


def test_rules_keep_other_columns(spark):
    kept = quality_rules.clean(docs_of(spark))
    assert kept.columns == docs_of(spark).columns


def test_rules_count_documents_that_share_a_long_word(spark):
    """Independent documents with one footer; copies of one text count once."""
    draw = random.Random(5)
    body = lambda: " ".join("".join(draw.choices("abcdefghijklmnop", k=7)) for _ in range(60))
    footer = "all rights of reproduction reserved"
    rows = [(i, f"{body()}\n{footer}", "host") for i in range(quality_rules.MAX_DOCS + 1)]
    rows += [(100 + i, f"{body()}\n{footer}", "few") for i in range(quality_rules.MAX_DOCS)]
    copied = f"{body()}\nno line of this page is boilerplate"
    rows += [(200 + i, copied, "copies") for i in range(50)]
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in found if r.removed_words} == set(range(quality_rules.MAX_DOCS + 1))
    assert {r.removed_words for r in found} == {0, 5} and all(r.kept for r in found)


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, None, "k"), (2, "", "k"), (3, "<p>Hi &amp; bye<", "k"), (4, "<article><p>a<b>b</b>\n c<br>d<p>e &eacute", "k")],
        "page_id long, html string, text string",
    )
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert found == {1: ("", 0), 2: ("", 0), 3: ("", 0), 4: ("ab c d\n\ne é", 11)}


def test_html_long_attributes():
    """A quoted value of any length is part of its tag, whatever is in it."""
    for quote in "\"'":
        value = "x" * 5000 + "> not text <script> <p>" + "y" * 5000
        page = f"<article><p data-x={quote}{value}{quote} class=a>Before.<p>After.</article>"
        assert html_text.main_text(page) == "Before.\n\nAfter."
    assert html_text.main_text("<article><p title='>it's one>two") == "two"
    assert html_text.main_text("<article><p x=\"a'b\" y='c\"d>e'>one<p title=\"open>two") == "one\n\ntwo"
    assert html_text.main_text("<article><p>" + "<a b='" * 50_000).strip() == ""


def test_html_article_is_a_prior():
    """Density decides inside and outside articles; an article only tips the scales."""
    text = lambda n: f"It was {n} in the morning and they had been on the road with all of their things for most of the day. " * 3
    whole = lambda *parts: "\n\n".join(" ".join(x.split()) for x in parts)
    card = "<article><h3><a href=/x>A title of some other story</a></h3><p>The story of a man who was in the city and of what he had to say. <a href=/x>More</a></p></article>"
    body = f"<div><h1>The road</h1><p>{text('one')}</p><p>They went on.</p><p>{text('two')}</p></div>"
    assert html_text.main_text(f"<nav><a href=/>Home</a></nav>{body}<div>{card * 4}</div><footer>End</footer>") == whole("The road", text("one"), "They went on.", text("two"))
    links = "<p>" + "<a href=/x>Another long link to elsewhere</a> " * 8 + "</p>"
    low = "<p>" + "Kernel matrix vector tensor gradient " * 8 + "</p>"
    found = html_text.main_text(f"<div>Welcome to us</div><article><h1>T</h1><p>{text('one')}</p>{low}{links}<p>{text('two')}</p></article>{low}")
    assert found == whole("T", text("one"), low[3:-4], text("two"))
    short = "<nav><a href=/>Home</a></nav><article><p>Short news.</p><p>No more of it.</p></article><footer>End</footer>"
    assert html_text.main_text(short) == "Short news.\n\nNo more of it."
    assert html_text.main_text(f"<nav><a href=/>Home</a></nav>{body}{links}") == whole("The road", text("one"), "They went on.", text("two"))


def test_chat_odd_rows(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "psst"),
        (2, None, "ann", "alone"), (None, 1, "", "nobody"), (3, 0, "system", "none"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.speaker): r for r in chat_format.rotate(turns).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (2, "ann")}
    ann = found[1, "ann"]
    assert ann.text.count("<|im_end|>") == 5 and "user name=bob" in ann.text and ann.n_turns == 5
    assert [ann.text[m.start:m.end] for m in ann.mask] == ["hi < |im_end|><|im_end|>"]
    assert len(found[1, "bob"].mask) == 2
    assert chat_format.rotate(turns.limit(0)).collect() == []


def test_chat_whole_dialogues(spark):
    """A dialogue is one row, whatever its turn numbers; a longer one's parts join to it."""
    rows = [(1, 0, "system", "be brief")] + [(1, 10 * i, "ab"[i % 2], f"say {i}") for i in range(1, 75)]
    rows += [(2, None, "u", f"{i % 50:02}") for i in range(75)] + [(None, 3, "v", "same")] * 75 + [(4, 1, "w", "end")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {(r.conv_id, r.speaker): r for r in chat_format.rotate(turns).collect()}
    assert set(whole) == {(1, "a"), (1, "b"), (2, "u"), (None, "v"), (4, "w")}
    a = whole[1, "a"]
    assert a.n_turns == 75 and a.text.startswith("<|im_start|>system\nbe brief<|im_end|>")
    assert [a.text[m.start:m.end] for m in a.mask] == [f"say {i}<|im_end|>" for i in range(2, 75, 2)]
    parts = {}
    for r in sorted(chat_format.rotate(turns, part_turns=20).collect(), key=lambda r: r.part):
        parts.setdefault((r.conv_id, r.speaker), []).append(r)
        assert [r.text[m.start:m.end][-10:] for m in r.mask] == ["<|im_end|>"] * len(r.mask)
    assert {k: "".join(r.text for r in v) for k, v in parts.items()} == {k: r.text for k, r in whole.items()}
    assert [r.n_turns for r in parts[2, "u"]] == [20, 20, 20, 15] and [r.part for r in parts[None, "v"]] == [0, 1, 2, 3]
    assert [sum(len(r.mask) for r in parts[k]) for k in whole] == [len(whole[k].mask) for k in whole]


def test_items_without_an_id(spark):
    """Their windows hit; together they are one item without a name."""
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d"), (None, "e f g h"), (7, "b c d")], "item_id long, text string")
    for shard_words in (200_000, 3):
        found = {r.doc_id: r for r in decontaminate.match_documents(docs, items, window=4, shard_words=shard_words).collect()}
        assert found[1]["items"] == ["7", None] and found[2]["items"] == [None]
        assert [(s.s, s.e) for s in found[1].spans] == [(1, 5)] and [(s.s, s.e) for s in found[2].spans] == [(0, 4)]


def test_long_items_are_cut_into_pieces():
    words = [f"w{i}" for i in range(100)]
    for size in (26, 40, 99, 100, 101):
        parts = [p.split() for p, _ in decontaminate.pieces(" ".join(words), 13, size)]
        windows = {tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)}
        assert windows == {tuple(words[i : i + 13]) for i in range(88)} and all(13 <= len(p) <= size for p in parts)
    assert list(decontaminate.pieces("A-b", 13, 26)) == [("a b", 2)] and list(decontaminate.pieces(None, 13, 26)) == []


def test_spans_of_long_ids_stay(spark):
    """Ids beyond 2**53 survive a batch that also has a null id."""
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a b c"), (None, "d")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "q")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {big, None}
    for found in (pu_quality.score(docs, None), toxicity.score(docs, None), language_id.predict(docs, None)):
        assert {r.doc_id for r in found.collect()} == {big, None}
