"""Grammars as plans: syntax tree and parser.

A grammar is text; parsing it gives an immutable description that the planner
turns into DataFrame operations or hands to the kernel.  Nothing here touches
data.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

# --- tags -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tag:
    """One tag of a set.  kind: plain regex line icase any var lvar meta numeric varstring special set."""

    text: str
    kind: str = "plain"
    pattern: str = ""  # regex source, anchored where the syntax says so
    key: str = ""
    op: str = ""
    value: str = ""
    icase: bool = False
    failfast: bool = False
    value_kind: str = ""

    def regex(self) -> re.Pattern[str]:
        return _regex(self.pattern, self.icase)


_regexes: dict[tuple[str, bool], re.Pattern[str]] = {}


def _regex(pattern: str, icase: bool) -> re.Pattern[str]:
    key = (pattern, icase)
    if key not in _regexes:
        _regexes[key] = re.compile(pattern, re.I if icase else 0)
    return _regexes[key]


#: Names with a meaning of their own.
SPECIAL = {"*", "_LEFT_", "_RIGHT_", "_PAREN_", "_ENCL_", "_TARGET_", "_MARK_", "_ATTACHTO_", "_SAME_BASIC_", *(f"_C{i}_" for i in range(1, 10))}
#: Spellings of comparisons, longest first.
COMPARISONS = {"<>": "!=", "><": "!=", "<=": "<=", ">=": ">=", "=<": "<=", "=>": ">=", "!=": "!=", "=": "=", ":": "=", "!": "!=", "<": "<", ">": ">"}
_NUMERIC = re.compile(r"<([^<>=:!]+?)(<>|><|<=|>=|=<|=>|!=|=|:|<|>)(.+)>")
LIMIT = float(2**48 - 1)


def number(text: str) -> float | None:
    """The value of a numeric tag: MIN and MAX are the limits."""
    if text in ("MIN", "MAX"):
        return -LIMIT if text == "MIN" else LIMIT
    try:
        return max(-LIMIT, min(LIMIT, float(text)))
    except ValueError:
        return None


def numeric_parts(text: str) -> tuple[str, str, str] | None:
    """(key, comparison, value text) of ``<key op value>``; None for other tags."""
    m = _NUMERIC.fullmatch(text)
    return (m[1], COMPARISONS[m[2]], m[3]) if m else None


def parse_tag(text: str) -> Tag:
    failfast = text.startswith("^") and len(text) > 1
    text = text[1:] if failfast else text
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    for prefix, kind in (("VAR:", "var"), ("LVAR:", "lvar")):
        if text.startswith(prefix):
            key, _, value = text[len(prefix):].partition("=")
            return Tag(text, kind, key=key, value=value, failfast=failfast)
    if text.startswith("META:"):
        inner = parse_tag(text[5:])
        return Tag(text, "meta", inner.pattern or re.escape(inner.text.strip("/")), icase=inner.icase, failfast=failfast)
    if text.startswith("SET:"):
        return Tag(text, "set", key=text[4:], failfast=failfast)
    for prefix in ("VSTR:", "PSTR:"):
        if text.startswith(prefix):
            return Tag(text, "varstring", value=text[5:], failfast=failfast)
    if text in SPECIAL:
        return Tag(text, "any" if text == "*" else "special", failfast=failfast)
    m = re.fullmatch(r'("(?:[^"\\]|\\.)*"|<.*>|/(?:[^/\\]|\\.)*/)([rivlp]*)', text, re.S)
    if m:
        body, flags = m[1], m[2]
        if body.startswith("/") and not flags:
            return Tag(text, failfast=failfast)
        icase = "i" in flags
        if "v" in flags:
            return Tag(body, "varstring", value=body, icase=icase, failfast=failfast)
        if "r" in flags or "l" in flags:
            if body in ('".*"', '"<.*>"', "<.*>"):
                return Tag(body, "anyform", icase=icase, failfast=failfast)
            inner = body[1:-1] if body.startswith("/") else f"^{body}$"
            if "l" in flags:
                return Tag(text, "line", inner.replace("__", r"(?:^|$| | .+? )"), icase=icase, failfast=failfast)
            return Tag(text, "regex", inner, icase=icase, failfast=failfast)
        if icase:
            return Tag(body, "icase", icase=True, failfast=failfast)
        parts = numeric_parts(body)
        if parts and (number(parts[2]) is not None or re.search(r"MIN|MAX|[-+*/^(]", parts[2])):
            return Tag(body, "numeric", key=parts[0], op=parts[1], value=parts[2], failfast=failfast)
        return Tag(body, failfast=failfast)
    return Tag(text, failfast=failfast)


# --- sets -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TagSet:
    """op: list (members: tuples of tags, each a conjunction), or + - ^ set operators over parts, name, unify_tag, unify_set."""

    op: str
    members: tuple[tuple[Tag, ...], ...] = ()
    parts: tuple["TagSet", ...] = ()
    name: str = ""

    def tags(self) -> list[Tag]:
        return [t for m in self.members for t in m]


ANY = TagSet("list", ((Tag("*", "any"),),))

# --- tests and rules --------------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    offset: int = 0
    flags: frozenset[str] = frozenset()  # see positions() below
    target: TagSet | None = None
    barrier: TagSet | None = None
    cbarrier: TagSet | None = None
    relation: str = ""
    sub: int | str = 0
    template: str = ""
    ors: tuple["Test", ...] = ()
    link: "Test | None" = None
    jump: str = ""
    at_end: bool = False

    def has(self, *names: str) -> bool:
        return not self.flags.isdisjoint(names)


@dataclass
class Rule:
    kind: str
    number: int = 0
    line: int = 0
    name: str = ""
    wordform: Tag | None = None
    flags: frozenset[str] = frozenset()
    target: TagSet = ANY
    maplist: TagSet | None = None
    sublist: TagSet | None = None
    except_list: TagSet | None = None
    side: str = ""
    child: TagSet | None = None
    dep_child: TagSet | None = None
    tests: list[Test] = field(default_factory=list)
    dep_tests: list[Test] = field(default_factory=list)
    nested: list["Rule"] = field(default_factory=list)
    sub: int | str = 0
    command: str = ""
    mode: str = ""
    place: TagSet | None = None  # the tags beside which ADD and its kin put theirs

    @property
    def iterates(self) -> bool:
        if "ITERATE" in self.flags:
            return True
        return "NOITERATE" not in self.flags and self.kind in ITERATING


#: Rules whose changes run their section again unless flagged otherwise.
ITERATING = {"SELECT", "REMOVE", "IFF", "DELIMIT", "REMCOHORT", "MOVE", "SWITCH"}
FLAGS = set(
    "NEAREST ALLOWLOOP ALLOWCROSS DELAYED IMMEDIATE IGNORED LOOKDELETED LOOKDELAYED LOOKIGNORED UNSAFE SAFE REMEMBERX RESETX "
    "KEEPORDER VARYORDER ENCL_INNER ENCL_OUTER ENCL_FINAL ENCL_ANY WITHCHILD NOCHILD ITERATE NOITERATE REPEAT UNMAPLAST OUTPUT "
    "REVERSE CAPTURE_UNIF NOMAPPED NOPARENT DETACH BEFORE AFTER".split()
)
RULES = set(
    "SELECT REMOVE IFF ADD MAP REPLACE SUBSTITUTE APPEND COPY UNMAP PROTECT UNPROTECT RESTORE DELIMIT JUMP SETVARIABLE "
    "REMVARIABLE REMCOHORT ADDCOHORT COPYCOHORT SPLITCOHORT MERGECOHORTS MOVE SWITCH SETPARENT SETCHILD REMPARENT SWITCHPARENT "
    "ADDRELATION SETRELATION REMRELATION ADDRELATIONS SETRELATIONS REMRELATIONS WITH EXTERNAL EXECUTE".split()
)
ONE_LIST = set("ADD MAP REPLACE APPEND COPY ADDCOHORT COPYCOHORT SPLITCOHORT MERGECOHORTS RESTORE JUMP REMVARIABLE ADDRELATION SETRELATION REMRELATION".split())
TWO_LISTS = set("SUBSTITUTE SETVARIABLE ADDRELATIONS SETRELATIONS REMRELATIONS EXECUTE".split())
#: What OPTIONS may hold.
OPTIONS = set(
    "no-inline-sets no-inline-templates strict-wordforms strict-baseforms strict-secondary strict-regex strict-icase "
    "self-no-barrier ordered addcohort-attach safe-setparent".split()
)
CLOSING = {"TO", "FROM", "WITH", "BEFORE", "AFTER"}
SECTION_NAMES = {"SECTION", "BEFORE-SECTIONS", "AFTER-SECTIONS", "NULL-SECTION", "MAPPINGS", "CORRECTIONS", "CONSTRAINTS"}


@dataclass
class Grammar:
    sets: dict[str, TagSet] = field(default_factory=dict)
    templates: dict[str, Test] = field(default_factory=dict)
    before: list[Rule] = field(default_factory=list)
    sections: list[list[Rule]] = field(default_factory=list)
    after: list[Rule] = field(default_factory=list)
    null: list[Rule] = field(default_factory=list)
    anchors: dict[str, int] = field(default_factory=dict)
    delimiters: TagSet | None = None
    soft_delimiters: TagSet | None = None
    text_delimiters: list[Tag] = field(default_factory=list)
    parentheses: list[tuple[Tag, Tag]] = field(default_factory=list)
    prefix: str = "@"
    reopen: set[str] = field(default_factory=set)
    subreadings: str = "RTL"
    options: set[str] = field(default_factory=set)
    cmdargs: list[str] = field(default_factory=list)
    cmdargs_override: list[str] = field(default_factory=list)
    strict: set[str] = field(default_factory=set)
    list_tags: set[str] = field(default_factory=set)
    static_sets: set[str] = field(default_factory=set)

    def rules(self) -> list[Rule]:
        return [*self.before, *(r for s in self.sections for r in s), *self.after, *self.null]


class GrammarError(ValueError):
    """A grammar that can't be parsed; says at which line."""


# --- lexer ------------------------------------------------------------------------------------

_QUOTED = r'\^?(?:VAR:|LVAR:|META:|VSTR:|PSTR:)?"(?:[^"\\]|\\.)*"[a-z]*'
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>#[^\n]*)"
    rf"|(?P<quoted>{_QUOTED})"
    r"|(?P<slashed>\^?(?:META:)?/(?:[^/\\\s]|\\.|(?<=[^/]) )*?/[ril]+)"
    r"|(?P<angled>\^?<[^\s()]*>[riv]*(?=[\s();,\]]|$))"
    r"|(?P<mark>[();{}\[\],])|(?P<back>\\(?=\s))"
    r"|(?P<word>(?:[^\s();{}\[\],\"\\]|\\.|\"(?=[^\s]))+)",
    re.S,
)


LISTING = {"LIST", "OLIST", "DELIMITERS", "SOFT-DELIMITERS", "STRICT-TAGS", "LIST-TAGS", "PREFERRED-TARGETS", "REOPEN-MAPPINGS"}
KEYWORDS = RULES | FLAGS | SECTION_NAMES | CLOSING | LISTING | set(
    "SETS SET OSET TEMPLATE TEXT-DELIMITERS PARENTHESES MAPPING-PREFIX SUBREADINGS STATIC-SETS UNDEF-SETS OPTIONS CMDARGS CMDARGS-OVERRIDE INCLUDE "
    "STATIC ANCHOR END TARGET IF EXCEPT OR ONCE ALWAYS".split()
)


@dataclass
class Token:
    text: str
    kind: str
    line: int


def tokenize(text: str) -> list[Token]:
    """Tokens; keywords may be written in mixed case outside brackets and tag lists."""
    out, at, line, depth, listing = [], 0, 1, 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise GrammarError(f"line {line}: unexpected {text[at]!r}")
        if m.lastgroup not in ("space", "comment"):
            found = m[0]
            depth += (found in "([") - (found in ")]") if m.lastgroup == "mark" else 0
            if m.lastgroup == "word" and depth == 0 and not listing and found[0].isupper():
                head, colon, name = found.partition(":")
                found = head.upper() + colon + name if head.upper() in KEYWORDS else found
                listing = found in LISTING
            listing = listing and found != ";"
            out.append(Token(found, "word" if m.lastgroup == "back" else m.lastgroup or "", line))
        line += m[0].count("\n")
        at = m.end()
    return out


# --- parser -----------------------------------------------------------------------------------


class Parser:
    def __init__(self, text: str, include: Callable[[str], str] | None = None) -> None:
        self.tokens = tokenize(text)
        self.at = 0
        self.grammar = Grammar()
        self.include = include
        self.place: list[Rule] | None = None
        self.section_flags: set[str] = set()
        self.count = 0
        self.renamed: dict[str, str] = {}  # names that were undefined and may be given again

    # reading tokens
    def peek(self, ahead: int = 0) -> Token:
        at = self.at + ahead
        return self.tokens[at] if at < len(self.tokens) else Token("", "end", self.tokens[-1].line if self.tokens else 1)

    def take(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def fail(self, what: str) -> GrammarError:
        token = self.peek()
        return GrammarError(f"line {token.line}: expected {what}, found {token.text!r}")

    def expect(self, *texts: str) -> Token:
        if self.peek().text not in texts:
            raise self.fail(" or ".join(texts))
        return self.take()

    def maybe(self, *texts: str) -> bool:
        if self.peek().text in texts and self.peek().kind != "quoted":
            self.at += 1
            return True
        return False

    # statements
    def parse(self) -> Grammar:
        while self.peek().kind != "end":
            if self.peek().text == "END":
                break
            self.statement()
        return self.grammar

    def statement(self) -> None:
        g, token = self.grammar, self.peek()
        word = token.text
        if self.maybe(";"):
            return
        if word in ("SETS",):
            self.take()
        elif word in SECTION_NAMES:
            self.section()
        elif word in ("DELIMITERS", "SOFT-DELIMITERS"):
            self.take()
            self.expect("=", "+=")
            found = self.tag_list()
            setattr(g, "delimiters" if word == "DELIMITERS" else "soft_delimiters", found)
            g.sets["_S_DELIMITERS_" if word == "DELIMITERS" else "_S_SOFT_DELIMITERS_"] = TagSet("list", found.members)
        elif word == "TEXT-DELIMITERS":
            self.take()
            self.expect("=", "+=")
            g.text_delimiters = self.tag_list().tags()
        elif word in ("LIST", "OLIST"):
            self.take()
            name = self.current(self.take().text)
            grows = self.expect("=", "+=").text == "+="
            found = self.tag_list()
            if grows and name in g.sets:
                found = TagSet("list", g.sets[name].members + found.members)
            g.sets[name] = TagSet("list", found.members, name=name)
        elif word in ("SET", "OSET"):
            self.take()
            name = self.current(self.take().text)
            self.expect("=")
            g.sets[name] = self.set_expression()
            self.expect(";")
        elif word == "TEMPLATE":
            self.take()
            name = self.take().text
            self.expect("=")
            found = self.test_or_group()
            g.templates[name] = _with_link(found, self.test_body() if self.maybe("LINK") else None)
            self.expect(";")
        elif word == "PARENTHESES":
            self.take()
            self.expect("=")
            while self.maybe("("):
                left, right = self.tag(), self.tag()
                self.expect(")")
                g.parentheses.append((left, right))
            self.expect(";")
        elif word == "MAPPING-PREFIX":
            self.take()
            self.expect("=")
            g.prefix = self.take().text
            self.expect(";")
        elif word == "SUBREADINGS":
            self.take()
            self.expect("=")
            g.subreadings = self.take().text
            self.expect(";")
        elif word in ("REOPEN-MAPPINGS", "STATIC-SETS", "UNDEF-SETS", "STRICT-TAGS", "LIST-TAGS", "OPTIONS", "CMDARGS", "CMDARGS-OVERRIDE", "PREFERRED-TARGETS"):
            self.take()
            self.expect("=", "+=")
            names = []
            while not self.maybe(";"):
                names.append(self.take().text)
            if word == "REOPEN-MAPPINGS":
                g.reopen |= set(names)
            elif word == "OPTIONS":
                unknown = {n.lower() for n in names} - OPTIONS
                if unknown:
                    raise GrammarError(f"line {token.line}: unknown option {min(unknown)}")
                g.options |= {n.lower() for n in names}
            elif word == "STRICT-TAGS":
                g.strict |= set(names)
            elif word == "LIST-TAGS":
                g.list_tags |= set(names)
            elif word == "STATIC-SETS":
                g.static_sets |= set(names)
            elif word == "UNDEF-SETS":
                for n in names:  # what was parsed before keeps the set under its name
                    self.renamed[n] = f"{n}__{self.at}"
            elif word == "CMDARGS":
                g.cmdargs += names
            elif word == "CMDARGS-OVERRIDE":
                g.cmdargs_override += names
        elif word == "INCLUDE":
            self.take()
            self.maybe("STATIC")
            name = self.take().text.strip('"')
            self.maybe(";")
            if self.include is None:
                raise GrammarError(f"line {token.line}: no way to include {name}")
            self.tokens[self.at : self.at] = tokenize(self.include(name))
        elif word == "ANCHOR":
            self.take()
            g.anchors[self.take().text.strip("()")] = self.count
            self.expect(";")
        else:
            self.add(self.rule())

    def section(self) -> None:
        g, word = self.grammar, self.take().text
        if word in ("BEFORE-SECTIONS", "MAPPINGS", "CORRECTIONS"):
            self.place = g.before
        elif word == "AFTER-SECTIONS":
            self.place = g.after
        elif word == "NULL-SECTION":
            self.place = g.null
        else:
            g.sections.append([])
            self.place = g.sections[-1]
        self.section_flags = set()
        while self.peek().text in FLAGS or (self.peek().kind == "word" and self.peek(1).text == ";" and self.peek().text not in RULES):
            name = self.take().text
            if name in FLAGS:
                self.section_flags.add(name)
            else:
                g.anchors[name] = self.count
        self.maybe(";")

    def add(self, rule: Rule) -> None:
        if self.place is None:
            self.grammar.sections.append([])
            self.place = self.grammar.sections[-1]
        self.place.append(rule)

    # sets
    def current(self, name: str) -> str:
        """The name a set has now: one that was undefined and given again is another set."""
        return self.renamed.get(name, name)

    def tag(self) -> Tag:
        """A tag that STRICT-TAGS allows."""
        found, strict, options = parse_tag(self.take().text), self.grammar.strict, self.grammar.options
        text = found.text
        if not strict or text in strict or found.kind in ("any", "varstring", "meta", "var", "lvar", "set", "special") or text in (">>>", "<<<"):
            return found
        if found.kind in ("regex", "line", "anyform"):
            allowed = "strict-regex" not in options
        elif found.kind == "icase":
            allowed = "strict-icase" not in options
        elif text.startswith('"'):
            allowed = ("strict-wordforms" if text.startswith('"<') else "strict-baseforms") not in options
        else:
            allowed = text.startswith("<") and text.endswith(">") and "strict-secondary" not in options
        if not allowed:
            self.at -= 1
            raise self.fail("a tag of STRICT-TAGS")
        return found

    def tag_list(self) -> TagSet:
        """Tags and (tuples of tags) up to the semicolon."""
        members: list[tuple[Tag, ...]] = []
        while not self.maybe(";"):
            if self.maybe("("):
                members.append(self.composite())
            elif self.peek().kind == "end":
                raise self.fail(";")
            else:
                members.append((self.tag(),))
        return TagSet("list", tuple(members))

    def composite(self) -> tuple[Tag, ...]:
        tags: list[Tag] = []
        while not self.maybe(")"):
            if self.peek().kind == "end":
                raise self.fail(")")
            tags.append(self.tag())
        return tuple(tags)

    def operand(self) -> TagSet:
        token = self.take()
        if token.text == "(":
            return TagSet("list", (self.composite(),))
        if token.text.startswith(("$$", "&&")):
            number, colon, name = token.text[2:].rpartition(":")
            name = self.current(name)
            if name not in self.grammar.sets:
                self.at -= 1
                raise self.fail("a defined set")
            return TagSet("unify_tag" if token.text[0] == "$" else "unify_set", name=number + colon + name)
        if token.kind == "word" and token.text not in (";",):
            name = self.current(token.text)
            if name in self.grammar.sets or token.text in SPECIAL:
                return TagSet("name", name=name)
            if token.text in self.grammar.strict | self.grammar.list_tags:
                return TagSet("list", ((parse_tag(token.text),),))
            self.at -= 1
            raise self.fail("a defined set")
        self.at -= 1
        if token.kind in ("quoted", "angled", "slashed"):
            return TagSet("list", ((self.tag(),),))
        raise self.fail("a set")

    def set_expression(self) -> TagSet:
        """OR binds loosest; + - ^ bind from the left; backslash, ∩ and ∆ are done at once on tag tuples."""
        arms = [self.operand()]
        while True:
            token = self.peek()
            if token.kind != "word":
                break
            if token.text in ("OR", "|"):
                self.take()
                arms.append(self.operand())
            elif token.text in ("+", "-", "^"):
                self.take()
                arms[-1] = TagSet(token.text, parts=(arms[-1], self.operand()))
            elif token.text in ("\\", "∩", "∆"):
                self.take()
                arms[-1] = tuple_algebra(token.text, self.members(arms[-1]), self.members(self.operand()))
            else:
                break
        return arms[0] if len(arms) == 1 else TagSet("or", parts=tuple(arms))

    def members(self, s: TagSet) -> tuple[tuple[Tag, ...], ...]:
        """All tag tuples of a set made of lists."""
        if s.op == "name":
            if s.name not in self.grammar.sets:
                raise self.fail(f"a defined set instead of {s.name}")
            return self.members(self.grammar.sets[s.name])
        if s.op == "list":
            return s.members
        if s.op == "or":
            return tuple(dict.fromkeys(m for p in s.parts for m in self.members(p)))
        raise self.fail("a set of tags")

    # tests
    def test_or_group(self) -> Test:
        """( ... ), ((a) OR (b)), [a, b], or bare parts of a template."""
        if self.peek().text == "[":
            self.take()
            sets = [self.set_expression()]
            while self.maybe(","):
                sets.append(self.set_expression())
            self.expect("]")
            test: Test | None = None
            for k in range(len(sets) - 1, -1, -1):
                test = Test(offset=0 if k == 0 else 1, target=sets[k], link=test)
            assert test is not None
            return test
        if self.peek().text == "(" and self.peek(1).text == "(" :
            return self.test()
        if self.peek().text == "(":
            first = self.test()
            if self.peek().text in ("OR", "|"):
                arms = [first]
                while self.maybe("OR", "|"):
                    arms.append(self.test())
                return Test(ors=tuple(arms))
            return first
        return self.test_body()

    def test(self) -> Test:
        self.expect("(")
        found = self.test_body()
        self.expect(")")
        return found

    def test_body(self) -> Test:
        flags: set[str] = set()
        while self.peek().text in ("NOT", "NEGATE", "ALL", "NONE"):
            flags.add(self.take().text)
        if self.peek().text in ("(", "["):
            arms = [self.test_or_group()]
            while self.maybe("OR", "|"):
                arms.append(self.test_or_group())
            test = arms[0] if len(arms) == 1 and not flags else Test(ors=tuple(arms), flags=frozenset(flags))
            link = self.test_body() if self.maybe("LINK") else None
            return _with_link(test, link)
        position = self.take().text
        if position.startswith("T:"):
            test = Test(template=position[2:], flags=frozenset(flags))
        else:
            test = positions(position, flags)
            if self.peek().text.startswith("T:"):
                test = Test(**{**test.__dict__, "template": self.take().text[2:]})
            elif self.peek().text not in (")", "LINK", "BARRIER", "CBARRIER"):
                test = Test(**{**test.__dict__, "target": self.set_expression()})
        changed = dict(test.__dict__)
        while self.peek().text in ("BARRIER", "CBARRIER"):
            name = self.take().text.lower()
            changed[name] = self.set_expression()
        if self.maybe("LINK"):
            changed["link"] = self.test_body()
        if "self-no-barrier" in self.grammar.options and "self" in test.flags:
            changed["flags"] = test.flags ^ {"nobarrier"}
        found = Test(**changed)
        return self.numeric_branches(found) if found.has("numeric_branch") else found

    def numeric_branches(self, t: Test) -> Test:
        """With the numeric tags, or else without them."""
        with_tags = Test(**{**t.__dict__, "flags": t.flags - {"numeric_branch"}})
        without = {n: None if getattr(t, n) is None else self.without_numeric(getattr(t, n)) for n in ("target", "barrier", "cbarrier")}
        return Test(ors=(with_tags, Test(**{**with_tags.__dict__, **without})))

    def without_numeric(self, s: TagSet) -> TagSet:
        if s.op == "name" and s.name in self.grammar.sets:
            return self.without_numeric(self.grammar.sets[s.name])
        left = tuple(m for m in (tuple(t for t in m if t.kind != "numeric") for m in s.members) if m)
        return TagSet(s.op, left, tuple(map(self.without_numeric, s.parts)), s.name)

    # rules
    def rule(self) -> Rule:
        line, wordform = self.peek().line, None
        if self.peek().kind == "quoted":
            wordform = self.tag()
        keyword, _, name = self.take().text.partition(":")
        if keyword not in RULES:
            self.at -= 1
            raise self.fail("a statement")
        self.count += 1
        rule = Rule(keyword, self.count, line, name, wordform)
        if keyword == "EXTERNAL":
            rule.mode = self.expect("ONCE", "ALWAYS").text
            rule.command = self.take().text.strip('"')
        flags = set(self.section_flags)
        self.rule_flags(rule, flags)
        if keyword in ONE_LIST or keyword in TWO_LISTS:
            rule.maplist = self.set_expression()
        if keyword in TWO_LISTS:
            rule.sublist, rule.maplist = rule.maplist, self.set_expression()
        if keyword in ("COPY", "COPYCOHORT", "REPLACE") and self.maybe("EXCEPT"):
            rule.except_list = self.set_expression()
        if keyword in ("ADD", "MAP", "SUBSTITUTE", "ADDCOHORT", "COPY", "COPYCOHORT", "APPEND") and self.peek().text in ("BEFORE", "AFTER"):
            rule.side = self.take().text
            if "COHORT" not in keyword:
                rule.place = self.set_expression()
        self.rule_flags(rule, flags)
        self.maybe("TARGET")
        rule.target = self.set_expression()
        self.maybe("IF")
        rule.tests = self.tests()
        if self.peek().text in CLOSING:
            closing = self.take().text
            if closing == "FROM":
                flags.add("REVERSE")
            if closing in ("BEFORE", "AFTER"):
                rule.side = closing
            elif self.peek().text in ("BEFORE", "AFTER"):
                rule.side = self.take().text
            if self.peek().text in ("WITHCHILD", "NOCHILD"):
                rule.dep_child = self.set_expression() if self.take().text == "WITHCHILD" else None
            rule.dep_tests = self.tests()
        if keyword == "WITH":
            self.expect("{")
            while not self.maybe("}"):
                if not self.maybe(";"):
                    rule.nested.append(self.rule())
            self.maybe(";")
        else:
            self.expect(";")
        if keyword == "SETPARENT" and not flags & {"SAFE", "UNSAFE"} and "safe-setparent" in self.grammar.options:
            flags.add("SAFE")
        rule.flags = frozenset(flags)
        looks = {mark for flag, mark in LOOKS.items() if flag in flags}
        if looks:
            rule.tests = [_looking(t, looks) for t in rule.tests]
            rule.dep_tests = [_looking(t, looks) for t in rule.dep_tests]
        return rule

    def rule_flags(self, rule: Rule, flags: set[str]) -> None:
        while True:
            token = self.peek()
            if token.text.startswith("SUB:"):
                rule.sub = _sub(self.take().text[4:])
            elif token.text in FLAGS and token.text not in ("BEFORE", "AFTER") and not (token.text == "WITHCHILD"):
                flags.add(self.take().text)
            elif token.text == "WITHCHILD":
                self.take()
                flags.add("WITHCHILD")
                rule.child = self.set_expression()
            else:
                return

    def tests(self) -> list[Test]:
        found: list[Test] = []
        while self.peek().text in ("(", "[", "NOT", "NEGATE", "ALL", "NONE"):
            if self.peek().text in ("(", "["):
                found.append(self.test_or_group())
            else:
                flag = self.take().text
                inner = self.test_or_group()
                found.append(Test(**{**inner.__dict__, "flags": inner.flags | {flag}}))
        return found


#: Rule flags that let all of a rule's tests see more readings.
LOOKS = {"LOOKDELETED": "look_deleted", "LOOKDELAYED": "look_delayed", "LOOKIGNORED": "look_ignored"}


def _looking(t: Test, looks: set[str]) -> Test:
    ors, link = tuple(_looking(x, looks) for x in t.ors), None if t.link is None else _looking(t.link, looks)
    return Test(**{**t.__dict__, "flags": t.flags | looks, "ors": ors, "link": link})


def _with_link(test: Test, link: Test | None) -> Test:
    return test if link is None else Test(**{**test.__dict__, "link": link if test.link is None else _with_link(test.link, link)})


def _sub(text: str) -> int | str:
    return "*" if text == "*" else int(text)


def tuple_algebra(op: str, left: tuple[tuple[Tag, ...], ...], right: tuple[tuple[Tag, ...], ...]) -> TagSet:
    """Set operations on the tag tuples themselves."""
    key = lambda m: frozenset(t.text for t in m)
    a, b = {key(m): m for m in left}, {key(m): m for m in right}
    keep = {"\\": [a[k] for k in a if k not in b], "∩": [a[k] for k in a if k in b]}
    keep["∆"] = keep["\\"] + [b[k] for k in b if k not in a]
    return TagSet("list", tuple(keep[op]))


_POSITION = re.compile(
    r"(?P<rel>r:.+$)|(?P<num>@?-?\d+)|(?P<stars>\*+)|(?P<sub>/(?:-?\d+|\*))|(?P<jump>j(?:M|A|T|C[1-9]))"
    r"|(?P<double>pp|cc|ll|rr)|(?P<one>[CcpslrSNW<>AwDdITtoOLRXxBf?])"
)
_NAMES = {
    "C": "careful", "c": "child", "p": "parent", "pp": "ancestor", "cc": "descendant", "s": "sibling", "l": "left", "r": "right",
    "ll": "leftmost", "rr": "rightmost", "S": "self", "N": "nobarrier", "W": "span", "<": "span_left", ">": "span_right",
    "A": "attach", "w": "with", "D": "look_deleted", "d": "look_delayed", "I": "look_ignored", "T": "active", "t": "inactive",
    "o": "no_origin", "O": "pass_origin", "L": "left_par", "R": "right_par", "X": "mark_set", "x": "mark_jump", "B": "bag",
    "f": "numeric_branch", "?": "unknown",
}


def positions(text: str, flags: set[str]) -> Test:
    """The offset and the letters of a test's position."""
    found, at = set(flags), 0
    out: dict[str, object] = {"offset": 0}
    while at < len(text):
        m = _POSITION.match(text, at)
        if m is None:
            raise GrammarError(f"bad position {text!r}")
        at = m.end()
        if m["rel"]:
            out["relation"] = m["rel"][2:]
        elif m["num"]:
            if m["num"].startswith("@"):
                found.add("absolute")
            out["offset"] = int(m["num"].lstrip("@"))
        elif m["stars"]:
            found.add("scan_all" if len(m["stars"]) > 1 else "scan")
        elif m["sub"]:
            out["sub"] = _sub(m["sub"][1:])
        elif m["jump"]:
            out["jump"] = m["jump"][1:]
        else:
            found.add(_NAMES[m["double"] or m["one"]])
    return Test(flags=frozenset(found), **out)  # type: ignore[arg-type]


def parse(text: str, include: Callable[[str], str] | None = None) -> Grammar:
    """The grammar of a text; ``include`` gives the text of an included file."""
    return Parser(text, include).parse()
