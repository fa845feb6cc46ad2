"""The sequential kernel: applies a grammar to the windows of one document.

Rules whose effects feed their own tests, restructure the window, or bind
variables across tests can't be set-based; they run here, window by window,
inside ``mapInPandas`` or ``applyInPandas``.  The same kernel is the yardstick
for the set-based plans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from lexiloom.functions.numeric import compare, evaluate, numeric_tags
from lexiloom.functions.varstring import expand
from lexiloom.plans.grammar import Grammar, Rule, Tag, TagSet, Test, parse_tag

MAX_PASSES = 1000


# --- data -------------------------------------------------------------------------------------


@dataclass(eq=False)
class Reading:
    """One analysis: ``tags`` begins with the quoted base form; the mapping tag is apart."""

    tags: list[str]
    mapping: str = ""
    mapped: bool = False
    noprint: bool = False
    immutable: bool = False
    active: bool = False
    hit_by: list[int] = field(default_factory=list)
    next: "Reading | None" = None
    number: int = 0

    @property
    def base(self) -> str:
        return next((t for t in self.tags if is_base(t)), "")

    def all_tags(self) -> list[str]:
        return [*self.tags, self.mapping] if self.mapping else self.tags

    def chain(self) -> list["Reading"]:
        out: list[Reading] = []
        at: Reading | None = self
        while at is not None:
            out.append(at)
            at = at.next
        return out

    def copy(self) -> "Reading":
        return Reading(list(self.tags), self.mapping, self.mapped, self.noprint, self.immutable, self.active, list(self.hit_by),
                       self.next.copy() if self.next else None, self.number)


@dataclass(eq=False)
class Cohort:
    wordform: str
    readings: list[Reading] = field(default_factory=list)
    static: list[str] = field(default_factory=list)
    deleted: list[Reading] = field(default_factory=list)
    delayed: list[Reading] = field(default_factory=list)
    ignored: list[Reading] = field(default_factory=list)
    gid: int = 0
    dep_self: int = 0
    dep_parent: int | None = None
    relations: dict[str, set[int]] = field(default_factory=dict)
    text: str = ""
    wblank: str = ""
    removed: bool = False
    hidden: bool = False
    enclosed: int = 0
    window: "Window | None" = None
    at: int = 0  # where it was last found in its window

    @property
    def pos(self) -> int:
        return place(self.window.cohorts, self) if self.window else -1


@dataclass(eq=False)
class Window:
    cohorts: list[Cohort] = field(default_factory=list)
    all: list[Cohort] = field(default_factory=list)
    text: str = ""
    text_post: str = ""
    vars_set: dict[str, str] = field(default_factory=dict)
    vars_rem: list[str] = field(default_factory=list)
    vars_out: dict[str, str] = field(default_factory=dict)
    flush_after: bool = False
    parens: tuple[Cohort, Cohort] | None = None
    final_enclosure: bool = False
    enclosures: bool = False  # whether bracketed spans were cut out
    called: set[int] = field(default_factory=set)  # EXTERNAL ONCE rules that were called on it
    at: int = 0  # where it was last found among the document's windows
    ready: int = -1  # how many actions there had been when its cohorts were known to be prepared


def place(items: list, x: Cohort | Window) -> int:
    """Where a cohort or window is in its list, or -1: where it was last, unless the list has changed."""
    if x.at < len(items) and items[x.at] is x:
        return x.at
    try:
        x.at = items.index(x)
    except ValueError:
        return -1
    return x.at


def is_base(tag: str) -> bool:
    return tag.startswith('"') and not tag.startswith('"<')


def is_wordform(tag: str) -> bool:
    return tag.startswith('"<')


def new_window(cohorts: list[Cohort]) -> Window:
    """A window with its synthetic first cohort."""
    w = Window()
    start = Cohort('">>>"', [Reading(['">>>"', ">>>"])])
    w.cohorts = [start, *cohorts]
    w.all = list(w.cohorts)
    for k, c in enumerate(w.cohorts):
        c.window, c.at = w, k
    return w


@dataclass
class Context:
    """What one evaluation of a rule binds."""

    target: Cohort | None = None
    reading: Reading | None = None
    mark: Cohort | None = None
    attach: Cohort | None = None
    attach_reading: Reading | None = None
    withs: list[Cohort] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    sets: dict[str, set[int]] = field(default_factory=dict)
    outer: "Context | None" = None
    matched: Cohort | None = None


@dataclass
class Options:
    num_windows: int = 2
    always_span: bool = False
    unsafe: bool = False
    no_magic: bool = False
    no_pass_origin: bool = False
    sections: int | str | None = None  # the first so many, or ranges as in 1,3-5
    rules: frozenset[str] = frozenset()
    nrules: str = ""  # patterns of the names of rules to run, and of those to leave out
    nrules_v: str = ""
    max_runs: int = 0
    dep_loops: bool = False
    dep_crossing: bool = True
    trace: bool = False
    no_before: bool = False
    no_after: bool = False
    no_sections: bool = False
    no_mappings: bool = False
    no_corrections: bool = False


#: Arguments that a grammar may give itself, and what they set.
ARGUMENTS = {
    "num-windows": "num_windows", "always-span": "always_span", "unsafe": "unsafe", "no-magic-readings": "no_magic", "no-pass-origin": "no_pass_origin",
    "sections": "sections", "nrules": "nrules", "nrules-v": "nrules_v", "max-runs": "max_runs", "single-run": "max_runs", "dep-allow-loops": "dep_loops",
    "dep-no-crossing": "dep_crossing", "trace": "trace", "no-before-sections": "no_before", "no-sections": "no_sections",
    "no-after-sections": "no_after", "no-mappings": "no_mappings", "no-corrections": "no_corrections",
}


def arguments(words: list[str]) -> dict[str, object]:
    """Option values of command line words; unknown ones raise."""
    out: dict[str, object] = {}
    rest = [w.strip('"') for x in words for w in x.split("=", 1)]
    while rest:
        word = rest.pop(0)
        name = ARGUMENTS.get(word.removeprefix("--"))
        if name is None or not word.startswith("--"):
            raise ValueError(f"unknown argument {word}")
        if word == "--single-run":
            out[name] = 1
        elif name in ("num_windows", "max_runs"):
            out[name] = int(rest.pop(0))
        elif name in ("sections", "nrules", "nrules_v"):
            out[name] = rest.pop(0)
        else:
            out[name] = name != "dep_crossing"
    return out


def with_arguments(o: Options, g: Grammar) -> Options:
    """``o`` with the grammar's own arguments: CMDARGS where ``o`` says nothing, CMDARGS-OVERRIDE in any case."""
    plain = Options()
    quiet = {k: v for k, v in arguments(g.cmdargs).items() if getattr(o, k) == getattr(plain, k)}
    return replace(o, **{**quiet, **arguments(g.cmdargs_override)})


def chosen_sections(chosen: int | str | None, n: int) -> list[int]:
    """Indices of the sections to run: all, the first so many, or those of ranges."""
    if chosen is None or chosen == 0:
        return list(range(n))
    text = str(chosen)
    if text.isdigit():
        return list(range(min(int(text), n)))
    out = []
    for part in text.split(","):
        low, _, high = part.partition("-")
        out += range(int(low) - 1, min(int(high or low), n))
    return [k for k in out if k < n]


class Restart(Exception):
    """The window changed its shape; its pass begins anew."""


# --- the applicator ---------------------------------------------------------------------------


class Applicator:
    def __init__(self, grammar: Grammar, options: Options | None = None, external=None) -> None:
        self.g, self.o = grammar, with_arguments(options or Options(), grammar)
        self.variables: dict[str, str] = {}
        self.windows: list[Window] = []
        self.at = 0
        self.next_gid = 1
        self.actions = 0  # but for new borders
        self.known: dict[int, Cohort] | None = None  # cohorts by number, where the document has no number twice
        self.external = external  # command -> function from a window to a window
        self.counts: dict[int, list[int]] = {}  # rule -> matches, failures
        self.test_counts: dict[tuple[int, int], list[int]] = {}  # rule and place of its test -> matches, failures

    # -- documents

    def run(self, windows: list[Window]) -> list[Window]:
        """Process windows in order, oldest first."""
        self.windows, self.at = list(windows), 0
        for k, w in enumerate(self.windows):
            w.at = k
        numbered = [c for w in windows for c in w.all if c.gid]
        known = {c.gid: c for c in numbered}
        self.next_gid = max(self.next_gid, max(known, default=0) + 1)
        self.known = known if len(known) == len(numbered) else None
        while self.at < len(self.windows):
            w = self.windows[self.at]
            for name in w.vars_rem:
                self.variables.pop(name, None)
            self.variables.update(w.vars_set)
            if w.ready != self.actions:
                self.prepare(w)
            self.run_window(w)
            if self.windows[self.at].flush_after:
                self.variables.clear()
            self.at += 1
        return self.windows

    def prepare(self, w: Window) -> None:
        for c in w.cohorts[1:]:
            if not c.gid:
                c.gid, self.next_gid = self.next_gid, self.next_gid + 1
                if self.known is not None:
                    self.known[c.gid] = c
            if not c.readings:
                c.readings = [magic(c)]
            c.readings = [x for r in c.readings for x in self.split_mappings(r)]
            for k, r in enumerate(c.readings):
                r.number = r.number or 1000 * (k + 1)
        self.mark_ends(w)

    def mark_ends(self, w: Window) -> None:
        for c in w.cohorts[1:]:
            last = c is w.cohorts[-1]
            for r in c.readings:
                if last and "<<<" not in r.tags:
                    r.tags.append("<<<")
                elif not last and "<<<" in r.tags:
                    r.tags.remove("<<<")

    def split_mappings(self, r: Reading) -> list[Reading]:
        """One reading per mapping tag."""
        maps = [t for t in r.tags if t.startswith(self.g.prefix) and t not in self.g.reopen]
        if not maps:
            return [r]
        rest = [t for t in r.tags if t not in maps]
        out = []
        for m in dict.fromkeys(([r.mapping] if r.mapping else []) + maps):
            copy = r.copy()
            copy.tags, copy.mapping, copy.mapped = list(rest), m, True
            out.append(copy)
        return out

    # -- scheduling

    def run_window(self, w: Window) -> None:
        self.wrap_parentheses(w)
        for _ in range(MAX_PASSES):
            try:
                self.run_passes(w)
            except Restart:
                w = self.windows[self.at]  # what a new border left of it
                continue
            if not self.unwrap_parentheses(w):
                break
        self.restore_hidden(w)

    def run_passes(self, w: Window) -> None:
        if not (self.o.no_before or self.o.no_mappings):
            self.run_rules(w, self.g.before)
        sections = [self.g.sections[k] for k in chosen_sections(self.o.sections, len(self.g.sections))]
        if not self.o.no_sections:
            for n in range(len(sections)):
                rules = [r for s in sections[: n + 1] for r in s]
                runs = 0
                while self.run_rules(w, rules):
                    runs += 1
                    if runs >= MAX_PASSES or (self.o.max_runs and runs >= self.o.max_runs):
                        break
        if not self.o.no_after:
            self.run_rules(w, self.g.after)

    def run_rules(self, w: Window, rules: list[Rule]) -> bool:
        """One pass; whether a change asks for another."""
        again, k, jumps = False, 0, 0
        while k < len(rules):
            rule = rules[k]
            k += 1
            if self.o.rules and rule.name not in self.o.rules and str(rule.number) not in self.o.rules:
                continue
            if self.o.nrules and not re.search(self.o.nrules, rule.name) or self.o.nrules_v and re.search(self.o.nrules_v, rule.name):
                continue
            if self.o.no_mappings and rule.kind in ("MAP", "ADD", "REPLACE") or self.o.no_corrections and rule.kind in ("SUBSTITUTE", "APPEND"):
                continue
            if w.enclosures and ("ENCL_FINAL" in rule.flags) != w.final_enclosure:
                continue
            while True:
                changed, jump = self.run_rule(w, rule)
                again = again or (changed and rule.iterates)
                if not (changed and "REPEAT" in rule.flags):
                    break
            if jump and jumps < MAX_PASSES:
                jumps += 1
                start = self.g.anchors.get(jump)
                k = next((i for i, r in enumerate(rules) if start is not None and r.number > start), k if start is None else len(rules))
        return again

    # -- one rule

    def run_rule(self, w: Window, rule: Rule, only: list[Cohort] | None = None, outer: Context | None = None) -> tuple[bool, str]:
        changed, jump = False, ""
        for c in w.cohorts[1:] if only is None else only:
            if c.removed or c.hidden or c.window is not w or place(w.cohorts, c) < 0:
                continue
            if not c.readings and rule.kind != "RESTORE":
                continue
            if self.skips(rule, c, w):
                continue
            did, leap = self.run_on_cohort(w, rule, c, outer)
            changed = changed or did
            jump = jump or leap
        return changed, jump

    def skips(self, rule: Rule, c: Cohort, w: Window) -> bool:
        if rule.wordform is not None and not self.match_text(rule.wordform, c.wordform):
            return True
        single = len(c.readings) == 1
        kind, flags = rule.kind, rule.flags
        if "ENCL_INNER" in flags and not self.in_enclosure(c, w) or "ENCL_OUTER" in flags and self.in_enclosure(c, w):
            return True
        safe = "UNSAFE" not in flags and not self.o.unsafe
        if kind == "SELECT" and single or kind in ("REMOVE", "IFF") and single and safe and "UNMAPLAST" not in flags:
            return not (kind == "REMOVE" and c.readings[0].noprint)
        if kind == "UNMAP" and not single and "UNSAFE" not in flags:
            return True
        if kind == "DELIMIT" and c is w.cohorts[-1]:
            return True
        if kind in ("SETPARENT",) and "SAFE" in flags and c.dep_parent is not None:
            return True
        if "NOPARENT" in flags and c.dep_parent is not None:
            return True
        return kind in ("REMPARENT", "SWITCHPARENT") and c.dep_parent is None

    def in_enclosure(self, c: Cohort, w: Window) -> bool:
        """Whether ``c`` lies in the bracketed span that was brought back last, brackets included."""
        if w.parens is None or any(x not in w.cohorts for x in w.parens):
            return False
        first, last = (w.cohorts.index(x) for x in w.parens)
        return first <= w.cohorts.index(c) <= last

    def readings_for(self, rule: Rule, c: Cohort) -> list[tuple[Reading, Reading]]:
        """(reading of the cohort, sub-reading the rule looks at)."""
        pool = c.deleted + c.delayed + c.ignored if rule.kind == "RESTORE" else list(c.readings)
        out = []
        for r in pool:
            sub = sub_reading(r, rule.sub)
            if sub is not None:
                out.append((r, sub))
        return out

    def run_on_cohort(self, w: Window, rule: Rule, c: Cohort, outer: Context | None) -> tuple[bool, str]:
        matched: list[tuple[Reading, Reading, Context]] = []
        tested = 0
        iff_matched = False
        for whole, r in self.readings_for(rule, c):
            if rule.kind in ("ADD", "MAP", "REPLACE") and r.mapped or "NOMAPPED" in rule.flags and r.mapped:
                continue
            if r.noprint and self.o.no_magic:
                continue
            if r.immutable and rule.kind not in ("UNPROTECT", "SETVARIABLE", "REMVARIABLE", "JUMP", "WITH"):
                continue
            tested += 1
            ctx = Context(target=c, reading=r, outer=outer)
            if outer is not None and "CAPTURE_UNIF" in rule.flags:
                ctx.tags, ctx.sets, ctx.captures = dict(outer.tags), dict(outer.sets), list(outer.captures)
            if not self.match_set(rule.target, r, c, ctx):
                continue
            ctx.withs = []
            good = self.tests_of_rule(rule, c, ctx)
            if rule.kind == "IFF":
                iff_matched = iff_matched or good
                matched.append((whole, r, ctx))
            elif good:
                matched.append((whole, r, ctx))
        counts = self.counts.setdefault(rule.number, [0, 0])
        counts[0 if matched else 1] += 1
        if not matched:
            return False, ""
        return self.act(w, rule, c, matched, iff_matched)

    def tests_of_rule(self, rule: Rule, c: Cohort, ctx: Context) -> bool:
        """All tests in order; each starts with the mark on the target unless the rule remembers marks."""
        for k, t in enumerate(rule.tests):
            if "RESETX" in rule.flags or "REMEMBERX" not in rule.flags:
                ctx.mark = None
            good = self.test_of_rule(t, c, ctx)
            self.test_counts.setdefault((rule.number, k), [0, 0])[0 if good != t.has("NEGATE") else 1] += 1
            if not good:
                return False
        return True

    def test_of_rule(self, t: Test, c: Cohort, ctx: Context) -> bool:
        found = self.run_test(t, c, ctx)
        if found is not None and not t.has("NEGATE", "NOT", "NONE"):
            ctx.withs.append(ctx.matched or found)
        ctx.matched = None
        return found is not None

    # -- tags and sets

    def match_text(self, tag: Tag, text: str) -> bool:
        if tag.kind in ("regex", "line"):
            return tag.regex().search(text) is not None
        if tag.kind == "icase":
            return tag.text.casefold() == text.casefold()
        if tag.kind == "anyform":
            return True
        return tag.text == text

    def match_tag(self, tag: Tag, r: Reading, c: Cohort, ctx: Context) -> str | None:
        """The text that matched, or None."""
        kind = tag.kind
        tags = r.all_tags()
        if kind == "plain":
            return tag.text if tag.text in tags or tag.text == c.wordform or tag.text in c.static else None
        if kind == "any":
            return "*"
        if kind == "set":
            return tag.text if self.match_set(TagSet("name", name=tag.key), r, c, ctx) else None
        if kind == "varstring":
            made = parse_tag(expand(tag.value, ctx.captures, lambda name: self.tags_of(TagSet("name", name=name), r, c, ctx)))
            return self.match_tag(made, r, c, ctx)
        if kind == "meta":
            m = tag.regex().search(c.text)
            if m:
                ctx.captures = [x or "" for x in m.groups()]
            return c.text if m else None
        pool = [c.wordform, *tags, *c.static]
        if kind == "regex":
            for t in pool:
                m = tag.regex().search(t)
                if m:
                    if m.groups():
                        ctx.captures = [x or "" for x in m.groups()]
                    return t
            return None
        if kind == "line":
            m = tag.regex().search(" ".join(pool))
            if m and m.groups():
                ctx.captures = [x or "" for x in m.groups()]
            return m[0] if m else None
        if kind == "icase":
            low = tag.text.casefold()
            return next((t for t in pool if t.casefold() == low), None)
        if kind == "anyform":
            return next((t for t in pool if t.startswith(('"', "<")) and (tag.text[:2] == '"<') == t.startswith('"<')), None)
        if kind == "numeric":
            return self.match_numeric(tag, r, c)
        if kind in ("var", "lvar"):
            pool_vars = self.variables if kind == "var" else (c.window.vars_set if c.window else {})
            return tag.text if match_variable(tag, pool_vars) else None
        return self.match_special(tag, r, c, ctx)

    def match_numeric(self, tag: Tag, r: Reading, c: Cohort) -> str | None:
        bounds = lambda: extremes(c, tag.key)
        want = evaluate(tag.value, bounds)
        found = None
        for t, key, op, value in numeric_tags(r.all_tags()):
            if key == tag.key and want is not None:
                found = t if compare(tag.op, want, op, value) else None  # the last tag of the key decides
        return found

    def match_special(self, tag: Tag, r: Reading, c: Cohort, ctx: Context) -> str | None:
        name, good = tag.text, False
        w = c.window
        if name == "_TARGET_":
            good = c is (ctx.outer or ctx).target
        elif name == "_MARK_":
            good = c is (ctx.mark or ctx.target)
        elif name == "_ATTACHTO_":
            good = c is ctx.attach
        elif name in ("_LEFT_", "_RIGHT_", "_PAREN_"):
            pair = w.parens if w else None
            good = pair is not None and (c is pair[0] and name != "_RIGHT_" or c is pair[1] and name != "_LEFT_")
        elif name == "_ENCL_" and w:
            k = w.all.index(c)
            good = k + 1 < len(w.all) and w.all[k + 1].enclosed > 0
        elif name == "_SAME_BASIC_":
            good = ctx.reading is not None and sorted(ctx.reading.tags) == sorted(r.tags)
        elif re.fullmatch("_C[1-9]_", name):
            outer = ctx.outer or ctx
            k = int(name[2]) - 1
            good = k < len(outer.withs) and outer.withs[k] is c
        return name if good else None

    def match_set(self, s: TagSet, r: Reading, c: Cohort, ctx: Context) -> bool:
        op = s.op
        if op == "list":
            return self.match_list(s, r, c, ctx) is not None
        if op == "name":
            if s.name in self.g.sets:
                return self.match_set(self.g.sets[s.name], r, c, ctx)
            return self.match_tag(parse_tag(s.name), r, c, ctx) is not None
        if op == "or":
            for part in s.parts:
                if part.op == "^":
                    if self.match_set(part.parts[1], r, c, ctx):
                        return False  # fail-fast: later arms are not tried
                    if self.match_set(part.parts[0], r, c, ctx):
                        return True
                elif self.match_set(part, r, c, ctx):
                    return True
            return False
        if op == "+":
            return self.match_set(s.parts[0], r, c, ctx) and self.match_set(s.parts[1], r, c, ctx)
        if op in ("-", "^"):
            return self.match_set(s.parts[0], r, c, ctx) and not self.match_set(s.parts[1], r, c, ctx)
        if op == "unify_tag":
            return self.unify_tag(s.name, r, c, ctx)
        return self.unify_set(s.name, r, c, ctx)

    def match_list(self, s: TagSet, r: Reading, c: Cohort, ctx: Context) -> tuple[str, ...] | None:
        """The texts of the first matching tuple."""
        for member in s.members:
            for t in member:
                if t.failfast and self.match_tag(t, r, c, ctx) is not None:
                    return None
        for member in s.members:
            found = []
            for t in member:
                if t.failfast:
                    continue
                hit = self.match_tag(t, r, c, ctx)
                if hit is None:
                    break
                found.append(hit)
            else:
                if found:
                    return tuple(found)
        return None

    def unify_tag(self, name: str, r: Reading, c: Cohort, ctx: Context) -> bool:
        bare = re.sub(r"^\d+:", "", name)
        source = self.g.sets.get(bare, TagSet("list", ((parse_tag(bare),),)))
        bound = ctx.tags.get(name)
        for s in flat_lists(source, self.g):
            for member in s.members:
                hit = self.match_list(TagSet("list", (member,)), r, c, ctx)
                if hit is not None and (bound is None or hit == bound):
                    ctx.tags[name] = hit
                    return self.match_set(source, r, c, ctx)
        return False

    def unify_set(self, name: str, r: Reading, c: Cohort, ctx: Context) -> bool:
        bare = re.sub(r"^\d+:", "", name)
        source = self.g.sets[bare]
        parts = source.parts if source.op == "or" else (source,)
        hits = {k for k, p in enumerate(parts) if self.match_set(p, r, c, ctx)}
        if name in ctx.sets:
            hits &= ctx.sets[name]
        if hits:
            ctx.sets[name] = hits
        return bool(hits)

    def tags_of(self, s: TagSet, r: Reading | None, c: Cohort | None, ctx: Context) -> list[str]:
        """The tags a set stands for in an action."""
        if s.op == "unify_tag" and s.name in ctx.tags:
            return list(ctx.tags[s.name])
        out: list[str] = []
        for part in flat_lists(s, self.g):
            for t in part.tags():
                if t.kind == "varstring":
                    out.append(expand(t.value, ctx.captures, lambda n: self.tags_of(TagSet("name", name=n), r, c, ctx)))
                elif t.kind in ("regex", "icase", "anyform", "line") and r is not None and c is not None:
                    hit = self.match_tag(t, r, c, ctx)
                    if hit is not None:
                        out.append(hit)
                else:
                    out.append(t.text)
        return out

    # -- tests

    def live(self, w: Window) -> list[Cohort]:
        return w.cohorts

    def step(self, c: Cohort, by: int, t: Test) -> Cohort | None:
        """The cohort ``by`` steps away, across windows where the test may span them."""
        w = c.window
        assert w is not None
        k = place(w.cohorts, c)
        if k < 0:
            raise ValueError("a test starts at a cohort outside its window")
        k += by
        if 0 <= k < len(w.cohorts):
            return w.cohorts[k]
        here = place(self.windows, w)
        here = self.at if here < 0 else here
        while True:
            if 0 <= k < len(w.cohorts):
                return w.cohorts[k]
            right = k >= len(w.cohorts)
            if not (self.o.always_span or t.has("span") or (t.has("span_right") if right else t.has("span_left"))):
                return None
            if right:
                k -= len(w.cohorts)
                here += 1
            else:
                here -= 1
            if not 0 <= here < len(self.windows) or abs(here - self.at) > self.o.num_windows:
                return None
            w = self.windows[here]
            if right:
                k += 1  # the next window's synthetic cohort isn't stepped on
            else:
                k += len(w.cohorts)
                if k == 0:
                    k = -1

    def run_test(self, t: Test, c: Cohort, ctx: Context, origin: Cohort | None = None, deep: bool = True) -> Cohort | None:
        """The cohort at which the whole chain succeeded, or None."""
        origin = origin or c
        if t.ors or t.template:
            arms = t.ors or (self.g.templates[t.template],)
            found = None
            for arm in arms:
                if t.template and (t.flags or t.offset or t.target or t.barrier or t.cbarrier):
                    arm = override(arm, t)
                saved = dict(ctx.tags), dict(ctx.sets)
                found = self.run_test(arm, c, ctx, origin)
                if found is not None:
                    break
                ctx.tags, ctx.sets = saved
            if t.has("NEGATE", "NOT", "NONE"):
                found = c if found is None else None
            if found is not None and t.link:
                return self.run_test(t.link, found, ctx, origin)
            return found
        if t.has("NEGATE"):
            inner = Test(**{**t.__dict__, "flags": t.flags - {"NEGATE"}})
            saved = list(ctx.withs), ctx.mark, ctx.matched
            found = self.run_test(inner, c, ctx, origin)
            ctx.withs, ctx.mark, ctx.matched = saved
            return None if found is not None else c
        start = {"M": ctx.mark or ctx.target, "A": ctx.attach or ctx.target, "T": (ctx.outer or ctx).target}.get(t.jump, c)
        if t.jump.startswith("C"):
            withs = (ctx.outer or ctx).withs
            k = int(t.jump[1]) - 1
            start = withs[k] if k < len(withs) else None
        if t.has("mark_jump"):
            start = ctx.mark or ctx.target
        if start is None:
            return None
        c = start
        if t.has("bag"):
            return self.test_bag(t, c, ctx, origin)
        if t.relation:
            return self.over(t, self.related(t, c, ctx), c, ctx, origin)
        if t.has("parent", "ancestor", "child", "descendant", "sibling"):
            return self.over(t, self.dependents(t, c), c, ctx, origin)
        if t.has("left_par", "right_par"):
            pair = c.window.parens if c.window else None
            there = None if pair is None else pair[0 if t.has("left_par") else 1]
            return self.over(t, [] if there is None else [there], c, ctx, origin)
        if t.has("absolute"):
            n = len(c.window.cohorts) if c.window else 0
            k = t.offset if t.offset >= 0 else n + t.offset
            first = c.window.cohorts[k] if c.window and 0 <= k < n else None
        else:
            first = self.step(c, t.offset, t) if t.offset else c
        if not t.has("scan", "scan_all"):
            return self.single(t, first, c, ctx, origin)
        if t.offset == 0 and not t.has("absolute"):
            return self.scan_both(t, c, ctx, origin)
        return self.scan(t, first, -1 if t.offset < 0 else 1, c, ctx, origin)

    def single(self, t: Test, there: Cohort | None, c: Cohort, ctx: Context, origin: Cohort) -> Cohort | None:
        if there is None:
            return c if t.has("NOT", "NONE") and t.link is None else None
        found, _ = self.at_cohort(t, there, ctx, origin)
        return found

    def scan(self, t: Test, there: Cohort | None, by: int, c: Cohort, ctx: Context, origin: Cohort) -> Cohort | None:
        if t.has("self"):
            found, stop = self.at_cohort(t, c, ctx, origin, barriers=not t.has("nobarrier"))
            if found is not None or stop:
                return found
        seen, last = False, None
        while there is not None:
            if there is origin and there is not c and (self.o.no_pass_origin or t.has("no_origin")) and not t.has("pass_origin"):
                break
            seen = True
            last, stop = self.at_cohort(t, there, ctx, origin)
            if t.has("NOT", "NONE"):
                if last is None:
                    return None
                if stop:
                    return last
            elif t.has("ALL"):
                if last is None:
                    return None
                if stop:
                    return last
            elif last is not None or stop:
                return last
            there = self.step(there, by, t)
        if t.has("NOT", "NONE") and (seen or t.link is None):
            return last or c
        return last if t.has("ALL") and seen else None

    def scan_both(self, t: Test, c: Cohort, ctx: Context, origin: Cohort) -> Cohort | None:
        if t.has("self"):
            found, stop = self.at_cohort(t, c, ctx, origin, barriers=not t.has("nobarrier"))
            if found is not None or stop:
                return found
        sides: list[Cohort | None] = [self.step(c, -1, t), self.step(c, 1, t)]
        while any(x is not None for x in sides):
            for k, by in ((0, -1), (1, 1)):
                there = sides[k]
                if there is None:
                    continue
                found, stop = self.at_cohort(t, there, ctx, origin)
                if t.has("NOT", "NONE"):
                    if found is None:
                        return None
                elif found is not None:
                    return found
                sides[k] = None if stop else self.step(there, by, t)
        return c if t.has("NOT", "NONE") else None

    def at_cohort(self, t: Test, there: Cohort, ctx: Context, origin: Cohort, barriers: bool = True) -> tuple[Cohort | None, bool]:
        """(where the chain ended, whether a scan stops here)."""
        saved = dict(ctx.tags), dict(ctx.sets)
        hit = self.match_cohort(t, there, ctx)
        negated = t.has("NOT", "NONE")
        good = not hit if negated else hit
        stop = hit and t.has("scan") and not negated
        found: Cohort | None = None
        if good:
            if t.has("mark_set"):
                ctx.mark = there
            if t.has("attach"):
                ctx.attach = there
            if t.has("with"):
                ctx.matched = there
            if t.link is None:
                found = there
            else:
                found = self.run_test(t.link, there, ctx, origin)
        if found is None:
            ctx.tags, ctx.sets = saved
        if barriers and t.barrier is not None and any(self.match_set(t.barrier, r, there, ctx) for r in there.readings):
            stop = True
        if barriers and t.cbarrier is not None and there.readings and all(self.match_set(t.cbarrier, r, there, ctx) for r in there.readings):
            stop = True
        return found, stop

    def match_cohort(self, t: Test, c: Cohort, ctx: Context) -> bool:
        if t.target is None:
            return True
        pool = list(c.readings)
        if t.has("look_deleted"):
            pool += c.deleted
        if t.has("look_delayed"):
            pool += c.delayed
        if t.has("look_ignored"):
            pool += c.ignored
        if t.has("active"):
            pool = [r for r in pool if r.active]
        if t.has("inactive"):
            pool = [r for r in pool if not r.active]
        looked = [x for x in (sub_reading(r, t.sub) for r in pool) if x is not None]
        if t.has("careful"):
            return bool(looked) and all(self.match_set(t.target, r, c, ctx) for r in looked)
        for r in looked:
            if self.match_set(t.target, r, c, ctx):
                if t.has("attach"):
                    ctx.attach_reading = r
                return True
        return False

    def test_bag(self, t: Test, c: Cohort, ctx: Context, origin: Cohort) -> Cohort | None:
        assert c.window is not None
        here = self.windows.index(c.window) if c.window in self.windows else self.at
        reach = self.o.num_windows if self.o.always_span or t.has("span", "span_left", "span_right") else 0
        low = here - (reach if not t.has("span_right") else 0)
        high = here + (reach if not t.has("span_left") else 0)
        tags = {x for w in self.windows[max(0, low) : high + 1] for o in w.cohorts for r in o.readings for x in (o.wordform, *r.all_tags())}
        bag = Cohort(c.wordform, [Reading(sorted(tags))], window=c.window)
        hit = t.target is None or self.match_set(t.target, bag.readings[0], bag, ctx)
        if hit == t.has("NOT", "NONE"):
            return None
        return self.run_test(t.link, c, ctx, origin) if t.link else c

    def over(self, t: Test, there: list[Cohort], c: Cohort, ctx: Context, origin: Cohort) -> Cohort | None:
        """Tests over a set of cohorts, nearest first."""
        if t.has("self"):
            there = [c, *there]
        if t.has("NOT", "NONE"):
            plain = Test(**{**t.__dict__, "flags": t.flags - {"NOT", "NONE", "self"}})
            return None if any(self.at_cohort(plain, x, ctx, origin)[0] is not None for x in there) else c
        last = None
        for x in there:
            found, stop = self.at_cohort(t, x, ctx, origin)
            if t.has("ALL"):
                if found is None:
                    return None
                last = found
            elif found is not None:
                return found
            elif stop and not t.has("scan"):
                return None
        return last

    def by_gid(self, gid: int | None, near: Window | None = None) -> Cohort | None:
        if gid is None:
            return None
        if gid == 0:
            return near.cohorts[0] if near else None
        if self.known is not None:
            x = self.known.get(gid)
            if x is not None and x.gid == gid and not x.removed and self.order(x, near) is not None:
                return x
        for w in ([near] if near else []) + self.windows:
            for x in w.cohorts:
                if x.gid == gid and not x.removed:
                    if self.known is not None:
                        self.known[gid] = x
                    return x
        return None

    def order(self, c: Cohort, near: Window | None = None) -> tuple[int, int] | None:
        """The places of a cohort's window and of the cohort in it, or None where it is in no window of the document, nor in ``near``."""
        if c.window is None:
            return None
        here, k = place(self.windows, c.window), place(c.window.cohorts, c)
        return (here, k) if k >= 0 and (here >= 0 or c.window is near) else None

    def children(self, c: Cohort, t: Test | None = None) -> list[Cohort]:
        ws = self.windows if t is not None and (self.o.always_span or t.has("span", "span_left", "span_right")) else [c.window]
        return [x for w in ws if w for x in w.cohorts[1:] if x.dep_parent == c.gid and x is not c and not x.removed]

    def dependents(self, t: Test, c: Cohort) -> list[Cohort]:
        deep = t.has("scan", "scan_all")
        order = {x: k for k, x in enumerate(x for w in self.windows for x in w.cohorts)}
        seen: list[Cohort] = []
        if t.has("parent", "ancestor"):
            at = self.by_gid(c.dep_parent, c.window)
            while at is not None and at not in seen and at is not c:
                seen.append(at)
                if not (deep or t.has("ancestor")):
                    break
                at = self.by_gid(at.dep_parent, c.window) if at.gid else None
            if t.has("ancestor"):
                seen.sort(key=order.__getitem__)
        elif t.has("sibling"):
            seen = [x for w in [c.window] if w for x in w.cohorts[1:] if c.dep_parent is not None and x.dep_parent == c.dep_parent and x is not c]
        else:
            level = self.children(c, t)
            while level:
                seen += [x for x in level if x not in seen]
                level = [y for x in level for y in self.children(x, t) if y not in seen and y is not c] if deep or t.has("descendant") else []
            if t.has("descendant"):
                seen.sort(key=order.__getitem__)
        here = order.get(c, -1)
        if t.has("left", "leftmost"):
            seen = sorted((x for x in seen if order[x] < here), key=order.__getitem__, reverse=not t.has("leftmost"))
        if t.has("right", "rightmost"):
            seen = sorted((x for x in seen if order[x] > here), key=order.__getitem__, reverse=t.has("rightmost"))
        return seen

    def related(self, t: Test, c: Cohort, ctx: Context) -> list[Cohort]:
        want = parse_tag(t.relation)
        gids: set[int] = set()
        for name, targets in c.relations.items():
            if t.relation == "*" or self.match_text(want, name):
                gids |= targets
        places = {x: at for x in (self.by_gid(g, c.window) for g in gids) if x is not None and (at := self.order(x)) is not None}
        found = sorted(places, key=places.__getitem__)
        here = self.order(c) or (-1, -1)
        if t.has("left", "leftmost"):
            found = [x for x in found if places[x] < here]
        if t.has("right", "rightmost"):
            found = [x for x in found if places[x] > here]
        if t.has("leftmost"):
            found = found[:1]
        if t.has("rightmost"):
            found = found[-1:]
        return found

    # -- actions

    def act(self, w: Window, rule: Rule, c: Cohort, matched: list, iff_matched: bool) -> tuple[bool, str]:
        kind = rule.kind
        self.actions += kind != "DELIMIT"
        if kind == "IFF":
            kind = "SELECT" if iff_matched else "REMOVE"
        if kind in ("SELECT", "REMOVE"):
            return self.select_or_remove(kind, rule, c, [x[0] for x in matched]), ""
        if kind == "JUMP":
            return False, self.tags_of(rule.maplist or rule.target, None, None, matched[0][2])[0]
        each = {"ADD": self.add_map, "MAP": self.add_map, "REPLACE": self.replace, "SUBSTITUTE": self.substitute, "COPY": self.copy,
                "UNMAP": self.unmap, "PROTECT": self.protect, "UNPROTECT": self.protect}.get(kind)
        if each is not None:
            changed = [each(rule, c, whole, r, ctx) for whole, r, ctx in matched]
            return any(changed), ""
        whole, r, ctx = matched[0]
        if kind == "RESTORE":
            return self.restore(rule, c, [x[0] for x in matched]), ""
        if kind == "APPEND":
            return self.append(rule, c, r, ctx), ""
        if kind in ("SETVARIABLE", "REMVARIABLE"):
            return self.variable(rule, c, r, ctx), ""
        if kind in ("EXECUTE",):
            r.hit_by.append(rule.number)
            return False, ""
        if kind == "WITH":
            changed = False
            for inner in rule.nested:
                done, _ = self.run_rule(w, inner, [c, *[x for x in ctx.withs if x.window is w and x is not c]], ctx)
                changed = changed or done
            return changed, ""
        if kind == "EXTERNAL":
            if self.external is None:
                raise ValueError("EXTERNAL needs a function for its command")
            if rule.mode == "ONCE":
                if rule.number in w.called:
                    return False, ""
                w.called.add(rule.number)
            self.known = None  # it may change whatever it likes
            return bool(self.external(rule.command, w)), ""
        act = getattr(self, "do_" + kind.lower().rstrip("s") if kind.endswith("RELATIONS") else "do_" + kind.lower())
        return bool(act(w, rule, c, r, ctx)), ""

    def select_or_remove(self, kind: str, rule: Rule, c: Cohort, hit: list[Reading]) -> bool:
        if kind == "SELECT":
            gone = [r for r in c.readings if r not in hit and not r.immutable]
            for r in hit:
                r.hit_by.append(rule.number)
        else:
            gone = list(hit)
        if not gone:
            return False
        if len(gone) == len(c.readings):
            if kind == "REMOVE" and "UNMAPLAST" in rule.flags:
                return any([unmap_reading(r) for r in gone])
            if kind == "SELECT" or not ("UNSAFE" in rule.flags or self.o.unsafe or all(r.noprint for r in gone)):
                return False
        for r in gone:
            r.hit_by.append(rule.number)
        c.readings = [r for r in c.readings if r not in gone]
        place = c.delayed if "DELAYED" in rule.flags else c.ignored if "IGNORED" in rule.flags else c.deleted
        place += gone
        if not c.readings:
            c.readings = [magic(c)]
        return True

    def add_tags(self, r: Reading, tags: list[str], side: str, near: set[str]) -> list[Reading]:
        """Tags put in; one reading per mapping tag."""
        maps = [t for t in tags if t.startswith(self.g.prefix)]
        plain = [t for t in tags if not t.startswith(self.g.prefix) and t != "*"]
        at = len(r.tags)
        if "<<<" in r.tags:
            at = r.tags.index("<<<")
        if side:
            places = [k for k, t in enumerate(r.tags) if t in near]
            if places:
                at = places[0] if side == "BEFORE" else places[-1] + 1
        new = [t for t in plain if t not in r.tags]
        base = [t for t in new if is_base(t)]
        new = [t for t in new if not is_base(t)]
        r.tags[at:at] = new
        if base:
            set_base(r, base[0])
        out = [r]
        if maps:
            r.mapping = maps[0]
            for m in maps[1:]:
                extra = r.copy()
                extra.mapping = m
                out.append(extra)
        return out

    def near(self, rule: Rule) -> set[str]:
        return {t.text for s in flat_lists(rule.place, self.g) for t in s.tags()} if rule.place else set()

    def add_map(self, rule: Rule, c: Cohort, whole: Reading, r: Reading, ctx: Context) -> bool:
        before = (list(r.tags), r.mapping, len(c.readings))
        tags = self.tags_of(rule.maplist or rule.target, r, c, ctx)
        made = self.add_tags(r, tags, rule.side, self.near(rule))
        r.noprint = False
        for x in made:
            x.mapped = x.mapped or rule.kind == "MAP" or bool(x.mapping and rule.kind == "MAP")
            x.hit_by.append(rule.number)
        if len(made) > 1 and whole is r:
            k = c.readings.index(whole)
            c.readings[k + 1 : k + 1] = made[1:]
        return before != (r.tags, r.mapping, len(c.readings))

    def replace(self, rule: Rule, c: Cohort, whole: Reading, r: Reading, ctx: Context) -> bool:
        before = list(r.tags), r.mapping
        tags = self.tags_of(rule.maplist or rule.target, r, c, ctx)
        keep = set(self.tags_of(rule.except_list, r, c, ctx)) if rule.except_list else set()
        end = ["<<<"] if "<<<" in r.tags else []
        base = next((t for t in tags if is_base(t)), r.base)
        r.tags, r.mapping = ([base] if base else []) + [t for t in r.tags if t in keep and t != base], ""
        self.add_tags(r, [t for t in tags if not is_base(t)], "", set())
        r.tags += end
        r.noprint = False
        r.hit_by.append(rule.number)
        return before != (r.tags, r.mapping)

    def substitute(self, rule: Rule, c: Cohort, whole: Reading, r: Reading, ctx: Context) -> bool:
        old = self.tags_of(rule.sublist or rule.target, r, c, ctx)
        new = [t for t in self.tags_of(rule.maplist or rule.target, r, c, ctx) if t != "*"]
        before = list(r.tags), r.mapping, c.wordform
        forms = [t for t in new if is_wordform(t)]
        if forms and c.wordform in old:
            c.wordform = forms[0]
            old, new = [t for t in old if not is_wordform(t)], [t for t in new if not is_wordform(t)]
            if not old:
                r.hit_by.append(rule.number)
                return True
        if old == ["*"]:
            self.add_tags(r, new, "", set())
        else:
            if r.mapping in old:
                r.mapping = ""
            places = [k for k, t in enumerate(r.tags) if t in old]
            if not places and before[1] == r.mapping:
                return False
            at = places[0] if places else len(r.tags)
            rest = [t for t in r.tags if t not in old]
            at -= sum(1 for k in places if k < at)
            r.tags = rest[:at] + [t for t in new if not t.startswith(self.g.prefix) and t not in rest] + rest[at:]
            maps = [t for t in new if t.startswith(self.g.prefix)]
            if maps:
                r.mapping = maps[0]
        r.noprint = False
        changed = before != (r.tags, r.mapping, c.wordform)
        if changed:
            r.hit_by.append(rule.number)
        return changed

    def copy(self, rule: Rule, c: Cohort, whole: Reading, r: Reading, ctx: Context) -> bool:
        extra = whole.copy()
        sub = extra if whole is r else extra.chain()[whole.chain().index(r)]
        drop = set(self.tags_of(rule.except_list, r, c, ctx)) if rule.except_list else set()
        sub.tags = [t for t in sub.tags if t not in drop]
        if sub.mapping in drop:
            sub.mapping = ""
        made = self.add_tags(sub, self.tags_of(rule.maplist or rule.target, r, c, ctx), rule.side, self.near(rule))
        sub.hit_by.append(rule.number)
        for x in [extra, *made[1:]]:
            x.number = whole.number + 1
            x.noprint = False
            c.readings.append(x)
        c.readings.sort(key=lambda x: x.number)
        return True

    def append(self, rule: Rule, c: Cohort, r: Reading, ctx: Context) -> bool:
        tags = self.tags_of(rule.maplist or rule.target, r, c, ctx)
        groups: list[list[str]] = []
        for t in tags:
            if is_base(t):
                groups.append([])
            elif not groups:
                raise ValueError("APPEND needs a base form first")
            groups[-1].append(t)
        for g in groups:
            new = Reading(g[:1], hit_by=[rule.number], number=max((x.number for x in c.readings), default=0) + 1000)
            c.readings += self.add_tags(new, g[1:], "", set())
        c.readings = [x for x in c.readings if not x.noprint] or c.readings
        if c.window:
            self.mark_ends(c.window)
        return bool(groups)

    def unmap(self, rule: Rule, c: Cohort, whole: Reading, r: Reading, ctx: Context) -> bool:
        done = unmap_reading(r)
        if done:
            r.hit_by.append(rule.number)
        return done

    def protect(self, rule: Rule, c: Cohort, whole: Reading, r: Reading, ctx: Context) -> bool:
        want = rule.kind == "PROTECT"
        changed, r.immutable = r.immutable != want, want
        return changed

    def restore(self, rule: Rule, c: Cohort, hit: list[Reading]) -> bool:
        want = rule.maplist or rule.target
        back = []
        for name in ("deleted", "delayed", "ignored"):
            if name == "delayed" and "DELAYED" not in rule.flags and ("IGNORED" in rule.flags):
                continue
            pool = getattr(c, name)
            take = [r for r in pool if r in hit and self.match_set(want, r, c, Context(target=c))]
            setattr(c, name, [r for r in pool if r not in take])
            back += take
        for r in back:
            r.hit_by.append(rule.number)
        c.readings = sorted([r for r in c.readings if not (back and r.noprint)] + back, key=lambda r: r.number)
        return bool(back)

    def variable(self, rule: Rule, c: Cohort, r: Reading, ctx: Context) -> bool:
        if rule.kind == "SETVARIABLE":
            names = self.tags_of(rule.sublist or rule.target, r, c, ctx)
            values = self.tags_of(rule.maplist or rule.target, r, c, ctx)
            value = values[0] if values else "*"
            changed = self.variables.get(names[0]) != value
            self.variables[names[0]] = value
            if "OUTPUT" in rule.flags and c.window:
                c.window.vars_out[names[0]] = value
            return changed
        names = self.tags_of(rule.maplist or rule.target, r, c, ctx)
        changed = names[0] in self.variables
        self.variables.pop(names[0], None)
        if "OUTPUT" in rule.flags and c.window:
            c.window.vars_out.pop(names[0], None)
        return changed

    # -- dependencies and relations

    def candidates(self, rule: Rule, c: Cohort, ctx: Context) -> Iterator[Cohort]:
        """Cohorts that the first closing test leads to, one after the other."""
        if not rule.dep_tests:
            return
        seen: list[Cohort] = []
        first, at = rule.dep_tests[0], c
        while True:
            inner = Context(target=c, reading=ctx.reading, mark=ctx.mark, tags=dict(ctx.tags), sets=dict(ctx.sets), captures=list(ctx.captures), outer=ctx.outer)
            found = self.run_test(first, at, inner, c)
            found = inner.attach or found
            if found is None or found in seen:
                return
            seen.append(found)
            if all(self.run_test(t, found, Context(target=c, reading=ctx.reading, mark=ctx.mark)) is not None for t in rule.dep_tests[1:]):
                yield found
            if "NEAREST" in rule.flags or not first.has("scan", "scan_all"):
                return
            if first.offset == 0:
                return
            at = found

    def attach(self, child: Cohort, parent: Cohort, rule: Rule) -> bool:
        if parent is child:
            return False
        if not self.o.dep_loops and "ALLOWLOOP" not in rule.flags and child.gid in self.ancestry(parent):
            return False
        if not self.o.dep_crossing and "ALLOWCROSS" not in rule.flags and self.crosses(child, parent):
            return False
        child.dep_parent = parent.gid
        return True

    def ancestry(self, c: Cohort) -> set[int]:
        out: set[int] = set()
        at: Cohort | None = c
        while at is not None and at.gid and at.gid not in out:
            out.add(at.gid)
            at = self.by_gid(at.dep_parent, c.window)
        return out

    def crosses(self, child: Cohort, parent: Cohort) -> bool:
        if child.window is None or child.window is not parent.window:
            return False
        place = {x.gid: k for k, x in enumerate(child.window.cohorts)}
        low, high = sorted((place[child.gid], place.get(parent.gid, 0)))
        for x in child.window.cohorts[1:]:
            if x.dep_parent is None or x.dep_parent not in place or x is child:
                continue
            a, b = sorted((place[x.gid], place[x.dep_parent]))
            if a < low < b < high or low < a < high < b:
                return True
        return False

    def do_setparent(self, w, rule, c, r, ctx) -> bool:
        for there in self.candidates(rule, c, ctx):
            child, parent = (there, c) if "REVERSE" in rule.flags else (c, there)
            if child.dep_parent == parent.gid:
                return False
            if self.attach(child, parent, rule):
                r.hit_by.append(rule.number)
                return True
        return False

    def do_setchild(self, w, rule, c, r, ctx) -> bool:
        for there in self.candidates(rule, c, ctx):
            child, parent = (c, there) if "REVERSE" in rule.flags else (there, c)
            if child.dep_parent == parent.gid:
                return False
            if self.attach(child, parent, rule):
                r.hit_by.append(rule.number)
                return True
        return False

    def do_remparent(self, w, rule, c, r, ctx) -> bool:
        c.dep_parent = None
        r.hit_by.append(rule.number)
        return True

    def do_switchparent(self, w, rule, c, r, ctx) -> bool:
        parent = self.by_gid(c.dep_parent, w)
        if parent is None or not parent.gid:
            return False
        c.dep_parent, parent.dep_parent = parent.dep_parent, c.gid
        r.hit_by.append(rule.number)
        return True

    def relation_edges(self, rule: Rule, c: Cohort, ctx: Context, r: Reading) -> Iterator[tuple[Cohort, str, Cohort]]:
        first = self.tags_of(rule.sublist or rule.maplist or rule.target, r, c, ctx)
        second = self.tags_of(rule.maplist, r, c, ctx) if rule.sublist and rule.maplist else []
        for there in self.candidates(rule, c, ctx):
            source, target = (there, c) if "REVERSE" in rule.flags else (c, there)
            for name in first:
                yield source, name, target
            for name in second:
                yield target, name, source
            return

    def do_addrelation(self, w, rule, c, r, ctx) -> bool:
        changed = False
        for source, name, target in self.relation_edges(rule, c, ctx, r):
            got = source.relations.setdefault(name, set())
            changed = changed or target.gid not in got
            got.add(target.gid)
        return changed

    def do_setrelation(self, w, rule, c, r, ctx) -> bool:
        changed = False
        for source, name, target in self.relation_edges(rule, c, ctx, r):
            changed = changed or source.relations.get(name) != {target.gid}
            source.relations[name] = {target.gid}
        return changed

    def do_remrelation(self, w, rule, c, r, ctx) -> bool:
        changed = False
        for source, name, target in self.relation_edges(rule, c, ctx, r):
            got = source.relations.get(name, set())
            changed = changed or target.gid in got
            got.discard(target.gid)
            if not got:
                source.relations.pop(name, None)
        return changed

    # -- restructuring

    def do_delimit(self, w, rule, c, r, ctx) -> bool:
        """The window goes on with what follows ``c``, as that may be long; what is before becomes a window of its own."""
        k = place(w.cohorts, c) + 1
        if k == len(w.cohorts):
            return False
        r.hit_by.append(rule.number)
        n = w.all.index(c) + 1
        before = replace(w, cohorts=w.cohorts[:k], all=w.all[:n], text_post="", flush_after=False)
        for x in before.all:
            x.window = before
        fresh = new_window([])
        start = fresh.cohorts[0]
        w.cohorts[:k], w.all[:n], start.window = [start], [start], w
        for name in ("text", "vars_set", "vars_rem", "vars_out", "parens", "final_enclosure", "enclosures", "called"):
            setattr(w, name, getattr(fresh, name))
        w.ready = -1 if self.g.parentheses else self.actions
        before.at = place(self.windows, w)
        self.windows.insert(before.at, before)
        w.at = before.at + 1
        self.mark_ends(before)
        raise Restart

    def subtree(self, c: Cohort, child: TagSet | None) -> list[Cohort]:
        """A cohort and, where a set is given, the descendants through children that match it, in order."""
        got, queue = {c}, [c]
        while queue and child is not None:
            at = queue.pop()
            for x in self.children(at):
                if x not in got and any(self.match_set(child, r, x, Context(target=c)) for r in x.readings):
                    got.add(x)
                    queue.append(x)
        return [x for x in (c.window.cohorts if c.window else []) if x in got]

    def do_remcohort(self, w, rule, c, r, ctx) -> bool:
        gone = self.subtree(c, rule.child) if "WITHCHILD" in rule.flags else [c]
        hidden = "IGNORED" in rule.flags
        if hidden and "WITHCHILD" not in rule.flags:
            gone = self.subtree(c, TagSet("list", ((Tag("*", "any"),),)))
        for x in gone:
            for y in self.windows:
                for z in y.cohorts[1:]:
                    if z.dep_parent == x.gid and z not in gone and not hidden:
                        z.dep_parent = x.dep_parent
            for y in x.readings:
                y.hit_by.append(rule.number)
            if hidden:
                x.hidden = True
            else:
                x.removed = True
                x.deleted += x.readings
                x.readings = []
            if x.window:
                x.window.cohorts.remove(x)
        self.mark_ends(w)
        return True

    def restore_hidden(self, w: Window) -> None:
        hidden = [x for x in w.all if x.hidden and not x.removed]
        for x in hidden:
            x.hidden = False
        if hidden:
            w.cohorts = [x for x in w.all if not x.removed and (x in w.cohorts or x in hidden)]
            self.mark_ends(w)

    def groups(self, tags: list[str], like: Cohort | None = None) -> list[Cohort]:
        """New cohorts: a word form opens a cohort, a base form a reading; * stands for the old reading's tags."""
        out: list[Cohort] = []
        for t in tags:
            if is_wordform(t):
                out.append(Cohort(t, gid=self.next_gid))
                self.next_gid += 1
            elif not out:
                raise ValueError("a new cohort needs a word form first")
            elif is_base(t):
                out[-1].readings.append(Reading([t], number=1000 * (len(out[-1].readings) + 1)))
            elif out[-1].readings:
                old = like.readings[0] if like and like.readings else None
                more = [x for x in old.tags if not is_base(x) and x != "<<<"] if t == "*" and old else [t]
                for x in more:
                    self.add_tags(out[-1].readings[-1], [x], "", set())
        for x in out:
            x.readings = x.readings or [magic(x)]
        return out

    def insert(self, w: Window, new: list[Cohort], near: Cohort, after: bool) -> None:
        for target in (w.cohorts, w.all):
            k = max(target.index(near) + (1 if after else 0), 1)
            target[k:k] = new
        for x in new:
            x.window = w
        self.mark_ends(w)

    def do_addcohort(self, w, rule, c, r, ctx) -> bool:
        new = self.groups(self.tags_of(rule.maplist or rule.target, r, c, ctx), c)
        for x in new:
            for y in x.readings:
                y.hit_by.append(rule.number)
            if "addcohort-attach" in self.g.options:
                x.dep_parent = c.gid
        tree = self.subtree(c, rule.child)
        after = rule.side != "BEFORE"
        self.insert(w, new, tree[-1] if after else tree[0], after)
        return True

    def do_copycohort(self, w, rule, c, r, ctx) -> bool:
        there = next(self.candidates(rule, c, ctx), None)
        if there is None:
            return False
        source, near = (there, c) if "REVERSE" in rule.flags else (c, there)
        new = Cohort(source.wordform, [x.copy() for x in source.readings], list(source.static), gid=self.next_gid)
        self.next_gid += 1
        drop = set(self.tags_of(rule.except_list, r, c, ctx)) if rule.except_list else set()
        add = [t for t in self.tags_of(rule.maplist or rule.target, r, c, ctx) if t != "*"]
        for x in new.readings:
            for y in x.chain():
                y.tags = [t for t in y.tags if t not in drop and t != "<<<"]
            self.add_tags(x, add, "", set())
            x.hit_by.append(rule.number)
        tree = self.subtree(near, rule.dep_child or rule.child)
        after = rule.side != "BEFORE"
        edge = tree[-1] if after else tree[0]
        new.dep_parent = edge.gid
        self.insert(near.window, [new], edge, after)
        return True

    def do_splitcohort(self, w, rule, c, r, ctx) -> bool:
        tags = self.tags_of(rule.maplist or rule.target, r, c, ctx)
        arrow = re.compile(r"(\d+|c|d)(?:->|→)(\d+|p|m)|R:\*")
        plans: list[tuple[str, str]] = []
        plain: list[str] = []
        takes_relations = None
        for t in tags:
            m = arrow.fullmatch(t)
            if m and t == "R:*":
                takes_relations = len(plans) - 1
            elif m:
                plans[-1] = (m[1], m[2])
            else:
                if is_wordform(t):
                    plans.append(("", ""))
                plain.append(t)
        new = self.groups(plain, c)
        if not new:
            return False
        n = len(new)
        heads = [k for k, (a, _) in enumerate(plans) if a in ("c", "d")]
        keeper = new[heads[0]] if heads else new[-1]
        for k, x in enumerate(new):
            a, b = plans[k] if k < len(plans) else ("", "")
            if b in ("p", "m") or (not b and k == 0):
                x.dep_parent = c.dep_parent
            elif b:
                x.dep_parent = new[int(b) - 1].gid if 0 < int(b) <= n else None
            else:
                x.dep_parent = new[k - 1].gid
            for y in x.readings:
                y.hit_by.append(rule.number)
        for y in self.windows:
            for z in y.cohorts[1:]:
                if z.dep_parent == c.gid and z not in new:
                    z.dep_parent = keeper.gid
                for got in z.relations.values():
                    if c.gid in got:
                        got.discard(c.gid)
                        got.add(keeper.gid)
        (new[takes_relations] if takes_relations is not None else keeper).relations = c.relations
        new[-1].text, c.text = c.text, ""
        self.insert(w, new, c, True)
        self.drop(w, c)
        return True

    def drop(self, w: Window, c: Cohort) -> None:
        c.removed = True
        c.deleted += c.readings
        c.readings = []
        w.cohorts.remove(c)
        self.mark_ends(w)

    def do_mergecohorts(self, w, rule, c, r, ctx) -> bool:
        merged, place = [c], None
        for t in rule.dep_tests:
            inner = Context(target=c, reading=r)
            found = self.run_test(t, c, inner)
            if found is None:
                return False
            if inner.attach is not None:
                place = inner.attach
            else:
                merged.append(inner.matched or found)
        merged = sorted(dict.fromkeys(x for x in merged if x.window is w and x.gid), key=w.cohorts.index)
        new = self.groups(self.tags_of(rule.maplist or rule.target, r, c, ctx), c)
        if not new:
            return False
        for x in new:
            for y in x.readings:
                y.hit_by.append(rule.number)
        gone = {x.gid for x in merged}
        if "DETACH" not in rule.flags:
            parent = next((x.dep_parent for x in [c, *merged] if x.dep_parent is not None and x.dep_parent not in gone), None)
            new[0].dep_parent = parent
            for x in merged:
                for name, got in x.relations.items():
                    new[0].relations.setdefault(name, set()).update(g for g in got if g not in gone)
            for y in self.windows:
                for z in y.cohorts[1:]:
                    if z.dep_parent in gone and z not in merged:
                        z.dep_parent = new[0].gid
                    for got in z.relations.values():
                        if got & gone:
                            got -= gone
                            got.add(new[0].gid)
        self.insert(w, new, place or merged[-1], True)
        for x in merged:
            self.drop(w, x)
        return True

    def do_move(self, w, rule, c, r, ctx) -> bool:
        there = next(self.candidates(rule, c, ctx), None)
        if there is None or there is c or there.window is not w:
            return False
        moved = self.subtree(c, rule.child)
        if there in moved:
            return False
        edge = [x for x in self.subtree(there, rule.dep_child) if x not in moved]
        old = list(w.cohorts)
        after = rule.side != "BEFORE"
        for target in (w.cohorts, w.all):
            for x in moved:
                target.remove(x)
            k = target.index(edge[-1] if after else edge[0]) + (1 if after else 0)
            target[max(k, 1) : max(k, 1)] = moved
        self.mark_ends(w)
        if old == w.cohorts:
            return False
        r.hit_by.append(rule.number)
        return True

    def do_switch(self, w, rule, c, r, ctx) -> bool:
        there = next(self.candidates(rule, c, ctx), None)
        if there is None or there is c or there.window is not w or not there.gid:
            return False
        for target in (w.cohorts, w.all):
            a, b = target.index(c), target.index(there)
            target[a], target[b] = there, c
        self.mark_ends(w)
        r.hit_by.append(rule.number)
        return True

    # -- enclosures

    def wrap_parentheses(self, w: Window) -> None:
        """Cut out bracketed spans, from the rightmost opening bracket leftwards; depth is the nesting."""
        k = len(w.cohorts) - 1
        while k >= 1 and self.g.parentheses:
            c = w.cohorts[k]
            for left, right in self.g.parentheses:
                if not self.is_bracket(left, c):
                    continue
                end = next((j for j in range(k + 1, len(w.cohorts)) if self.is_bracket(right, w.cohorts[j])), None)
                if end is not None:
                    first, last = w.all.index(c), w.all.index(w.cohorts[end])
                    for x in w.all[first : last + 1]:
                        x.enclosed += 1
                    del w.cohorts[k : end + 1]
                    break
            k -= 1
        if self.g.parentheses and any(c.enclosed for c in w.all):
            w.enclosures = True
            self.mark_ends(w)

    def is_bracket(self, tag: Tag, c: Cohort) -> bool:
        return self.match_text(tag, c.wordform) or any(self.match_tag(tag, r, c, Context()) is not None for r in c.readings)

    def unwrap_parentheses(self, w: Window) -> bool:
        """Bring back the next bracketed span; False when all is done."""
        start = next((k for k, c in enumerate(w.all) if c.enclosed == 1), None)
        if start is None:
            if w.parens is None or w.final_enclosure:
                w.final_enclosure, w.parens = False, None
                return False
            w.final_enclosure, w.parens = True, None
            return True
        end = start
        while end < len(w.all) and w.all[end].enclosed:
            w.all[end].enclosed -= 1
            end += 1
            if end < len(w.all) and w.all[end].enclosed == 1 and any(self.is_bracket(a, w.all[end]) for a, _ in self.g.parentheses) and w.all[end - 1].enclosed == 0 and any(self.is_bracket(b, w.all[end - 1]) for _, b in self.g.parentheses):
                break
        span = [c for c in w.all[start:end] if not c.enclosed]
        w.parens = (span[0], span[-1])
        live = set(map(id, w.cohorts)) | set(map(id, span))
        w.cohorts = [c for c in w.all if id(c) in live and not c.removed]
        self.mark_ends(w)
        return True


# --- helpers ----------------------------------------------------------------------------------


def magic(c: Cohort) -> Reading:
    """The reading of a cohort without one: never printed, its base form is the word form."""
    return Reading([f'"{c.wordform[2:-2]}"' if is_wordform(c.wordform) else c.wordform], noprint=True, number=1)


def set_base(r: Reading, base: str) -> None:
    k = next((k for k, t in enumerate(r.tags) if is_base(t)), None)
    if k is None:
        r.tags.insert(0, base)
    else:
        r.tags[k] = base


def unmap_reading(r: Reading) -> bool:
    changed = bool(r.mapping) or r.mapped
    r.mapping, r.mapped, r.noprint = "", False, False
    return changed


def sub_reading(r: Reading, which: int | str) -> Reading | None:
    """0 is the reading, n the n-th below it, negative from the end; * joins the whole chain."""
    if which == 0:
        return r
    chain = r.chain()
    if which == "*":
        return Reading([t for x in chain for t in x.tags], r.mapping, r.mapped, r.noprint, r.immutable, r.active)
    k = int(which) if int(which) > 0 else len(chain) + int(which)
    return chain[k] if 0 <= k < len(chain) else None


def flat_lists(s: TagSet, g: Grammar) -> list[TagSet]:
    if s.op == "list":
        return [s]
    if s.op in ("name", "unify_tag", "unify_set"):
        name = re.sub(r"^\d+:", "", s.name)
        return flat_lists(g.sets[name], g) if name in g.sets else [TagSet("list", ((parse_tag(name),),))]
    return [x for p in s.parts for x in flat_lists(p, g)]


def match_variable(tag: Tag, variables: dict[str, str]) -> bool:
    """Key and value may be patterns of their own."""
    key, value = parse_tag(tag.key), parse_tag(tag.value) if tag.value else None

    def fits(t: Tag, text: str) -> bool:
        if t.kind in ("regex", "line"):
            return t.regex().search(text) is not None
        return t.text.casefold() == text.casefold() if t.kind == "icase" else t.text in (text, "*")

    return any(fits(key, k) and (value is None or fits(value, v)) for k, v in variables.items())


def extremes(c: Cohort, key: str) -> tuple[float, float]:
    found = [v for r in c.readings for _, k, _, v in numeric_tags(r.all_tags()) if k == key]
    return (min(found), max(found)) if found else (0.0, 0.0)


def override(arm: Test, by: Test) -> Test:
    """A template used with a position or barriers of its own."""
    changed = dict(arm.__dict__)
    if by.flags - {"NOT", "NEGATE", "NONE", "ALL"} or by.offset or by.relation:
        changed["flags"] = (arm.flags & {"careful"}) | (by.flags - {"NOT", "NEGATE", "NONE"})
        changed["offset"], changed["relation"] = by.offset, by.relation
    for name in ("barrier", "cbarrier"):
        if getattr(by, name) is not None:
            changed[name] = getattr(by, name)
    if arm.ors:
        changed["ors"] = tuple(override(x, by) for x in arm.ors)
        changed["flags"] = arm.flags
    return Test(**changed)
