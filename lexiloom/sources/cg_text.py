"""The constraint-grammar text stream: reader and writer.

    "<wordform>" static tags
        "baseform" TAG TAG @MAP #1->0 ID:1 R:name:2
            "sub-reading" TAG
    ;   "deleted" TAG
    <STREAMCMD:SETVAR:name=value>

Other lines are text kept with the cohort before them.
"""

from __future__ import annotations

import re

from lexiloom.plans.grammar import Grammar
from lexiloom.plans.kernel import Applicator, Cohort, Context, Reading, Window, is_base, new_window

_TAGS = re.compile(r'"(?:[^"\\]|\\.)*"\S*|\S+')
_DEP = re.compile(r"#(\d+)(?:->|→)(\d+)")
_COMMAND = re.compile(r"<STREAMCMD:([A-Z]+)(?::(.*))?>")


def reading_of(tags: list[str]) -> tuple[Reading, dict]:
    """A reading and what its tags say about the cohort."""
    about: dict = {"relations": {}}
    kept = []
    for t in tags:
        dep = _DEP.fullmatch(t)
        if dep:
            about["self"], about["parent"] = int(dep[1]), int(dep[2])
        elif re.fullmatch(r"ID:\d+", t):
            about["id"] = int(t[3:])
        elif re.fullmatch(r"R:[^:]+:\d+", t):
            _, name, target = t.split(":")
            about["relations"].setdefault(name, set()).add(int(target))
        else:
            kept.append(t)
    return Reading(kept), about


class Windower:
    """Cuts a stream of cohorts into windows: delimiters, soft and hard limits, text delimiters, dependency jumps."""

    def __init__(self, grammar: Grammar | None = None, soft_limit: int = 300, hard_limit: int = 500, dep_delimit: int = 0) -> None:
        self.g = grammar or Grammar()
        self.soft, self.hard, self.dep = soft_limit, hard_limit, dep_delimit
        self.match = Applicator(self.g)
        self.windows: list[Window] = []
        self.now: list[Cohort] = []
        self.vars_set: dict[str, str] = {}
        self.vars_rem: list[str] = []
        self.text = ""

    def delimits(self, s, c: Cohort) -> bool:
        pool = c.readings or [Reading([])]
        return s is not None and any(self.match.match_set(s, r, c, Context(target=c)) for r in pool)

    def add(self, c: Cohort, dep_self: int = 0) -> None:
        """Take the next cohort; a dependency jump or the hard limit ends the window before it."""
        if self.dep and dep_self and self.now:
            top = max((x.dep_self for x in self.now), default=0)
            if dep_self <= top or dep_self > top + self.dep:
                self.end()
        self.now.append(c)

    def closed(self, c: Cohort) -> None:
        """The cohort is complete: see whether the window ends after it."""
        if self.dep and c.dep_self:
            return
        n = len(self.now)
        if self.delimits(self.g.delimiters, c):
            self.end()
        elif n >= self.soft and self.g.soft_delimiters is not None:
            if self.delimits(self.g.soft_delimiters, c):
                self.end()
            elif n == self.soft or n >= self.hard:
                back = next((k for k in range(n - 1, -1, -1) if self.delimits(self.g.soft_delimiters, self.now[k])), None)
                if back is not None and back + 1 < n:
                    rest = self.now[back + 1 :]
                    self.now = self.now[: back + 1]
                    self.end()
                    self.now = rest
                elif n >= self.hard:
                    self.end()
        elif n >= self.hard:
            self.end()

    def end(self, flush: bool = False) -> None:
        if self.now or flush:
            if not self.now and self.windows:
                self.windows[-1].flush_after = True
                return
            w = new_window(self.now)
            w.vars_set, w.vars_rem, w.text, w.flush_after = self.vars_set, self.vars_rem, self.text, flush
            self.vars_set, self.vars_rem, self.text = {}, [], ""
            self.windows.append(w)
            self.now = []


def remap_dependencies(windows: list[Window], scope_all: bool = False) -> None:
    """Window-local ids of dependencies and relations become global ones; unknown parents go."""
    top = 0
    for w in windows:
        for c in w.cohorts[1:]:
            top += 1
            c.gid = top
    groups = [[c for w in windows for c in w.cohorts[1:]]] if scope_all else [w.cohorts[1:] for w in windows]
    for cohorts in groups:
        by_dep = {c.dep_self: c.gid for c in cohorts if c.dep_self}
        for c in cohorts:
            if c.dep_parent is not None and c.dep_self:
                c.dep_parent = 0 if c.dep_parent == 0 else by_dep.get(c.dep_parent)
    by_id = {c._id: c.gid for w in windows for c in w.cohorts[1:] if getattr(c, "_id", None)}
    for w in windows:
        for c in w.cohorts[1:]:
            c.relations = {k: {by_id[x] for x in v if x in by_id} for k, v in c.relations.items()}
            c.relations = {k: v for k, v in c.relations.items() if v}


def parse(text: str, grammar: Grammar | None = None, **limits: int) -> list[Window]:
    """The windows of a stream."""
    out = Windower(grammar, **limits)
    cohort: Cohort | None = None
    levels: list[tuple[int, Reading]] = []
    ignoring = False

    def close() -> None:
        nonlocal cohort
        if cohort is not None:
            out.closed(cohort)
            cohort = None

    for line in text.split("\n"):
        command = _COMMAND.fullmatch(line.strip())
        if command:
            name, value = command[1], command[2] or ""
            if name == "EXIT":
                break
            if name == "RESUME":
                ignoring = False
            elif name == "IGNORE":
                close()
                ignoring = True
            elif ignoring:
                continue
            elif name == "FLUSH":
                close()
                out.end(flush=True)
            elif name == "SETVAR":
                close()
                for part in value.split(","):
                    key, _, val = part.partition("=")
                    out.vars_set[key] = val or "*"
            elif name == "REMVAR":
                close()
                for key in value.split(","):
                    out.vars_set.pop(key, None)
                    out.vars_rem.append(key)
            continue
        m = re.match(r'"<(?:[^\\]|\\.)*?>"(?=\s|$)', line)
        if m and not ignoring:
            close()
            cohort, levels = Cohort(m[0], static=_TAGS.findall(line[m.end() :])), []
            out.add(cohort)
            continue
        deleted = line.startswith(";")
        body = line[1:] if deleted else line
        stripped = body.lstrip(" \t")
        if cohort is not None and stripped.startswith('"') and body != stripped and not ignoring:
            indent = len(body) - len(stripped)
            reading, about = reading_of(_TAGS.findall(stripped))
            while levels and levels[-1][0] >= indent:
                levels.pop()
            if levels:
                if levels[-1][1].next is None:  # a second sub-reading at the same place is lost
                    levels[-1][1].next = reading
            else:
                (cohort.deleted if deleted else cohort.readings).append(reading)
            levels.append((indent, reading))
            if "self" in about:
                if not cohort.dep_self and out.dep and out.now and out.now[-1] is cohort:
                    out.now.pop()
                    out.add(cohort, about["self"])
                cohort.dep_self, cohort.dep_parent = about["self"], about["parent"]
            if "id" in about:
                cohort._id = about["id"]  # type: ignore[attr-defined]
            for k, v in about["relations"].items():
                cohort.relations.setdefault(k, set()).update(v)
            continue
        if not line.strip():
            if cohort is not None and line:
                cohort.text += line + "\n"
            continue
        if cohort is not None:
            cohort.text += line + "\n"
        elif out.windows and not out.now:
            out.windows[-1].text_post += line + "\n"
        elif out.now:
            out.now[-1].text += line + "\n"
        else:
            out.text += line + "\n"
        if any(t.kind in ("regex", "line", "plain") and (t.regex().search(line + "\n") if t.pattern else t.text == line) for t in out.g.text_delimiters):
            close()
            out.end()
    close()
    out.end()
    remap_dependencies(out.windows)
    return out.windows


def format_reading(r: Reading, c: Cohort, trace: dict[int, str] | None = None, unique: bool = False, dependencies: bool = True, depth: int = 1) -> list[str]:
    tags = [t for t in r.tags if t != "<<<"]
    if unique:
        tags = list(dict.fromkeys(tags))
    base = [t for t in tags if is_base(t)][:1]
    parts = base + [t for t in tags if t not in base]
    if r.mapping:
        parts.append(r.mapping)
    if depth == 1:
        if dependencies and c.dep_parent is not None:
            place = {x.gid: k for k, x in enumerate(c.window.cohorts)} if c.window else {}
            parts.append(f"#{place.get(c.gid, c.gid)}->{place.get(c.dep_parent, c.dep_parent)}")
        if c.relations:
            parts.append(f"ID:{c.gid}")
            parts += [f"R:{k}:{g}" for k, v in sorted(c.relations.items()) for g in sorted(v)]
    if trace is not None:
        parts += [trace.get(x, str(x)) for x in r.hit_by]
    lines = ["\t" * depth + " ".join(parts)]
    if r.next:
        lines += format_reading(r.next, c, trace, unique, dependencies, depth + 1)
    return lines


def format_windows(windows: list[Window], grammar: Grammar | None = None, trace: bool = False, unique: bool = False) -> str:
    """The stream of windows; with ``trace`` rules that hit a reading, and deleted readings."""
    names = {r.number: f"{r.kind}:{r.line}" + (f":{r.name}" if r.name else "") for r in grammar.rules()} if grammar and trace else None
    out: list[str] = []
    for w in windows:
        out += [f"<STREAMCMD:SETVAR:{k}={v}>" for k, v in sorted(w.vars_out.items())]
        if w.text:
            out.append(w.text.rstrip("\n"))
        for c in w.all[1:]:
            if c.removed and not trace:
                if c.text:
                    out.append(c.text.rstrip("\n"))
                continue
            out.append(("; " if c.removed else "") + " ".join([c.wordform, *c.static]))
            for r in sorted((r for r in c.readings if not r.noprint), key=lambda r: r.number):
                out += format_reading(r, c, names, unique)
            if trace:
                for r in c.deleted + c.delayed:
                    out += [";" + x for x in format_reading(r, c, names, unique)]
            if c.text:
                out.append(c.text.rstrip("\n"))
        if w.text_post:
            out.append(w.text_post.rstrip("\n"))
        if w.flush_after:
            out.append("<STREAMCMD:FLUSH>")
        out.append("")
    return "\n".join(out)
