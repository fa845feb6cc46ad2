"""The other stream formats, and conversion between any two.

A reader turns text into the kernel's windows, a writer turns windows into
text.  ``FORMATS`` names them; :func:`convert` is reader and writer joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from lexiloom.plans.grammar import Grammar
from lexiloom.plans.kernel import Cohort, Reading, Window, is_base, magic, new_window
from lexiloom.sources import cg_text

# Fixed value: the ASCII marks that are peeled off words.
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
INFINITE = 281474976710655.0


def _word(form: str) -> str:
    return f'"<{form}>"'


def _form(c: Cohort) -> str:
    return c.wordform[2:-2]


def _base(r: Reading) -> str:
    return r.base[1:-1]


def _rest(r: Reading) -> list[str]:
    tags = [t for t in r.tags if not is_base(t) and t != "<<<"]
    return [*tags, r.mapping] if r.mapping else tags


def _cut(cohorts: list[Cohort], grammar: Grammar | None, texts: dict[int, str]) -> list[Window]:
    """Windows by the grammar's delimiters; ``texts`` is what stood after a cohort."""
    out = cg_text.Windower(grammar)
    for k, c in enumerate(cohorts):
        out.add(c)
        c.text += texts.get(k, "")
        out.closed(c)
    out.end()
    cg_text.remap_dependencies(out.windows)
    return out.windows


def _live(windows: list[Window]) -> list[Cohort]:
    return [c for w in windows for c in w.all[1:] if not c.removed]


# --- niceline: word TAB [base] TAG TAG TAB [base] ... ----------------------------------------


def read_niceline(text: str, grammar: Grammar | None = None) -> list[Window]:
    cohorts: list[Cohort] = []
    texts: dict[int, str] = {}
    for line in text.split("\n"):
        word, *fields = line.split("\t")
        if not word.strip() or (not fields and " " in word.strip()):
            if cohorts and line:
                texts[len(cohorts) - 1] = texts.get(len(cohorts) - 1, "") + line + "\n"
            continue
        c = Cohort(_word(word.strip()))
        for f in fields:
            parts = f.split()
            if not parts:
                continue
            named = re.fullmatch(r"\[(.*)\]", parts[0])
            base = named[1] if named else word.strip()
            c.readings.append(Reading([f'"{base}"', *(parts[1:] if named else parts)]))
        cohorts.append(c)
    return _cut(cohorts, grammar, texts)


def write_niceline(windows: list[Window]) -> str:
    lines = []
    for c in _live(windows):
        shown = [r for r in sorted(c.readings, key=lambda r: r.number) if not r.noprint]
        fields = [" ".join([f"[{_base(r)}]", *_rest(r)]) for r in shown]
        lines.append("\t".join([_form(c), *fields]))
        if c.text.strip():
            lines.append(c.text.rstrip("\n"))
    return "\n".join(lines) + "\n"


# --- plain text ------------------------------------------------------------------------------


def peel(token: str) -> list[str]:
    """A token's leading and trailing marks, each by itself, around the word."""
    left = 0
    while left < len(token) and token[left] in PUNCTUATION:
        left += 1
    right = len(token)
    while right > left and token[right - 1] in PUNCTUATION:
        right -= 1
    return [*token[:left], *([token[left:right]] if left < right else []), *token[right:]]


def case_tags(word: str) -> list[str]:
    letters = [x for x in word if x.isalpha()]
    if not letters:
        return []
    tags = ["<first-upper>"] if word[0].isupper() else []
    upper = sum(x.isupper() for x in letters)
    if upper == len(letters):
        tags.append("<all-upper>")
    elif upper > (1 if word[0].isupper() else 0):
        tags.append("<mixed-upper>")
    return tags


def read_plain(text: str, grammar: Grammar | None = None, add_tags: bool = False) -> list[Window]:
    cohorts = []
    for token in text.split():
        for word in peel(token):
            c = Cohort(_word(word))
            if add_tags:
                c.readings = [Reading([f'"{word.lower()}"', *case_tags(word)])]
            cohorts.append(c)
    return _cut(cohorts, grammar, {})


def write_plain(windows: list[Window]) -> str:
    return "\n".join(" ".join(_form(c) for c in w.all[1:] if not c.removed) for w in windows) + "\n"


# --- finite-state output: word TAB base+TAG+TAG TAB weight -------------------------------------


def read_fst(text: str, grammar: Grammar | None = None, factor: float = 1.0, prefix: str = "W", top_level: str = "#") -> list[Window]:
    cohorts: list[Cohort] = []
    texts: dict[int, str] = {}
    now: Cohort | None = None
    for line in text.split("\n"):
        fields = line.split("\t")
        if len(fields) < 2:
            now = None
            if line.strip() and cohorts:
                texts[len(cohorts) - 1] = texts.get(len(cohorts) - 1, "") + line + "\n"
            continue
        if now is None or _form(now) != fields[0]:
            now = Cohort(_word(fields[0]))
            cohorts.append(now)
        if fields[1].strip() == "+?" or fields[1].endswith("+?"):
            continue
        weight = []
        if len(fields) > 2 and fields[2].strip():
            value = INFINITE if fields[2].strip().startswith("inf") else float(fields[2].replace(",", ".")) * factor
            weight = [f"<{prefix}:{value:f}>" if value != INFINITE else f"<{prefix}:{INFINITE:.0f}>"]
        chain: Reading | None = None
        for part in fields[1].split(top_level):
            pieces = part.split("+")
            r = Reading([f'"{pieces[0]}"', *[p or "_" for p in pieces[1:]]], next=chain)  # the last part is the main reading
            chain = r
        if chain is not None:
            chain.tags += weight
            now.readings.append(chain)
    return _cut(cohorts, grammar, texts)


def write_fst(windows: list[Window], prefix: str = "W") -> str:
    out = []
    for c in _live(windows):
        shown = [r for r in sorted(c.readings, key=lambda r: r.number) if not r.noprint]
        if not shown:
            out.append(f"{_form(c)}\t{_form(c)}+?\tinf")
        for r in shown:
            weight = next((t for t in r.tags if t.startswith(f"<{prefix}:")), "")
            parts = ["+".join([_base(x), *[t for t in _rest(x) if t != weight]]) for x in reversed(r.chain())]
            out.append("\t".join([_form(c), "#".join(parts), weight[len(prefix) + 2 : -1] or "0.0"]))
        out.append("")
    return "\n".join(out)


# --- Apertium: ^word/base<t><t>+base<t>/...$ -----------------------------------------------------

_ESCAPED = set("^\\/$[]{}<>")


def _escape(text: str) -> str:
    return "".join("\\" + x if x in _ESCAPED else x for x in text)


def _split_unescaped(text: str, mark: str) -> list[str]:
    out, now, k = [], "", 0
    while k < len(text):
        if text[k] == "\\" and k + 1 < len(text):
            now += text[k : k + 2]
            k += 2
            continue
        if text[k] == mark:
            out.append(now)
            now = ""
        else:
            now += text[k]
        k += 1
    return [*out, now]


def _plain_text(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _apertium_reading(text: str, ltr: bool) -> Reading:
    chain: Reading | None = None
    parts = _split_unescaped(text, "+")
    for part in parts if not ltr else reversed(parts):
        first = re.search(r"(?<!\\)<", part)
        tail = re.search(r"#.*$", part)
        joined = tail[0] if tail and (not first or tail.start() > first.start()) else ""
        body = part[: len(part) - len(joined)] if joined else part
        base = _plain_text(body[: first.start()] if first else body) + _plain_text(joined)
        tags = re.findall(r"(?<!\\)<((?:[^<>\\]|\\.)*)>", body)
        chain = Reading([f'"{base}"', *map(_plain_text, tags)], next=chain)
    assert chain is not None
    return chain


def read_apertium(text: str, grammar: Grammar | None = None) -> list[Window]:
    cohorts: list[Cohort] = []
    texts: dict[int, str] = {}
    ltr = grammar is not None and grammar.subreadings == "LTR"
    token = re.compile(r"(\[\[(?:[^\]\\]|\\.)*\]\])?\^((?:[^$\\]|\\.)*)\$", re.S)
    at = 0
    for m in token.finditer(text):
        between = text[at : m.start()]
        if between and cohorts:
            texts[len(cohorts) - 1] = between
        at = m.end()
        form, *readings = _split_unescaped(m[2], "/")
        static = re.search(r"(?<!\\)<", form)
        c = Cohort(_word(_plain_text(form[: static.start()] if static else form)), wblank=m[1] or "")
        c.static = re.findall(r"<([^<>]*)>", form[static.start() :]) if static else []
        c.readings = [_apertium_reading(r, ltr) for r in readings if not r.startswith(("*", "@"))]
        if not c.readings and readings:
            c.readings = [Reading([f'"{_plain_text(readings[0])}"'])]
        cohorts.append(c)
    if cohorts and text[at:]:
        texts[len(cohorts) - 1] = texts.get(len(cohorts) - 1, "") + text[at:]
    return _cut(cohorts, grammar, texts)


def cased(base: str, form: str) -> str:
    """The base form in the casing of the word."""
    capitals = [x for x in form if x.isalpha()]
    if len(capitals) > 1 and all(x.isupper() for x in capitals):
        return base.upper()
    return base[:1].upper() + base[1:] if form[:1].isupper() else base


def write_apertium(windows: list[Window], surface_case: bool = False, first_only: bool = False) -> str:
    out = []
    for c in _live(windows):
        shown = [r for r in sorted(c.readings, key=lambda r: r.number) if not r.noprint][: 1 if first_only else None]
        parts = [_escape(_form(c)) + "".join(f"<{t}>" for t in c.static)]
        for r in shown:
            pieces = []
            for x in reversed(r.chain()):
                base = cased(_base(x), _form(c)) if surface_case else _base(x)
                pieces.append((base if base.startswith(("*", "@")) else _escape(base)) + "".join(f"<{_escape(t)}>" for t in _rest(x)))
            parts.append("+".join(pieces))
        out.append(f"{c.wblank}^{'/'.join(parts)}$" + (c.text or " "))
    return "".join(out).rstrip(" ")


# --- JSON lines ----------------------------------------------------------------------------------


def _json_reading(x: dict, c: Cohort) -> Reading:
    r = Reading([f'"{x["l"]}"'] if "l" in x else [f'"{_form(c)}"'])
    r.tags += x.get("ts", [])
    if x.get("s"):
        r.next = _json_reading(x["s"], c)
    return r


def read_jsonl(text: str, grammar: Grammar | None = None) -> list[Window]:
    out = cg_text.Windower(grammar)
    for line in text.split("\n"):
        if not line.strip():
            continue
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if not isinstance(x, dict):
            continue
        if "cmd" in x:
            name, _, value = str(x["cmd"]).partition(":")
            if name == "EXIT":
                break
            if name == "FLUSH":
                out.end(flush=True)
            elif name == "SETVAR":
                key, _, val = value.partition("=")
                out.vars_set[key] = val or "*"
            elif name == "REMVAR":
                out.vars_rem.append(value)
            continue
        if "w" not in x:
            if "t" in x and out.now:
                out.now[-1].text += x["t"]
            continue
        c = Cohort(_word(x["w"]), static=x.get("sts", []), text=x.get("z", ""))
        c.dep_self, c.dep_parent = int(x.get("ds", 0) or 0), x.get("dp")
        c.readings = [_json_reading(r, c) for r in x.get("rs", [])]
        c.deleted = [_json_reading(r, c) for r in x.get("drs", [])]
        out.add(c, c.dep_self)
        out.closed(c)
    out.end()
    cg_text.remap_dependencies(out.windows)
    return out.windows


def _reading_json(r: Reading) -> dict:
    x: dict = {"l": _base(r), "ts": _rest(r)}
    if r.next:
        x["s"] = _reading_json(r.next)
    return x


def write_jsonl(windows: list[Window]) -> str:
    lines = []
    for w in windows:
        for c in (c for c in w.all[1:] if not c.removed):
            x: dict = {"w": _form(c)}
            if c.static:
                x["sts"] = c.static
            x["rs"] = [_reading_json(r) for r in sorted(c.readings, key=lambda r: r.number) if not r.noprint]
            if c.deleted:
                x["drs"] = [_reading_json(r) for r in c.deleted]
            if c.dep_parent is not None:
                places = {y.gid: k for k, y in enumerate(w.cohorts)}
                x["ds"], x["dp"] = places.get(c.gid, c.gid), places.get(c.dep_parent, c.dep_parent)
            if c.text:
                x["z"] = c.text
            lines.append(json.dumps(x, ensure_ascii=False))
        if w.flush_after:
            lines.append(json.dumps({"cmd": "FLUSH"}))
    return "\n".join(lines) + "\n"


# --- dependency trees as XML -----------------------------------------------------------------------


def _matxin_reading(text: str) -> Reading:
    """Joined words are tags of the same reading; what follows ``#`` behind the tags belongs to the base form."""
    suffix = re.search(r"<[^#]*(#[^+]*)", text)
    bases = [x for x in re.split(r"<[^>]*>", text) if x]
    base = text.partition("<")[0] + (suffix[1] if suffix else "")
    if "*" in text.partition("<")[0]:
        return Reading([f'"{base}"'])
    tags = [m[1] if m[1] is not None else f'"{m[2]}"' for m in re.finditer(r"<([^>]*)>|(?<=>)\+([^<]+)(?=<)", text)]
    return Reading([f'"{base}"', *tags]) if bases else Reading(['""', *tags])


def read_matxin(text: str, grammar: Grammar | None = None) -> list[Window]:
    """Words as ``^form/base<tag><tag>$``, which is what goes in where XML trees come out."""
    cohorts: list[Cohort] = []
    texts: dict[int, str] = {}
    at = 0
    for m in re.finditer(r"\[[^\]]*\]|\^([^/$]*)((?:/[^/$]*)*)\$", text):
        if m[1] is None:
            continue  # a superblank; a caret in it starts nothing
        between = text[at : m.start()]
        if between and cohorts:
            texts[len(cohorts) - 1] = between
        at = m.end()
        cohorts.append(Cohort(_word(m[1]), [_matxin_reading(r) for r in m[2].split("/")[1:]]))
    if cohorts and text[at:]:
        texts[len(cohorts) - 1] = texts.get(len(cohorts) - 1, "") + text[at:]
    return _cut(cohorts, grammar, texts)


def write_matxin(windows: list[Window]) -> str:
    """One SENTENCE per window, NODE in NODE by dependency; a cohort shows its first reading.

    Cohorts without a parent in the window hang on the window's root, the first that
    has none; marks of XML are written as references.
    """
    from xml.sax.saxutils import quoteattr

    quoted = lambda x: quoteattr(x, {'"': "&quot;"})
    out = ["<corpus>"]
    for k, w in enumerate(windows, 1):
        live = [c for c in w.all[1:] if not c.removed]
        ids = {c.gid for c in live}
        below: dict[int, list[Cohort]] = {}
        tops: list[Cohort] = []
        for c in live:
            if c.dep_parent in ids and c.dep_parent != c.gid:
                below.setdefault(c.dep_parent, []).append(c)
            else:
                tops.append(c)
        shown: set[int] = set()

        def node(c: Cohort, depth: int) -> list[str]:
            shown.add(id(c))
            r = c.readings[0] if c.readings else magic(c)
            plain = [t for t in _rest(r) if t != r.mapping and not t.startswith("+")]
            attrs = f'ord="{c.gid or live.index(c) + 1}" alloc="0" form={quoted(_form(c))} lem={quoted(_base(r))} mi={quoted("|".join(plain))} si={quoted(r.mapping[1:])}'
            pad, inner = "  " * depth, [y for x in below.get(c.gid, []) if c.gid and id(x) not in shown for y in node(x, depth + 1)]
            return [f"{pad}<NODE {attrs}>", *inner, f"{pad}</NODE>"] if inner else [f"{pad}<NODE {attrs}/>"]

        out.append(f'  <SENTENCE ord="{k}" alloc="0">')
        for c in [*tops, *live]:  # whoever hangs on a loop is not below a top
            if id(c) not in shown:
                out += node(c, 2)
        out.append("  </SENTENCE>")
    return "\n".join([*out, "</corpus>"]) + "\n"


# --- multiword split -----------------------------------------------------------------------------------


def split_multiwords(windows: list[Window]) -> list[Window]:
    """Cohorts all of whose readings carry word forms become a cohort per word; the head is the last word."""
    out = []
    for w in windows:
        cohorts: list[Cohort] = []
        for c in (c for c in w.all[1:] if not c.removed):
            chains = [list(reversed(r.chain())) for r in c.readings]
            forms = [[next((t for t in x.tags if t.startswith('"<')), "") for x in ch] for ch in chains]
            if not chains or not all(all(f) for f in forms) or any(f != forms[0] for f in forms) or len(forms[0]) < 2:
                cohorts.append(c)
                continue
            for k, form in enumerate(forms[0]):
                inner = form[2:-2]
                part = Cohort(_word(inner.strip()), static=list(c.static))
                part.readings = [Reading([t for t in ch[k].tags if not t.startswith('"<')], ch[k].mapping, number=1000 * (j + 1)) for j, ch in enumerate(chains)]
                if inner != inner.strip():
                    part.text = ":" + inner[len(inner.rstrip()) :] + "\n" if inner.rstrip() != inner else ""
                cohorts.append(part)
            cohorts[-1].text += c.text
        fresh = new_window(cohorts)
        fresh.text, fresh.text_post, fresh.flush_after = w.text, w.text_post, w.flush_after
        out.append(fresh)
    return out


# --- detection and conversion ------------------------------------------------------------------------------

# What the first thousand characters of a format look like, in the order they are tried.
SNIFF = [
    ("cg", r'(?sm)^"<[^>]+>".*?^\s+"[^"]+"'),
    ("niceline", r"(?sm)^\S+ *\t *\[\S+\]"),
    ("niceline", r'(?sm)^\S+ *\t *"\S+"'),
    ("apertium", r"(?sm)\^[^/]+(/[^<]+(<[^>]+>)+)+\$"),
    ("fst", r"(?sm)^\S+\t\S+(\+\S+)+$"),
    ("jsonl", r"(?m)^\{"),
]
FORMATS: dict[str, tuple[Callable, Callable]] = {
    "cg": (cg_text.parse, cg_text.format_windows), "niceline": (read_niceline, write_niceline), "plain": (read_plain, write_plain),
    "fst": (read_fst, write_fst), "apertium": (read_apertium, write_apertium), "jsonl": (read_jsonl, write_jsonl), "matxin": (read_matxin, write_matxin),
}


def detect(text: str) -> str:
    head = text[:1000]
    return next((name for name, pattern in SNIFF if re.search(pattern, head)), "plain")


def convert(text: str, to: str, source: str = "") -> str:
    """``text`` in another format, without a grammar."""
    return FORMATS[to][1](FORMATS[source or detect(text)][0](text))
