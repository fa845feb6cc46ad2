"""Grammars back to text, for storing a plan and for round trips."""

from __future__ import annotations

from lexiloom.plans.grammar import CLOSING, TWO_LISTS, Grammar, Rule, Tag, TagSet, Test

_LETTERS = {
    "careful": "C", "child": "c", "parent": "p", "ancestor": "pp", "descendant": "cc", "sibling": "s", "left": "l", "right": "r",
    "leftmost": "ll", "rightmost": "rr", "self": "S", "nobarrier": "N", "span": "W", "span_left": "<", "span_right": ">", "attach": "A",
    "with": "w", "look_deleted": "D", "look_delayed": "d", "look_ignored": "I", "active": "T", "inactive": "t", "no_origin": "o",
    "pass_origin": "O", "left_par": "L", "right_par": "R", "mark_set": "X", "mark_jump": "x", "bag": "B", "numeric_branch": "f", "unknown": "?",
}


def tag(t: Tag) -> str:
    text = t.text
    if t.kind == "icase":
        text += "i"
    elif t.kind == "anyform":
        text += "r"
    elif t.kind == "varstring" and not text.startswith("VSTR:"):
        text += "v"
    return ("^" if t.failfast else "") + text


def members(s: TagSet) -> str:
    return " ".join(tag(m[0]) if len(m) == 1 else "(" + " ".join(map(tag, m)) + ")" for m in s.members)


def tag_set(s: TagSet) -> str:
    if s.op == "list":
        return " OR ".join("(" + " ".join(map(tag, m)) + ")" for m in s.members) or "(_NOTHING_)"
    if s.op == "name":
        return s.name
    if s.op in ("unify_tag", "unify_set"):
        return ("$$" if s.op == "unify_tag" else "&&") + s.name
    if s.op == "or":
        return " OR ".join(map(tag_set, s.parts))
    return f" {s.op} ".join(map(tag_set, s.parts))


def position(t: Test) -> str:
    stars = "**" if t.has("scan_all") else "*" if t.has("scan") else ""
    letters = "".join(_LETTERS[x] for x in sorted(t.flags & _LETTERS.keys()))
    dependency = t.has("child", "parent", "ancestor", "descendant", "sibling", "left_par", "right_par", "mark_jump")
    offset = "" if (dependency or t.relation or t.jump or t.has("bag")) and not t.offset else str(t.offset)
    sub = f"/{t.sub}" if t.sub else ""
    jump = f"j{t.jump}" if t.jump else ""
    return ("@" if t.has("absolute") else "") + jump + offset + stars + letters + sub + (f"r:{t.relation}" if t.relation else "")


def test(t: Test) -> str:
    return "(" + body(t) + ")"


def body(t: Test) -> str:
    marks = " ".join(x for x in ("NEGATE", "NOT", "NONE", "ALL") if t.has(x))
    if t.ors:
        core = " OR ".join(test(x) for x in t.ors)
    elif t.template and not (t.offset or t.flags - {"NEGATE", "NOT", "NONE", "ALL"}):
        core = f"T:{t.template}"
    else:
        core = position(t) + (f" T:{t.template}" if t.template else f" {tag_set(t.target)}" if t.target else "")
    for word, s in (("BARRIER", t.barrier), ("CBARRIER", t.cbarrier)):
        core += f" {word} {tag_set(s)}" if s else ""
    return f"{marks} {core}".strip() + (f" LINK {body(t.link)}" if t.link else "")


def rule(r: Rule) -> str:
    parts = [tag(r.wordform)] if r.wordform else []
    parts.append(r.kind + (f":{r.name}" if r.name else ""))
    if r.kind == "EXTERNAL":
        parts += [r.mode, f'"{r.command}"']
    if r.sub:
        parts.append(f"SUB:{r.sub}")
    parts += sorted(r.flags - {"REVERSE", "WITHCHILD"})
    if r.child is not None:
        parts += ["WITHCHILD", tag_set(r.child)]
    if r.kind in TWO_LISTS and r.sublist is not None:
        parts.append(tag_set(r.sublist))
    if r.maplist is not None:
        parts.append(tag_set(r.maplist))
    if r.except_list is not None:
        parts += ["EXCEPT", tag_set(r.except_list)]
    inner_side = r.side and r.kind != "MOVE"
    if inner_side:
        parts.append(r.side + (f" {tag_set(r.place)}" if r.place else ""))
    parts.append("TARGET " + tag_set(r.target))
    parts += [test(t) for t in r.tests]
    if r.dep_tests:
        word = "FROM" if "REVERSE" in r.flags else r.side if r.side in CLOSING and not inner_side else "WITH" if r.kind in ("SWITCH", "MERGECOHORTS") else "TO"
        parts.append(word + (f" WITHCHILD {tag_set(r.dep_child)}" if r.dep_child is not None else ""))
        parts += [test(t) for t in r.dep_tests]
    if r.kind == "WITH":
        return " ".join(parts) + " { " + " ".join(map(rule, r.nested)) + " } ;"
    return " ".join(parts) + " ;"


def grammar(g: Grammar) -> str:
    out = [f"MAPPING-PREFIX = {g.prefix} ;", f"SUBREADINGS = {g.subreadings} ;"]
    for name, s in (("DELIMITERS", g.delimiters), ("SOFT-DELIMITERS", g.soft_delimiters)):
        if s is not None:
            out.append(f"{name} = {members(s)} ;")
    if g.text_delimiters:
        out.append("TEXT-DELIMITERS = " + " ".join(map(tag, g.text_delimiters)) + " ;")
    if g.parentheses:
        out.append("PARENTHESES = " + " ".join(f"({tag(a)} {tag(b)})" for a, b in g.parentheses) + " ;")
    for word, names in (("OPTIONS", g.options), ("LIST-TAGS", g.list_tags), ("REOPEN-MAPPINGS", g.reopen), ("STATIC-SETS", g.static_sets)):
        if names:
            out.append(f"{word} += {' '.join(sorted(names))} ;")
    out += [f"{word} += {' '.join(args)} ;" for word, args in (("CMDARGS", g.cmdargs), ("CMDARGS-OVERRIDE", g.cmdargs_override)) if args]
    out += [f"LIST {n} = {members(s)} ;" if s.op == "list" else f"SET {n} = {tag_set(s)} ;" for n, s in g.sets.items() if not n.startswith("_S_")]
    out += [f"TEMPLATE {n} = {test(t)} ;" for n, t in g.templates.items()]
    at = {}
    for name, number in g.anchors.items():
        at.setdefault(number, []).append(name)
    for title, rules in [("BEFORE-SECTIONS", g.before), *[("SECTION", s) for s in g.sections], ("AFTER-SECTIONS", g.after), ("NULL-SECTION", g.null)]:
        if rules:
            out.append(title)
            for r in rules:
                out += [f"ANCHOR {name} ;" for name in at.pop(r.number - 1, [])]
                out.append(rule(r))
    out += [f"ANCHOR {name} ;" for names in at.values() for name in names]
    if g.strict:
        out.append(f"STRICT-TAGS += {' '.join(sorted(g.strict))} ;")  # at the end: tags before it aren't checked again
    return "\n".join(out) + "\n"
