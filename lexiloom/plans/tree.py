"""The syntax tree of a grammar as XML, to look at or to compare."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from lexiloom.plans import writer
from lexiloom.plans.grammar import Grammar, Rule, TagSet, Test


def syntax_tree(g: Grammar) -> str:
    """Sets, templates and sections with their rules; ``l`` is a rule's line and ``t`` the text of a leaf."""
    root = ET.Element("Grammar", prefix=g.prefix, subreadings=g.subreadings)
    for name in sorted(g.options):
        ET.SubElement(root, "Option", t=name)
    for name, s in g.sets.items():
        _set(ET.SubElement(root, "List" if s.op == "list" else "SetDefinition", name=name), s)
    for left, right in g.parentheses:
        pair = ET.SubElement(root, "Parentheses")
        ET.SubElement(pair, "Tag", t=writer.tag(left))
        ET.SubElement(pair, "Tag", t=writer.tag(right))
    for name, t in g.templates.items():
        _test(ET.SubElement(root, "Template", name=name), t)
    for name, at in g.anchors.items():
        ET.SubElement(root, "Anchor", t=name, after=str(at))
    for title, rules in [("BeforeSections", g.before), *[("Section", s) for s in g.sections], ("AfterSections", g.after), ("NullSection", g.null)]:
        if rules:
            section = ET.SubElement(root, title)
            for r in rules:
                _rule(section, r)
    ET.indent(root, " ")
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def _set(at: ET.Element, s: TagSet) -> None:
    found = ET.SubElement(at, "Set", op=s.op, **({"name": s.name} if s.name else {}))
    for member in s.members:
        place = found if len(member) == 1 else ET.SubElement(found, "CompositeTag")
        for t in member:
            ET.SubElement(place, "Tag", kind=t.kind, t=writer.tag(t))
    for part in s.parts:
        _set(found, part)


def _test(at: ET.Element, t: Test) -> None:
    found = ET.SubElement(at, "Context")
    for mark in ("NEGATE", "NOT", "NONE", "ALL"):
        if t.has(mark):
            ET.SubElement(found, "Modifier", t=mark)
    if t.template:
        ET.SubElement(found, "TemplateRef", t=t.template)
    if not t.ors:
        ET.SubElement(found, "Position", t=writer.position(t))
    for arm in t.ors:
        _test(ET.SubElement(found, "Or"), arm)
    for name, s in (("Target", t.target), ("Barrier", t.barrier), ("CBarrier", t.cbarrier)):
        if s is not None:
            _set(ET.SubElement(found, name), s)
    if t.link is not None:
        _test(ET.SubElement(found, "Link"), t.link)


def _rule(at: ET.Element, r: Rule) -> None:
    found = ET.SubElement(at, "Rule", l=str(r.line), type=r.kind, **({"name": r.name} if r.name else {}))
    if r.wordform is not None:
        ET.SubElement(found, "Wordform", t=writer.tag(r.wordform))
    for flag in sorted(r.flags):
        ET.SubElement(found, "Flag", t=flag)
    if r.command:
        ET.SubElement(found, "Command", mode=r.mode, t=r.command)
    lists = (("Sublist", r.sublist), ("Maplist", r.maplist), ("Except", r.except_list), ("Target", r.target), ("Child", r.child), ("DepChild", r.dep_child))
    for name, s in lists:
        if s is not None:
            _set(ET.SubElement(found, name), s)
    for t in r.tests:
        _test(found, t)
    if r.dep_tests:
        there = ET.SubElement(found, "DepTarget", **({"where": r.side} if r.side else {}))
        for t in r.dep_tests:
            _test(there, t)
    for inner in r.nested:
        _rule(found, inner)
