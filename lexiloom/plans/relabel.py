"""Relabelling: a grammar's tags replaced by mapping rules, in the grammar or in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.grammar import Grammar, TagSet, parse


def mappings(rules: Grammar | str) -> list[tuple[str, TagSet]]:
    """(old tag, what replaces it) of rules like ``MAP (new) (old) ;``"""
    g = parse(rules) if isinstance(rules, str) else rules
    return [(r.target.tags()[0].text, r.maplist) for r in g.rules() if r.kind == "MAP" and r.maplist is not None]


def relabel_set(s: TagSet, old: str, new: TagSet) -> TagSet:
    """Tag tuples with the old tag become products with the replacement's tuples, or a set where the replacement is one."""
    if s.op != "list":
        return TagSet(s.op, s.members, tuple(relabel_set(p, old, new) for p in s.parts), s.name)
    has = [m for m in s.members if any(t.text == old for t in m)]
    if not has:
        return s
    rest = [m for m in s.members if m not in has]
    left = [tuple(t for t in m if t.text != old) for m in has]
    if new.op == "list":
        made = [(*m, *x) for m in left for x in new.members]
        return TagSet("list", tuple(dict.fromkeys(rest + made)), name=s.name)
    arms = [TagSet("list", tuple(rest))] if rest else []
    for m in left:
        arms.append(new if not m else TagSet("+", parts=(new, TagSet("list", (m,)))))
    return arms[0] if len(arms) == 1 else TagSet("or", parts=tuple(arms), name=s.name)


def relabel(g: Grammar, rules: Grammar | str) -> Grammar:
    """``g`` with the sets and rule targets relabelled."""
    for old, new in mappings(rules):
        g.sets = {n: relabel_set(s, old, new) for n, s in g.sets.items()}
        for r in g.rules():
            r.target = relabel_set(r.target, old, new)
    return g


def relabel_data(windows: DataFrame, rules: Grammar | str) -> DataFrame:
    """Token windows (``cohorts`` with ``rds``) with tags replaced by the first tuple of their mapping."""
    out = windows
    for old, new in mappings(rules):
        tags = F.array(*[F.lit(t.text) for t in (new.members[0] if new.members else ())])
        each = lambda r, old=old, tags=tags: F.flatten(F.transform(r, lambda x: F.when(x == old, tags).otherwise(F.array(x))))
        out = out.withColumn("cohorts", F.transform("cohorts", lambda c: F.struct(c["wf"].alias("wf"), F.transform(c["rds"], each).alias("rds"))))
    return out
