"""Between window rows and the kernel's objects."""

from __future__ import annotations

from lexiloom.plans.kernel import Cohort, Reading, Window, new_window


def _get(row, name, default=None):
    value = row.get(name) if isinstance(row, dict) else row[name]
    return default if value is None else value


def _items(value) -> list:
    return [] if value is None else list(value)


def _pairs(value) -> dict:
    """A map column arrives as a dict or as key-value pairs."""
    return dict(value.items() if isinstance(value, dict) else _items(value))


def reading_of(row) -> Reading:
    r = Reading(
        [str(t) for t in _items(row["tags"])], _get(row, "mapping", "") or "", bool(_get(row, "mapped", False)), bool(_get(row, "noprint", False)),
        bool(_get(row, "immutable", False)), hit_by=[int(x) for x in _items(row["hit_by"])], number=int(_get(row, "rno", 0) or 0),
    )
    subs = row["subs"]
    if subs is None or not len(subs):
        return r
    at = r
    for sub in subs:
        at.next = Reading([str(t) for t in _items(sub["tags"])], _get(sub, "mapping", "") or "")
        at = at.next
    return r


def window_of(row) -> Window:
    cohorts = []
    for x in _items(row["cohorts"]):
        c = Cohort(
            x["wordform"], [reading_of(r) for r in _items(x["readings"])], [str(t) for t in _items(x["static_tags"])],
            [reading_of(r) for r in _items(x["deleted"])], [reading_of(r) for r in _items(x["delayed"])], [reading_of(r) for r in _items(x["hidden"])],
            gid=int(_get(x, "gid", 0) or 0), dep_self=int(_get(x, "dep_self", 0) or 0),
            text=_get(x, "text", "") or "", wblank=_get(x, "wblank", "") or "",
        )
        parent = x["dep_parent"]
        c.dep_parent = None if parent is None or parent != parent else int(parent)
        if x["relations"] is not None and len(x["relations"]):
            c.relations = {k: {int(g) for g in _items(v)} for k, v in _pairs(x["relations"]).items()}
        c.removed = bool(_get(x, "removed", False))
        cohorts.append(c)
    w = new_window([c for c in cohorts if not c.removed])
    w.all = [w.cohorts[0], *cohorts]
    for c in cohorts:
        c.window = w
    w.text, w.text_post = _get(row, "text", "") or "", _get(row, "text_post", "") or ""
    w.flush_after = bool(_get(row, "flush_after", False))
    w.vars_set, w.vars_rem = _pairs(row["vars_set"]), [str(x) for x in _items(row["vars_rem"])]
    return w


def reading_row(r: Reading) -> dict:
    return {
        "rno": r.number, "tags": [t for t in r.tags if t != "<<<"], "mapping": r.mapping or None, "mapped": r.mapped, "noprint": r.noprint,
        "immutable": r.immutable, "hit_by": list(r.hit_by), "subs": [{"tags": list(s.tags), "mapping": s.mapping or None} for s in r.chain()[1:]],
    }


def window_row(doc_id, number: int, w: Window) -> dict:
    live = set(map(id, w.cohorts))
    return {
        "doc_id": doc_id, "win": number, "text": w.text, "text_post": w.text_post, "flush_after": w.flush_after,
        "vars_set": {**w.vars_set, **w.vars_out}, "vars_rem": list(w.vars_rem),
        "cohorts": [
            {
                "gid": c.gid, "wordform": c.wordform, "static_tags": list(c.static), "dep_self": c.dep_self, "dep_parent": c.dep_parent,
                "relations": {k: sorted(v) for k, v in sorted(c.relations.items())}, "text": c.text, "wblank": c.wblank,
                "removed": c.removed or id(c) not in live,
                "readings": [reading_row(r) for r in c.readings], "deleted": [reading_row(r) for r in c.deleted],
                "delayed": [reading_row(r) for r in c.delayed], "hidden": [reading_row(r) for r in c.ignored],
            }
            for c in w.all[1:]
        ],
    }
