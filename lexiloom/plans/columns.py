"""Grammars as Columns: sets, tests and rules over an array of cohorts.

A cohort is a struct of ``wf`` (word form) and ``rds`` (array of readings, each
an array of tags).  A test becomes a Column of the matched index, NULL if it
fails, so links compose.  A rule becomes a fold from left to right: places
before the current one are read as they are now, places after it as they were,
which is the sequential meaning; where no rule effect can be seen by a test,
the fold is replaced by a transform.

Everything stays within the row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.numeric import matches
from lexiloom.plans.grammar import Grammar, Rule, Tag, TagSet, Test, parse
from lexiloom.plans.kernel import MAX_PASSES
from lexiloom.sources.documents import let

SETTABLE = {"SELECT", "REMOVE", "IFF", "ADD", "MAP", "REPLACE", "SUBSTITUTE", "APPEND", "COPY"}


class NotSetBased(ValueError):
    """The plan needs the kernel."""


class View:
    """What tests see: a cohort by its place (from 0, NULL outside), and sets matched once per cohort.

    ``known`` has, by set and carefulness, a Column of booleans by place; ``bag`` all tags of the window; ``stops`` by
    scan a string with 1 for each place where it stops, in the scan's direction.
    """

    def __init__(
        self, at: Callable[[Column], Column], known: Callable[[TagSet, bool, Column], Column | None] = lambda *_: None, bag: Column | None = None,
        stops: Callable[[Test], Column | None] = lambda _: None,
    ) -> None:
        self.at, self.known, self.bag, self.stops = at, known, bag, stops

    def matches(self, s: TagSet, g: Grammar, j: Column, careful: bool = False) -> Column:
        found = self.known(s, careful, j)
        return cohort_matches(s, g, self.at(j), careful) if found is None else F.coalesce(found, F.lit(False))


def _within(tests: list[Test] | tuple[Test, ...], g: Grammar) -> list[Test]:
    """The tests and all that hang on them."""
    found = []
    for t in tests:
        inner = [*t.ors, *([t.link] if t.link else []), *([g.templates[t.template]] if t.template else [])]
        found += [t, *_within(inner, g)]
    return found


def matched_sets(tests: list[Test] | tuple[Test, ...], g: Grammar) -> list[tuple[TagSet, bool]]:
    """Each set that the tests match with cohorts, and whether carefully."""
    found: list[tuple[TagSet, bool]] = []
    for t in _within(tests, g):
        for s, careful in ((None if t.has("bag") else t.target, t.has("careful")), (t.barrier, False), (t.cbarrier, True)):
            if s is not None and (s, careful) not in found:
                found.append((s, careful))
    return found


def seen(tests: list[Test] | tuple[Test, ...], g: Grammar, all_of: Column, body: Callable[[View], Column]) -> Column:
    """``body`` with a view of unchanging cohorts: each set of the tests matched once per cohort, the bag built once."""
    pairs = matched_sets(tests, g)
    get = lambda j: F.get(all_of, j)

    scans = [t for t in reversed(_within(tests, g)) if stops_alike(t)]  # inner ones first, as outer ones ask them

    def bind(known: list[Column], bag: Column | None, marks: list[Column]) -> Column:
        if len(known) < len(pairs):
            s, careful = pairs[len(known)]
            return let(F.transform(all_of, lambda c: cohort_matches(s, g, c, careful)), lambda x: bind([*known, x], bag, marks))
        found = lambda s, careful, j: F.get(known[pairs.index((s, careful))], j) if (s, careful) in pairs else None
        view = View(get, found, bag, lambda t: next((m for x, m in zip(scans, marks) if _not_negated(x) == _not_negated(t)), None))
        if len(marks) < len(scans):
            t = scans[len(marks)]
            line = F.array_join(F.transform(all_of, lambda _, j: F.when(stops_at(t, g, j, j, F.size(all_of), view), "1").otherwise("0")), "")
            return let(F.reverse(line) if t.offset < 0 else line, lambda x: bind(known, bag, [*marks, x]))
        return body(view)

    if any(t.has("bag") for t in _within(tests, g)):
        return let(F.flatten(F.flatten(F.transform(all_of, lambda c: c["rds"]))), lambda bag: bind([], bag, []))
    return bind([], None, [])


# --- sets -------------------------------------------------------------------------------------


def tag(t: Tag, reading: Column, wf: Column) -> Column:
    pool = lambda: F.concat(F.array(wf), reading)
    if t.kind == "plain":
        text = t.text[2:-2] if t.text.startswith('"<') else t.text
        return (wf == text) if t.text.startswith('"<') else F.array_contains(reading, text)
    if t.kind == "any":
        return F.lit(True)
    if t.kind == "regex":
        pattern = ("(?i)" if t.icase else "") + t.pattern
        if t.text.startswith('"<'):
            return wf.rlike(pattern.replace('^"<', "^").replace('>"$', "$"))
        return F.exists(pool(), lambda x: x.rlike(pattern))
    if t.kind == "line":
        return F.array_join(pool(), " ").rlike(("(?i)" if t.icase else "") + t.pattern)
    if t.kind == "icase":
        if t.text.startswith('"<'):
            return F.lower(wf) == t.text[2:-2].lower()
        return F.exists(pool(), lambda x: F.lower(x) == t.text.lower())
    if t.kind == "numeric":
        pattern = r"^<([^<>=:!]+?)(<>|><|<=|>=|=<|=>|!=|=|:|<|>)([-+0-9.]+)>$"
        mine = F.filter(reading, lambda x: (F.regexp_extract(x, pattern, 1) == t.key))
        last = F.get(mine, F.size(mine) - 1)
        op = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(last, pattern, 2), "^(<>|><)$", "!="), "^=([<>])$", "$1="), "^:$", "=")
        return F.coalesce(matches(t.op, F.lit(float(t.value)), op, F.regexp_extract(last, pattern, 3).try_cast("double")), F.lit(False))
    raise NotSetBased(f"tag {t.text}")


def tag_set(s: TagSet, g: Grammar, reading: Column, wf: Column) -> Column:
    if s.op == "list":
        fails = [tag(t, reading, wf) for m in s.members for t in m if t.failfast]
        arms = []
        for m in s.members:
            plain = [t for t in m if not t.failfast]
            if plain:
                arms.append(_all([tag(t, reading, wf) for t in plain]))
        hit = _any(arms)
        return hit & ~_any(fails) if fails else hit
    if s.op == "name":
        if s.name not in g.sets:
            raise NotSetBased(f"set {s.name} is not defined")
        return tag_set(g.sets[s.name], g, reading, wf)
    if s.op == "or":
        rest = F.lit(False)
        for part in reversed(s.parts):
            if part.op == "^":
                left, right = (tag_set(p, g, reading, wf) for p in part.parts)
                rest = ~right & (left | rest)
            else:
                rest = tag_set(part, g, reading, wf) | rest
        return rest
    if s.op in ("+", "-", "^"):
        left, right = (tag_set(p, g, reading, wf) for p in s.parts)
        return left & right if s.op == "+" else left & ~right
    raise NotSetBased(f"set operator {s.op}")


def _all(columns: list[Column]) -> Column:
    out = columns[0] if columns else F.lit(True)
    for c in columns[1:]:
        out = out & c
    return out


def _any(columns: list[Column]) -> Column:
    out = columns[0] if columns else F.lit(False)
    for c in columns[1:]:
        out = out | c
    return out


# --- tests ------------------------------------------------------------------------------------


def cohort_matches(s: TagSet, g: Grammar, cohort: Column, careful: bool = False) -> Column:
    some = F.forall if careful else F.exists
    good = some(cohort["rds"], lambda r: tag_set(s, g, r, cohort["wf"]))
    return F.coalesce(good & (F.size(cohort["rds"]) > 0) if careful else good, F.lit(False))


def test(t: Test, g: Grammar, i: Column, size: Column, view: View) -> Column:
    """The index where the chain of ``t`` ends, begun at ``i``; NULL if it fails."""
    if t.template:
        t = Test(ors=(g.templates[t.template],), flags=t.flags, link=t.link)
    if t.has("NEGATE"):
        inner = Test(**{**t.__dict__, "flags": t.flags - {"NEGATE"}})
        return F.when(test(inner, g, i, size, view).isNull(), i)
    if t.ors:
        found = F.coalesce(*[test(x, g, i, size, view) for x in t.ors])
        if t.has("NOT", "NONE"):
            found = F.when(found.isNull(), i)
        return _link(t, g, found, size, view)
    unknown = t.flags - {"NOT", "NONE", "ALL", "careful", "scan", "scan_all", "absolute", "self", "nobarrier", "bag"}
    if unknown or t.relation or t.sub or t.jump:
        raise NotSetBased(f"position {sorted(unknown)}")
    good_at = lambda j: view.matches(t.target, g, j, t.has("careful")) if t.target else F.lit(True)
    if t.has("bag"):
        every = view.bag
        if every is None:
            every = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.flatten(view.at(j)["rds"])))
        hit = F.coalesce(tag_set(t.target, g, every, F.lit("")), F.lit(False))
        return _link(t, g, F.when(~hit if t.has("NOT", "NONE") else hit, i), size, view)
    if t.has("absolute"):
        start = F.lit(t.offset - 1) if t.offset >= 0 else size + t.offset
    else:
        start = i + t.offset
    if not t.has("scan", "scan_all"):
        def at(j: Column) -> Column:
            inside = (j >= 0) & (j < size)
            if t.has("NOT", "NONE"):
                reached = F.when(inside & ~good_at(j), j)
                found = _link(t, g, reached, size, view)
                return F.coalesce(found, F.when(~inside, i)) if t.link is None else found
            return _link(t, g, F.when(inside & good_at(j), j), size, view)

        return let(start, at)
    if t.offset == 0 and not t.has("absolute"):
        raise NotSetBased("scan in both directions")
    stop = nearest_stop(t, g, i, start, size, view)
    if t.has("NOT", "NONE", "ALL"):
        if t.link is not None:
            raise NotSetBased("a link after a scan for none or all")
        met = F.when(stop.isNull(), F.lit(True)).otherwise(let(stop, lambda j: good_at(j) if t.has("ALL") else ~good_at(j)))
        if t.has("NOT", "NONE"):
            return F.when(met, i)
        return F.when(met & (F.lit(True) if t.has("self") else (start >= 0) & (start < size)), i)
    if t.has("scan_all") or t.barrier is not None or t.cbarrier is not None:
        return let(stop, lambda j: _link(t, g, F.when(j.isNotNull() & good_at(j), j), size, view))
    return let(stop, lambda j: _link(t, g, j, size, view))


def _not_negated(t: Test) -> Test:
    return Test(**{**t.__dict__, "flags": t.flags - {"NEGATE"}})


def stops_alike(t: Test) -> bool:
    """Whether a test is a scan that stops at the same places wherever it begins."""
    known = {"NEGATE", "NOT", "NONE", "ALL", "careful", "scan", "scan_all", "self"}
    return t.has("scan", "scan_all") and t.offset != 0 and not (t.flags - known or t.template or t.ors or t.relation or t.sub or t.jump)


def stops_at(t: Test, g: Grammar, i: Column, j: Column, size: Column, view: View) -> Column:
    """Whether a scan from ``i`` stops at ``j``."""
    good = view.matches(t.target, g, j, t.has("careful")) if t.target else F.lit(True)
    if t.has("NOT", "NONE", "ALL"):
        # a scan for none stops at what it forbids, one for all at what isn't so
        good = good if not t.has("ALL") or t.has("NOT", "NONE") else ~good
    elif t.has("scan_all"):
        good = _link(t, g, F.when(good, j), size, view).isNotNull()
    bars = []
    if t.barrier is not None:
        bars.append(view.matches(t.barrier, g, j))
    if t.cbarrier is not None:
        bars.append(view.matches(t.cbarrier, g, j, True))
    bar = _any(bars)
    return (good | (bar & (j != i) if t.has("nobarrier") else bar)) if bars else good


def nearest_stop(t: Test, g: Grammar, i: Column, start: Column, size: Column, view: View) -> Column:
    """The first place at which a scan from ``i`` stops, NULL if it comes to the window's end."""
    marks, left = view.stops(t), t.offset < 0
    if marks is not None:
        # found by searching a string: filtering the places of each scan would look at every one of them
        place = (lambda k: size - k) if left else (lambda k: k - 1)
        at = lambda k: F.call_function("locate", F.lit("1"), marks, size - k if left else k + 1)
        found = let(at(start), lambda k: F.when(k > 0, place(k)))
        return F.when(place(at(i)) == i, i).otherwise(found) if t.has("self") else found
    places = F.when(start >= 0, F.sequence(start, F.lit(0), F.lit(-1))) if left else F.when(start < size, F.sequence(start, size - 1, F.lit(1)))
    if t.has("self"):
        places = F.concat(F.array(i), F.coalesce(places, F.array().cast("array<int>")))
    places = F.coalesce(places, F.array().cast("array<int>"))
    return F.get(F.filter(places, lambda j: stops_at(t, g, i, j, size, view)), F.lit(0))


def _link(t: Test, g: Grammar, found: Column, size: Column, view: View) -> Column:
    if t.link is None:
        return found
    return let(found, lambda j: F.when(j.isNotNull(), test(t.link, g, j, size, view)))


# --- rules ------------------------------------------------------------------------------------


def _literals(s: TagSet, g: Grammar) -> list[str]:
    if s.op == "name":
        return _literals(g.sets[s.name], g)
    if s.op == "or":
        return [x for p in s.parts for x in _literals(p, g)]
    if s.op != "list" or any(t.kind not in ("plain", "any") for t in s.tags()):
        raise NotSetBased("tags made from matches")
    return [t.text for t in s.tags()]


def _array(tags: list[str]) -> Column:
    return F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")


def edit(rule: Rule, g: Grammar, cohort: Column, allowed: Column, matched: Callable[[Column], Column]) -> Column:
    """The cohort's readings after the rule; ``allowed`` says whether its tests hold."""
    rds = cohort["rds"]
    hits = F.size(F.filter(rds, matched))
    some, n = hits > 0, F.size(rds)
    keep, drop = F.filter(rds, matched), F.filter(rds, lambda r: ~matched(r))
    unsafe = "UNSAFE" in rule.flags
    if rule.kind == "SELECT":
        return F.when(allowed & some & (hits < n), keep).otherwise(rds)
    if rule.kind == "REMOVE":
        return F.when(allowed & some & ((hits < n) | F.lit(unsafe)), drop).otherwise(rds)
    if rule.kind == "IFF":
        return F.when(some & (hits < n), F.when(allowed, keep).otherwise(drop)).otherwise(rds)
    new = _literals(rule.maplist or rule.target, g)
    maps, plain = [x for x in new if x.startswith(g.prefix)], [x for x in new if not x.startswith(g.prefix) and x != "*"]
    if rule.kind in ("ADD", "MAP"):
        if rule.place is not None:
            raise NotSetBased("a place within the reading")
        free = lambda r: ~F.exists(r, lambda x: x.startswith(g.prefix)) if maps or rule.kind == "MAP" else F.lit(True)
        put = lambda r: F.concat(r, F.array_except(_array(plain), r)) if plain else r
        each = lambda r: F.array(*[F.concat(put(r), _array([m])) for m in maps]) if maps else F.array(put(r))
        return F.when(allowed, F.flatten(F.transform(rds, lambda r: F.when(matched(r) & free(r), each(r)).otherwise(F.array(r))))).otherwise(rds)
    if rule.kind == "REPLACE":
        return F.when(allowed, F.transform(rds, lambda r: F.when(matched(r), _array(plain + maps[:1])).otherwise(r))).otherwise(rds)
    if rule.kind == "SUBSTITUTE":
        old = _literals(rule.sublist or rule.target, g)
        if old == ["*"]:
            changed = lambda r: F.concat(r, F.array_except(_array(plain), r))
        else:
            def changed(r: Column) -> Column:
                at = F.array_position(F.transform(r, lambda x: x.isin(old)), True)
                front = F.slice(r, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))
                rest = F.filter(F.slice(r, F.greatest(at, F.lit(1)).cast("int"), F.size(r)), lambda x: ~x.isin(old))
                return F.when(at > 0, F.concat(front, _array(plain + maps[:1]), rest)).otherwise(r)
        return F.when(allowed, F.transform(rds, lambda r: F.when(matched(r), changed(r)).otherwise(r))).otherwise(rds)
    if rule.kind == "APPEND":
        return F.when(allowed & some, F.concat(rds, F.array(_array(new)))).otherwise(rds)
    if rule.kind == "COPY":
        drop_tags = _literals(rule.except_list, g) if rule.except_list else []
        less = lambda r: F.filter(r, lambda x: ~x.isin(drop_tags)) if drop_tags else r
        made = lambda r: F.concat(less(r), F.array_except(_array(plain + maps[:1]), r))
        return F.when(allowed, F.flatten(F.transform(rds, lambda r: F.when(matched(r), F.array(r, made(r))).otherwise(F.array(r))))).otherwise(rds)
    raise NotSetBased(rule.kind)


def plain_tags(s: TagSet | None, g: Grammar) -> set[str] | None:
    """The tags a set reads; None if it may read any."""
    if s is None:
        return set()
    if s.op == "name":
        return plain_tags(g.sets[s.name], g) if s.name in g.sets else None
    if s.op == "list":
        return {t.text for t in s.tags()} if all(t.kind == "plain" for t in s.tags()) else None
    out: set[str] = set()
    for p in s.parts:
        got = plain_tags(p, g)
        if got is None or s.op not in ("or", "+"):
            return None
        out |= got
    return out


def sees_itself(rule: Rule, g: Grammar) -> bool:
    """Whether a test may read at another cohort what the rule changes."""
    def tests(ts):
        for t in ts:
            yield t
            yield from tests([*t.ors, *([t.link] if t.link else []), *([g.templates[t.template]] if t.template else [])])

    away = [t for t in tests(rule.tests) if t.offset or t.has("scan", "scan_all", "absolute", "bag") or t.link]
    if not away:
        return False
    if rule.kind not in ("ADD", "MAP"):
        return True
    added = set(_literals(rule.maplist or rule.target, g))
    for t in away:
        for s in (t.target, t.barrier, t.cbarrier):
            read = plain_tags(s, g)
            if t.has("careful") or t.cbarrier is not None or read is None or read & added:
                return True
    return False


def only_takes(rule: Rule, g: Grammar) -> bool:
    """Whether the rule only takes readings away and its tests only ask for readings: a test that fails at first never holds later."""
    if rule.kind not in ("SELECT", "REMOVE"):
        return False
    asks = lambda t: not (
        t.has("NOT", "NONE", "NEGATE", "ALL", "careful", "bag") or t.barrier is not None or t.cbarrier is not None or t.has("scan") and t.link is not None
    )
    return all(asks(t) for t in _within(rule.tests, g))


def run_rule(rule: Rule, g: Grammar, cohorts: Column) -> Column:
    """The cohorts after one rule."""
    if rule.kind not in SETTABLE or rule.sub or rule.flags - {"SAFE", "UNSAFE", "ITERATE", "NOITERATE"} or rule.nested or rule.dep_tests or rule.place:
        raise NotSetBased(rule.kind)

    def hit_of(c: Column) -> Callable[[Column], Column]:
        target = lambda r: F.coalesce(tag_set(rule.target, g, r, c["wf"]), F.lit(False))
        if rule.wordform is None:
            return target
        shape = tag(rule.wordform, F.array().cast("array<string>"), c["wf"])
        return lambda r: shape & target(r)

    def possible_at(c: Column) -> Column:
        """Whether the rule, its tests aside, can change the cohort."""
        some = F.exists(c["rds"], hit_of(c))
        return (F.size(c["rds"]) > 1) & some if rule.kind in ("SELECT", "REMOVE", "IFF") and "UNSAFE" not in rule.flags else some

    def changed(c: Column, i: Column, size: Column, view: View) -> Column:
        goods = [test(t, g, i, size, view).isNotNull() for t in rule.tests]
        allowed = F.coalesce(_all(goods), F.lit(False)) if goods else F.lit(True)
        return F.struct(c["wf"].alias("wf"), edit(rule, g, c, allowed, hit_of(c)).alias("rds"))

    def at_once(all_of: Column) -> Column:
        one = lambda view: lambda c, i: F.when(possible_at(c), changed(c, i, F.size(all_of), view)).otherwise(c)
        return seen(rule.tests, g, all_of, lambda view: F.transform(all_of, one(view)))

    def in_turn(all_of: Column) -> Column:
        def step(may: Column) -> Callable[[Column, Column], Column]:
            at = lambda done, i: lambda j: F.when(j < i, F.get(done, j)).otherwise(F.get(all_of, j))
            one = lambda done, c, i: F.when(F.get(may, i), changed(c, i, F.size(all_of), View(at(done, i)))).otherwise(c)
            return lambda done, c: let(F.size(done), lambda i: F.concat(done, F.array(one(done, c, i))))

        def fold(may: Column) -> Column:
            # without a place where the rule can do something there is nothing to fold
            return F.when(F.array_contains(may, True), F.aggregate(all_of, F.slice(all_of, F.lit(1), F.lit(0)), step(may))).otherwise(all_of)

        if not only_takes(rule, g):
            return let(F.transform(all_of, possible_at), fold)

        def begins(c: Column, i: Column, view: View) -> Column:
            goods = [test(t, g, i, F.size(all_of), view).isNotNull() for t in rule.tests]
            return possible_at(c) & F.coalesce(_all(goods), F.lit(False))

        return let(seen(rule.tests, g, all_of, lambda view: F.transform(all_of, lambda c, i: begins(c, i, view))), fold)

    # bound once: an inlined column would be computed anew for every place
    return let(cohorts, in_turn if sees_itself(rule, g) else at_once)


def apply_columns(windows: DataFrame, grammar: str | Grammar, passes: int = 1) -> DataFrame:
    """``windows`` (with ``cohorts``) after the grammar's rules, each section's rules ``passes`` times in order.

    A later pass only changes windows that have not settled; use
    :func:`to_fixpoint` where the number of passes isn't known.
    """
    g = parse(grammar) if isinstance(grammar, str) else grammar
    out = windows
    for rules in ([g.before] if g.before else []) + [sum(g.sections[: n + 1], []) for n in range(len(g.sections))] + ([g.after] if g.after else []):
        for _ in range(passes):
            for rule in rules:
                out = out.withColumn("cohorts", run_rule(rule, g, F.col("cohorts")))
    return out


def _passes(g: Grammar, cohorts: Column, n: int) -> Column:
    """struct of ``cohorts`` after up to ``n`` passes, and ``same``: whether the last pass changed nothing."""
    rules = g.before + [r for k in range(len(g.sections)) for r in sum(g.sections[: k + 1], [])] + g.after

    def one(old: Column) -> Column:
        new = old
        for rule in rules:
            new = run_rule(rule, g, new)
        return let(new, lambda c: F.struct(c.alias("cohorts"), (c == old).alias("same")))

    begin = F.struct(cohorts.alias("cohorts"), F.lit(False).alias("same"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), begin, lambda at, _: F.when(at["same"], at).otherwise(one(at["cohorts"])))


def to_fixpoint(windows: DataFrame, grammar: str | Grammar, max_runs: int = MAX_PASSES) -> DataFrame:
    """Runs the grammar's sections until no window changes, and raises if one still does after ``max_runs`` passes.

    Passes are run in the row, twice as many each time; settled windows drop out in between.
    """
    from lexiloom.storage import materialize

    g = parse(grammar) if isinstance(grammar, str) else grammar
    done, live, runs = None, windows, 0
    while runs < max_runs:
        n = min(max(runs, 1), max_runs - runs)
        found = live.withColumn("passed", _passes(g, F.col("cohorts"), n))
        stepped = materialize(found.withColumns({"cohorts": F.col("passed.cohorts"), "same": F.col("passed.same")}).drop("passed"), "section")
        runs += n
        settled = stepped.filter("same").drop("same")
        done = settled if done is None else done.unionByName(settled)
        live = stepped.filter(~F.col("same")).drop("same")
        if live.isEmpty():
            return done
    raise RuntimeError(f"windows still change after {max_runs} passes")
