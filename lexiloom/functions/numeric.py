"""Numeric tags and their arithmetic, for rows in Python and as Columns."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.plans.grammar import number, numeric_parts

_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def numeric_tags(tags: list[str]) -> Iterator[tuple[str, str, str, float]]:
    """(tag, key, comparison, value) of the numeric ones."""
    for t in tags:
        if t.startswith("<") and (parts := numeric_parts(t)) is not None:
            value = number(parts[2])
            if value is not None:
                yield t, parts[0], parts[1], value


def compare(want_op: str, want: float, have_op: str, have: float) -> bool:
    """Whether two numeric tags can mean the same number.

    A tag stands for a range; ranges match where they meet.  Two exclusions
    match only if they exclude the same number.
    """
    if want_op == "!=" and have_op == "!=":
        return want == have
    if want_op == "=":
        return _OPS[have_op](want, have)
    if have_op == "=":
        return _OPS[want_op](have, want)
    if "!=" in (want_op, have_op) or want_op[0] == have_op[0]:
        return True
    low, high = (want, have) if want_op[0] == ">" else (have, want)
    return low <= high if want_op.endswith("=") and have_op.endswith("=") else low < high


# --- arithmetic -------------------------------------------------------------------------------

#: Function names by what they compute.
FUNCTIONS: dict[str, Callable[[float], float]] = {
    "SIN": math.sin, "COS": math.cos, "TAN": math.tan, "ASIN": math.asin, "ACOS": math.acos, "ATAN": math.atan,
    "SINH": math.sinh, "COSH": math.cosh, "TANH": math.tanh, "ASINH": math.asinh, "ACOSH": math.acosh, "ATANH": math.atanh,
    "LN": math.log, "LOG": math.log10, "EXP": math.exp, "SQRT": math.sqrt, "SQR": lambda x: x * x,
    "ROUND": lambda x: math.copysign(math.floor(abs(x) + 0.5), x), "FLOOR": math.floor,
}
COLUMN_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh,
    "TANH": F.tanh, "ASINH": F.asinh, "ACOSH": F.acosh, "ATANH": F.atanh, "LN": F.ln, "LOG": F.log10, "EXP": F.exp, "SQRT": F.sqrt,
    "SQR": lambda x: x * x, "ROUND": lambda x: F.round(x), "FLOOR": lambda x: F.floor(x).cast("double"),
}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z]+)|(.))")


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if not a or math.isnan(a) else math.copysign(math.inf, a)


class Expression:
    """A parsed formula: sums, products, left-associative powers, signs, calls, MIN and MAX, letters and assignment."""

    def __init__(self, text: str) -> None:
        self.tokens = [m.groups() for m in _TOKEN.finditer(text) if m[0].strip()]
        self.at = 0
        self.tree = self.assignment()
        if self.at != len(self.tokens):
            raise ValueError(f"bad formula {text!r}")

    def mark(self) -> str:
        return self.tokens[self.at][2] or "" if self.at < len(self.tokens) else ""

    def assignment(self):
        if self.at + 1 < len(self.tokens) and self.tokens[self.at][1] and self.tokens[self.at + 1][2] == "=":
            name = self.tokens[self.at][1]
            self.at += 2
            return ("let", name, self.assignment())
        return self.sum()

    def chain(self, below, marks):
        left = below()
        while self.mark() and self.mark() in marks:
            mark = self.mark()
            self.at += 1
            left = (mark, left, below())
        return left

    def sum(self):
        return self.chain(self.product, "+-")

    def product(self):
        return self.chain(self.power, "*/")

    def power(self):
        return self.chain(self.sign, "^")

    def sign(self):
        if self.mark() and self.mark() in "+-":
            mark = self.mark()
            self.at += 1
            inner = self.sign()
            return ("neg", inner) if mark == "-" else inner
        return self.atom()

    def atom(self):
        if self.at >= len(self.tokens):
            raise ValueError("a formula ends too early")
        digits, name, mark = self.tokens[self.at]
        self.at += 1
        if digits:
            return ("num", float(digits))
        if mark == "(":
            inner = self.sum()
            if self.mark() != ")":
                raise ValueError("a bracket is not closed")
            self.at += 1
            return inner
        if name and self.mark() == "(":
            return ("call", name.upper(), self.atom())
        if name:
            return ("name", name)
        raise ValueError(f"unexpected {mark!r} in a formula")

    def value(self, names: dict[str, float]) -> float:
        return self._value(self.tree, names)

    def _value(self, node, names: dict[str, float]) -> float:
        kind = node[0]
        if kind == "num":
            return node[1]
        if kind == "name":
            return names.get(node[1], names.get(node[1].upper(), 0.0))
        if kind == "neg":
            return -self._value(node[1], names)
        if kind == "let":
            names[node[1]] = self._value(node[2], names)
            return names[node[1]]
        if kind == "call":
            try:
                return float(FUNCTIONS[node[1]](self._value(node[2], names)))
            except (ValueError, OverflowError):
                return math.nan
        a, b = self._value(node[1], names), self._value(node[2], names)
        if kind == "/":
            return _divide(a, b)
        try:
            return float({"+": operator.add, "-": operator.sub, "*": operator.mul, "^": math.pow}[kind](a, b))
        except (ValueError, OverflowError):
            return math.nan

    def column(self, names: dict[str, Column]) -> Column:
        return self._column(self.tree, names)

    def _column(self, node, names: dict[str, Column]) -> Column:
        kind = node[0]
        if kind == "num":
            return F.lit(node[1])
        if kind == "name":
            return names[node[1]].cast("double")
        if kind == "neg":
            return -self._column(node[1], names)
        if kind == "let":
            names[node[1]] = self._column(node[2], names)
            return names[node[1]]
        if kind == "call":
            return COLUMN_FUNCTIONS[node[1]](self._column(node[2], names))
        a, b = self._column(node[1], names), self._column(node[2], names)
        if kind == "/":
            by_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
            return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))
        return {"+": a + b, "-": a - b, "*": a * b, "^": F.pow(a, b)}[kind]


def evaluate(text: str, bounds: Callable[[], tuple[float, float]]) -> float | None:
    """A numeric tag's value: a number, or a formula in which MIN and MAX are a cohort's extremes."""
    try:
        return float(text)
    except ValueError:
        low, high = bounds()
        try:
            return Expression(text).value({"MIN": low, "MAX": high})
        except ValueError:
            return None


def formula(text: str, **names: Column) -> Column:
    """A formula as a Column over named Columns."""
    return Expression(text).column(dict(names))


def matches(want_op: str, want: Column, have_op: Column, have: Column) -> Column:
    """:func:`compare` as a Column; the data's comparison is a Column, the query's is known."""
    result = F.lit(False)
    for op in ("=", "!=", "<", "<=", ">", ">="):
        if want_op == "!=" and op == "!=":
            good = want == have
        elif want_op == "=":
            good = _OPS[op](want, have)
        elif op == "=":
            good = _OPS[want_op](have, want)
        elif "!=" in (want_op, op) or want_op[0] == op[0]:
            good = F.lit(True)
        else:
            low, high = (want, have) if want_op[0] == ">" else (have, want)
            good = low <= high if want_op.endswith("=") and op.endswith("=") else low < high
        result = F.when(have_op == op, good).otherwise(result)
    return result
