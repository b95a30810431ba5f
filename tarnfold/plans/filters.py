"""The filter language: comparisons of dotted JSON paths with literals, joined by AND and OR.

    query  := all (" OR " all)*          AND binds tighter; there are no parentheses and no NOT
    all    := test (" AND " test)*
    test   := path op literal            op: >= <= != == = > < CONTAINS
    literal: quoted text, true, false, null, a number, or bare text

The default reading respects quotes: what is quoted is never split, and of several operators the first
counts.  ``compat=True`` reads like the original: it splits inside quotes too, and looks for operators in
the order above anywhere in the test.

Logic is two-valued.  A test against a missing member or another type is false, but for ``!=``, which is
true for both.  Equal numbers are those less than 1e-9 apart; orders are exact.  A document that isn't
valid JSON matches nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import member

TOLERANCE = 1e-9
#: The operators, in the order in which the compat reading looks for them.
OPERATORS = (">=", "<=", "!=", "==", "=", ">", "<", " CONTAINS ", " contains ")
_FLOAT = re.compile(r"[+-]?(inf|infinity|nan|([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)$", re.IGNORECASE)


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Test:
    path: str
    op: str
    value: str | float | bool | None


def parse_literal(text: str) -> str | float | bool | None:
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t.lower() in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[t.lower()]
    return float(t) if _FLOAT.match(t) else t


def _outside_quotes(text: str) -> list[bool]:
    """For each character, whether it stands outside quoted literals.  A quote opens a literal only where one can begin: after an operator."""
    out, quote = [], ""
    for i, c in enumerate(text):
        if quote:
            out.append(False)
            quote = "" if c == quote else quote
        elif c in "\"'" and re.search(r"([<>=]|\s(CONTAINS|contains))\s*$", text[:i]):
            out.append(False)
            quote = c
        else:
            out.append(True)
    return out


def _split(text: str, word: str, compat: bool) -> list[str]:
    if compat:
        return text.split(word)
    free, parts, start = _outside_quotes(text), [], 0
    for m in re.finditer(re.escape(word), text):
        if free[m.start()] and m.start() >= start:
            parts.append(text[start : m.start()])
            start = m.end()
    return [*parts, text[start:]]


def _parse_test(text: str, compat: bool) -> Test:
    if compat:
        found = next(((text.find(op), op) for op in OPERATORS if op in text), None)
    else:
        free = _outside_quotes(text)
        spots = [(i, -len(op), op) for op in OPERATORS for i in (m.start() for m in re.finditer(re.escape(op), text)) if free[i]]
        found = (min(spots)[0], min(spots)[2]) if spots else None
    if not found:
        raise FilterError(f"no operator in {text!r}")
    at, op = found
    path, literal = text[:at].strip(), text[at + len(op) :].strip()
    if not path or not literal:
        raise FilterError(f"a path and a literal are needed in {text!r}")
    return Test(path, {"==": "="}.get(op.strip(), op.strip().upper()), parse_literal(literal))


def parse_filter(text: str, compat: bool = False) -> list[list[Test]]:
    """Alternatives of tests that must all hold."""
    if not text.strip():
        raise FilterError("the filter is blank")
    return [[_parse_test(t, compat) for t in _split(part, " AND ", compat)] for part in _split(text.strip(), " OR ", compat)]


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equal(m, value) -> Column:
    if value is None:
        return m.null
    if isinstance(value, bool):
        return _false(m.boolean == value)
    if isinstance(value, str):
        return _false(m.string == value)
    return _false(F.abs(m.number - F.lit(value)) < TOLERANCE) if math.isfinite(value) else F.lit(False)


def _test(m, valid: Column, t: Test) -> Column:
    """One test on a member (or on promoted columns of the same shape)."""
    if t.op == "=":
        return _equal(m, t.value)
    if t.op == "!=":
        if isinstance(t.value, float) and math.isnan(t.value):
            return valid & m.number.isNull()  # no number differs from NaN by 1e-9 or more
        return valid & ~_equal(m, t.value)
    if t.op == "CONTAINS":
        if not isinstance(t.value, str):
            return F.lit(False)
        holds = lambda e: _false((F.schema_of_variant(e) == "STRING") & (F.try_variant_get(e, "$", "string") == t.value))
        return _false(F.contains(m.string, F.lit(t.value))) | _false(F.exists(m.elements, holds))
    if isinstance(t.value, bool) or not isinstance(t.value, float) or math.isnan(t.value):
        return F.lit(False)
    if math.isinf(t.value):  # every number is below infinity
        return _false(m.number.isNotNull() & F.lit((t.value > 0) == (t.op[0] == "<")))
    x, y = m.number, F.lit(t.value)
    return _false({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[t.op])


def _plain(column: Column, kind: str, t: Test) -> Column:
    """A test on a promoted column, in a form that the scan can take over: null may stand for false."""
    numeric, v = kind in ("tinyint", "smallint", "int", "bigint", "float", "double"), t.value
    of_type = isinstance(v, float) if numeric else isinstance(v, bool) if kind == "boolean" else isinstance(v, str)
    nan = isinstance(v, float) and math.isnan(v)
    if t.op in (">", ">=", "<", "<="):
        if not (numeric and of_type) or nan:
            return F.lit(False)
        return {">": column > v, ">=": column >= v, "<": column < v, "<=": column <= v}[t.op]
    if t.op == "CONTAINS":
        return F.contains(column, F.lit(v)) if kind == "string" and of_type else F.lit(False)
    if not of_type:
        return F.lit(t.op == "!=")
    if nan:
        return column.isNull() if t.op == "!=" else F.lit(False)
    if numeric and math.isinf(v):
        return F.lit(t.op == "!=")
    if t.op == "=":
        return (column > v - TOLERANCE) & (column < v + TOLERANCE) if numeric else column == v
    other = (column <= v - TOLERANCE) | (column >= v + TOLERANCE) if numeric else column != v
    return column.isNull() | other


def compile_filter(query: str | list[list[Test]], v: Column, promoted: dict[str, tuple[Column, str]] | None = None, compat: bool = False) -> Column:
    """A condition on documents ``v`` (VARIANT).

    ``promoted`` maps paths to typed columns of the table (column, type), which hold the member where it
    has that type and null where it is missing; tests on them reach the file scan.  The result is a
    condition for ``where``: on promoted columns null may stand for false.
    """
    tests = parse_filter(query, compat) if isinstance(query, str) else query
    valid = v.isNotNull()
    members: dict = {}

    def one(t: Test) -> Column:
        if promoted and t.path in promoted and not (t.value is None):
            return _plain(*promoted[t.path], t)
        if t.path not in members:
            members[t.path] = member(v, t.path)
        return _test(members[t.path], valid, t)

    either = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [one(t) for t in part]) for part in tests])
    on_columns = promoted is not None and all(t.path in promoted and t.value is not None for part in tests for t in part)
    return either if on_columns else valid & either
