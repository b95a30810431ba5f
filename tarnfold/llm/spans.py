"""Matches of a pattern with their places, in DataFrame expressions only.

Spark has no function for the places of all matches.  The stretches between matches (``split``) and the
matches themselves (``regexp_extract_all``) come from the same scan order, so running sums of their
lengths are the places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(steps: Column) -> Column:
    """Inclusive running sums of an array<int>, by blocks of about sqrt(n), as arrays can't be appended to in place."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def from_blocks(l: Column, b: Column, sums: Column) -> Column:
        block = lambda i: F.floor(i / b).cast("int")
        one = lambda i: total(F.slice(sums, F.lit(1), block(i))) + total(F.slice(l, block(i) * b + 1, i - block(i) * b + 1))
        return F.transform(F.sequence(F.lit(0), F.size(l) - 1), one)

    def blocks(l: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(l))).cast("int")
        parts = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / b).cast("int")), lambda k: total(F.slice(l, k * b + 1, b)))
        return let(width, lambda b: let(parts(b), lambda sums: from_blocks(l, b, sums)))

    return let(steps, lambda l: F.when(F.size(l) > 0, blocks(l)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<start int, end int, m string>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pattern must match no empty text; where ``guard`` is false there is none.
    """

    def place(gaps: Column, found: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.char_length(g) + F.char_length(m))
        return F.zip_with(running_sums(steps), found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("m")))

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    all_ = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(F.split(text, pattern, -1), found)).otherwise(none))
    return all_ if guard is None else F.when(guard, all_).otherwise(none)


def ranked(spans: Column, kind: int) -> Column:
    """struct<start, kind, end> of each match, which sorts as spans are listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
