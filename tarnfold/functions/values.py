"""Values of JSON documents, as VARIANT.

Spark converts freely between JSON types when it reads a path; the filter language compares numbers with
numbers and strings with strings only.  So every read is guarded by the type that the value really has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A decimal number in a string, as a whole.
NUMBER_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: The members that may name a document, in this order.
LABELS = ("key", "name", "username", "player_name", "user", "player", "id", "title", "label", "uuid")


def allow_repeated_members(spark: SparkSession) -> None:
    """Of repeated members the last counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def document(raw: Column) -> Column:
    """The VARIANT of a JSON text; null if it is invalid, blank, or followed by anything else.

    A parser that stops after the first value would take ``{} x``, so the text is parsed as the only element of an array.
    """
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    only = F.transform(F.array(whole), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))  # names the parsed text once
    return F.get(only, F.lit(0))


def json_path(path: str) -> str | None:
    """A dotted path as JSONPath; None if it can't be written so."""
    out = "$"
    for part in path.split("."):
        quote = "'" if "'" not in part else '"'
        if quote in part or "\\" in part:
            return None
        out += f"[{quote}{part}{quote}]"
    return out


@dataclass(frozen=True)
class Member:
    """A member's value by type: null unless it is of that type.  ``kind`` is Spark's name of the type, VOID for JSON null, null if missing."""

    kind: Column
    number: Column
    string: Column
    boolean: Column
    elements: Column

    @property
    def null(self) -> Column:
        return F.coalesce(self.kind == "VOID", F.lit(False))


def member(v: Column, path: str) -> Member:
    p = json_path(path)
    if p is None:
        none = lambda t: F.lit(None).cast(t)
        return Member(none("string"), none("double"), none("string"), none("boolean"), F.lit(None).cast("array<variant>"))
    kind = F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    number = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, p, "double"))
    return Member(
        kind,
        F.when(F.abs(number) < float("inf"), number),
        F.when(kind == "STRING", F.try_variant_get(v, p, "string")),
        F.when(kind == "BOOLEAN", F.try_variant_get(v, p, "boolean")),
        F.when(kind.startswith("ARRAY"), F.try_variant_get(v, p, "array<variant>")),
    )


def numeric(v: Column, path: str) -> Column:
    """A number, or a string that is one as a whole; else null."""
    m = member(v, path)
    parsed = F.when(m.string.rlike(NUMBER_TEXT), m.string.try_cast("double"))
    return F.coalesce(m.number, F.when(F.abs(parsed) < float("inf"), parsed))


def score(v: Column, path: str) -> Column:
    """What a leaderboard ranks by: a number at the path; strings never count."""
    return member(v, path).number


#: White space at either end, of any script.
OUTER_SPACE = r"(?U)^\s+|\s+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_SPACE, "")


def label_of(v: Column, key: Column, raw: Column | None = None) -> Column:
    """The first of LABELS that is a non-blank string; of a document that is a string, or isn't JSON (``raw``), its text
    without outer spaces if that is 1 to 64 bytes; else the key."""
    named = [F.when(trimmed(member(v, n).string) != "", member(v, n).string) for n in LABELS]
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    if raw is not None:
        plain = F.when(v.isNull(), raw).otherwise(plain)
    plain = trimmed(plain)
    return F.coalesce(*named, F.when(F.octet_length(plain).between(1, 64), plain), key)


def textual_score(raw: Column, path: str) -> Column:
    """A number as the original's indexes read it, without parsing: what follows the members' names, one after the
    other, anywhere in the text.  So names inside strings and in other objects count too."""
    names = [r'"\Q' + part.replace("\\E", r"\E\\E\Q") + r'\E"[ \t\r\n]*:[ \t\r\n]*' for part in path.split(".")]
    found = F.regexp_extract(raw, "(?s)" + ".*?".join(names) + "([0-9.+eE-]*)", 1)
    return F.when(found.rlike(NUMBER_TEXT), found.try_cast("double"))


def checksum(raw: Column) -> Column:
    """CRC32 of a value's bytes, as an unsigned number; that of nothing for a delete."""
    return F.crc32(F.coalesce(raw, F.lit("")).cast("binary"))
