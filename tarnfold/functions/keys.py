"""Keys: 128-bit identifiers, written as lower-case UUIDs.

A UUID (with hyphens, or 32 hexadecimal digits) is its own key; any other text has the UUID version 5 of
its UTF-8 bytes in the OID namespace.  The order of the strings is that of the numbers.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_HEX = r"^[0-9a-fA-F]{32}$"


def _hyphens(h: Column) -> Column:
    return F.lower(F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(t: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_OID.hex)), F.encode(t, "UTF-8")))

    def version_5(h: Column) -> Column:
        variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
        return _hyphens(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.lpad(F.hex(variant), 2, "0"), F.substring(h, 19, 14)))

    return _once(digest, version_5)


def canonical_key(text: Column) -> Column:
    """The key of a text column; null for null or blank texts."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return _once(trimmed, lambda t: F.when(t.rlike(_UUID), F.lower(t)).when(t.rlike(_HEX), _hyphens(t)).when(t != "", _named(t)))


def key_of(text: str) -> str:
    """The same for one text; raises ValueError if it is blank."""
    t = text.strip()
    if not t:
        raise ValueError("a key can't be blank")
    if re.match(_UUID, t) or re.match(_HEX, t):
        return str(uuid.UUID(t))
    return str(uuid.uuid5(uuid.NAMESPACE_OID, t))
