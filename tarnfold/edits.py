"""Partial updates of JSON documents."""

from __future__ import annotations

import json
from typing import Any


def literal_value(text: str) -> Any:
    """The JSON value of a command's word: text in single quotes, JSON, or else the text itself."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] == "'":
        return t[1:-1]
    try:
        return json.loads(t)
    except ValueError:
        pass
    if t.lower() in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[t.lower()]
    try:
        return float(t) if float(t) - float(t) == 0 else t
    except ValueError:
        return t


def set_member(raw: str | None, path: str, value: Any) -> str:
    """The document with a member set, its members sorted.

    A missing or invalid document, or one that is no object, starts as an empty object; so does anything
    but an object on the way.
    """
    try:
        doc = json.loads(raw) if raw is not None else {}
    except ValueError:
        doc = {}
    doc = doc if isinstance(doc, dict) else {}
    at, parts = doc, path.split(".")
    for part in parts[:-1]:
        if not isinstance(at.get(part), dict):
            at[part] = {}
        at = at[part]
    at[parts[-1]] = value
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
