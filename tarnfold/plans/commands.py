"""The text commands: one line, a verb in any case and its words; quoted words keep their spaces."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

#: Spellings of verbs, and the arguments that follow: t a table, k a key, * the rest.
_ALIASES = {
    "DELETE": "DEL", "RANGE": "SCAN", "JSON_SET": "JSON.SET", "DELETE_WHERE": "DEL_WHERE", "AROUND_KEY": "RANK.KEY",
    "AROUND": "RANK.SCORE", "AROUND_SCORE": "RANK.SCORE", "SCORE_RANGE": "RANK.RANGE_SCORE", "RANK_RANGE": "RANK.RANGE",
    "SNAPSHOT": "BACKUP", "EXIT": "QUIT",
}


class CommandError(ValueError):
    pass


@dataclass(frozen=True)
class Command:
    verb: str
    table: str | None = None
    args: dict[str, Any] = field(default_factory=dict)


def words_of(line: str) -> list[tuple[str, int]]:
    """(word, where it starts).  Quotes hold a word together and are taken off; a JSON object or array is one word, whatever its strings hold."""
    out, i, n = [], 0, len(line)
    decoder = json.JSONDecoder()
    while i < n:
        if line[i].isspace():
            i += 1
            continue
        start = i
        if line[i] in "{[":
            try:
                _, end = decoder.raw_decode(line, i)
            except ValueError as e:
                raise CommandError(f"broken JSON at {i}") from e
            out.append((line[i:end], start))
            i = end
        elif line[i] in "\"'" and line.find(line[i], i + 1) > 0:
            end = line.find(line[i], i + 1)
            out.append((line[i + 1 : end], start))
            i = end + 1
        else:
            while i < n and not line[i].isspace():
                i += 1
            out.append((line[start:i], start))
    return out


def _query(text: str) -> tuple[str, int | None]:
    """A filter and the limit behind it.  A filter that is quoted as a whole ends at the quote; otherwise an integer behind a complete test is the limit."""
    t = text.strip()
    if t[:1] == '"':
        inner = t.rfind('"')
        rest = t[inner + 1 :].strip()
        if inner > 0 and (not rest or rest.isdigit()):
            return t[1:inner], int(rest) if rest else None
    head, _, last = t.rpartition(" ")
    if last.isdigit() and head and not head.rstrip().endswith((">", "<", "=", "CONTAINS", "contains")):
        return head, int(last)
    return t, None


def _integer(word: str, what: str) -> int:
    try:
        return int(word)
    except ValueError as e:
        raise CommandError(f"{what} must be an integer") from e


def _number(word: str, what: str) -> float:
    try:
        return float(word)
    except ValueError as e:
        raise CommandError(f"{what} must be a number") from e


def parse_command(line: str) -> Command:
    """Raises CommandError for an unknown verb or missing words."""
    found = words_of(line.strip())
    if not found:
        raise CommandError("blank command")
    verb = found[0][0].upper()
    verb = _ALIASES.get(verb, verb)
    words = [w for w, _ in found[1:]]

    def need(n: int, usage: str) -> None:
        if len(words) < n:
            raise CommandError(f"usage: {verb} {usage}")

    def rest(i: int) -> str:
        return line.strip()[found[i + 1][1] :] if len(found) > i + 1 else ""

    def limit(i: int) -> int | None:
        return _integer(words[i], "limit") if len(words) > i else None

    if verb in ("PING", "QUIT", "TABLES", "MULTI", "EXEC", "DISCARD"):
        return Command(verb)
    if verb == "METRICS":
        return Command(verb)
    if verb == "CONFIG":
        need(1, "GET | SET name value")
        if words[0].upper() == "GET":
            return Command("CONFIG GET")
        if words[0].upper() == "SET" and len(words) == 3:
            return Command("CONFIG SET", None, {"name": words[1].lower(), "value": words[2]})
        raise CommandError("usage: CONFIG GET | SET name value")
    if verb == "AUTH":
        need(1, "password")
        return Command(verb, None, {"password": words[0]})
    if verb == "SHOW" and words[:1] and words[0].upper() == "TABLES":
        return Command("TABLES")
    if verb in ("CREATE", "DROP", "TRUNCATE"):
        if words and words[0].upper() == "TABLE":
            words = words[1:]
        elif verb == "CREATE":
            raise CommandError("usage: CREATE TABLE table")
        need(1, "TABLE table")
        return Command(verb, words[0].lower())
    if verb in ("FLUSH", "BACKUP"):
        return Command(verb, None, {"target": words[0]} if words and verb == "BACKUP" else {}) if verb == "BACKUP" or not words else Command(verb, words[0].lower())
    if verb == "STATS" and len(words) < 2:
        return Command(verb, words[0].lower() if words else None)
    if verb == "INDEX":
        need(1, "CREATE|ADD|LIST table [path]")
        action = words[0].upper()
        if action in ("CREATE", "ADD"):
            need(3, "CREATE table path")
            return Command("INDEX CREATE", words[1].lower(), {"path": words[2]})
        if action == "LIST":
            need(2, "LIST table")
            return Command("INDEX LIST", words[1].lower())
        raise CommandError("usage: INDEX CREATE|ADD|LIST table [path]")
    need(1, "table ...")
    table = words[0].lower()
    make = lambda v=verb, **args: Command(v, table, args)
    if verb == "COMPRESSION":
        need(2, "table type")
        return make(type=words[1])
    if verb in ("GET", "DEL", "TTL"):
        need(2, "table key")
        return make(key=words[1])
    if verb in ("MGET", "EXISTS"):
        need(2, "table key...")
        return make(keys=words[1:])
    if verb == "SET":
        need(3, "table key value")
        return make(key=words[1], raw=rest(2))
    if verb == "MSET":
        if len(words) < 3 or len(words) % 2 == 0:
            raise CommandError("usage: MSET table key value [key value ...]")
        return make(items=list(zip(words[1::2], words[2::2])))
    if verb == "JSON.SET":
        need(4, "table key path value")
        return make(key=words[1], path=words[2], value=rest(3))
    if verb == "EXPIRE":
        need(3, "table key seconds")
        return make(key=words[1], seconds=_integer(words[2], "seconds"))
    if verb == "SCAN":
        return make(words=words[1:])
    if verb in ("FILTER", "DEL_WHERE"):
        need(2, "table query")
        query, n = _query(rest(1))
        return make(query=query, limit=n) if verb == "FILTER" else make(query=query)
    if verb == "COUNT":
        return make(query=_query(rest(1))[0] if len(words) > 1 else None)
    if verb in ("CALC_STATS", "STATS"):
        need(2, "table field [query]")
        return make("CALC_STATS", field=words[1], query=_query(rest(2))[0] if len(words) > 2 else None)
    if verb == "TOP":
        need(2, "table path [limit]")
        return make(path=words[1], limit=limit(2))
    if verb in ("RANK", "RANK.KEY"):
        need(3, "table path key" + " [limit]" * (verb != "RANK"))
        return make(path=words[1], key=words[2]) if verb == "RANK" else make(path=words[1], key=words[2], limit=limit(3))
    if verb == "RANK.SCORE":
        need(3, "table path score [limit]")
        return make(path=words[1], score=_number(words[2], "score"), limit=limit(3))
    if verb == "RANK.RANGE_SCORE":
        need(4, "table path min max [limit]")
        return make(path=words[1], low=_number(words[2], "min"), high=_number(words[3], "max"), limit=limit(4))
    if verb == "RANK.RANGE":
        need(4, "table path start end")
        return make(path=words[1], first=_integer(words[2], "start"), last=_integer(words[3], "end"))
    raise CommandError(f"unknown command {verb}")
