"""The strict CSV dialect of dictionary files, their lines and their numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.types import SHORT_MAX, SHORT_MIN, LoadError

_FIELD = re.compile(r'"((?:[^"]|"")*)"(?=,|\Z)|([^",][^,]*|)(?=,|\Z)', re.S)
_DECIMAL = re.compile(r"[+-]?[0-9]+\Z")
_LONG = 2**63


def split_fields(line: str) -> list[str]:
    """Fields of a line. A field is quoted only if it begins with a quote; then the quote must end it."""
    out, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        if not m:
            raise LoadError("invalid format")
        out.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        if m.end() == len(line):
            return out
        at = m.end() + 1


def records(text: str) -> Iterator[tuple[int, str]]:
    """(line number from 1, record) of the lines that aren't blank; a byte order mark before the first is dropped."""
    first = True
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        if not line.strip():
            continue
        yield number, line.removeprefix("﻿") if first else line
        first = False


def decimal(s: str) -> int | None:
    """An integer held within 64 bits, or None if the text is no decimal number."""
    return max(-_LONG, min(_LONG - 1, int(s))) if _DECIMAL.match(s) else None


def short(s: str) -> int | None:
    """An integer held within 16 bits, or None."""
    v = decimal(s)
    return None if v is None else max(SHORT_MIN, min(SHORT_MAX, v))


def triple(fields: list[str], at: int) -> tuple[int, int, int]:
    """Left id, right id and cost."""
    values = [short(x) for x in fields[at : at + 3]]
    if len(values) < 3 or None in values:
        raise LoadError("invalid format")
    return tuple(values)


def join_pos(columns: list[str]) -> str:
    """The columns that say something, joined with commas."""
    return ",".join(c for c in columns if c not in ("", "*")) or "*"
