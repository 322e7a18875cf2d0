"""Resource files beside a dictionary: unknown-word rules, surface patterns, character definitions, connection costs.

All of them are small but for the matrix; each reads the whole file as lines of one DataFrame and keeps line order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.charclass import BY_NAME, LIMIT, Range, overlay
from tessera.sources.csv_format import decimal, join_pos, records, short, split_fields, triple
from tessera.types import DEFAULT_EDGE, SHORT_MAX, SHORT_MIN, CharClass, LoadError, PatternKind


@dataclass(frozen=True)
class UnkRule:
    char_class: CharClass
    left_id: int
    right_id: int
    cost: int
    pos: str


@dataclass(frozen=True)
class UnkPattern:
    kind: PatternKind
    key: str | CharClass
    left_id: int
    right_id: int
    cost: int
    pos: str


@dataclass(frozen=True)
class CharFlags:
    """Which unknown candidates a class gives: also where words start; the whole run; prefixes up to a length."""

    invoke: bool = False
    group: bool = True
    length: int = 1


@dataclass
class Matrix:
    """Connection costs: ``costs[right id of the first, left id of the second]``."""

    costs: np.ndarray
    explicit: int

    def cost(self, right_id: int, left_id: int) -> int:
        inside = 0 <= right_id < self.costs.shape[0] and 0 <= left_id < self.costs.shape[1]
        return int(self.costs[right_id, left_id]) if inside else DEFAULT_EDGE


def read_text(spark: SparkSession, path: str) -> str:
    """A whole file as text; malformed bytes become lone surrogates."""
    try:
        rows = spark.read.format("binaryFile").load(path).select("content").collect()
    except Exception as e:
        raise LoadError("file not found") from e
    if len(rows) != 1:
        raise LoadError("file not found")
    return bytes(rows[0].content).decode("utf-8", "surrogateescape")


def unk_rules(text: str) -> list[UnkRule]:
    out = []
    for _, line in records(text):
        fields = split_fields(line)
        if len(fields) < 4 or fields[0] not in BY_NAME:
            raise LoadError("invalid format")
        out.append(UnkRule(BY_NAME[fields[0]], *triple(fields, 1), join_pos(fields[4:])))
    return out


def unk_patterns(text: str) -> list[UnkPattern]:
    out = []
    for _, line in records(text):
        fields = split_fields(line)
        if len(fields) < 5 or fields[0].upper() not in PatternKind.__members__ or fields[0] != fields[0].lower():
            raise LoadError("invalid format")
        kind = PatternKind[fields[0].upper()]
        key = BY_NAME.get(fields[1]) if kind is PatternKind.CHARSET else fields[1]
        if key is None or key == "":
            raise LoadError("invalid format")
        out.append(UnkPattern(kind, key, *triple(fields, 2), join_pos(fields[5:])))
    return out


def code_point(s: str) -> int | None:
    """A code point in decimal or with a prefix, else in bare hexadecimal digits."""
    for base in (0, 10, 16):
        try:
            v = int(s, base)
        except ValueError:
            continue
        return v if 0 <= v < LIMIT else None
    return None


def char_definitions(text: str) -> tuple[list[Range], dict[CharClass, CharFlags]]:
    """Declared ranges, later ones over earlier ones, and declared flags."""
    ranges: list[Range] = []
    flags: dict[CharClass, CharFlags] = {}
    for _, line in records(text):
        words = line.partition("#")[0].split()
        if len(words) < 2:
            continue
        low, dots, high = words[0].partition("..")
        lo = code_point(low)
        hi = code_point(high) if dots else code_point(words[1]) if len(words) > 2 else None
        if dots and (lo is None or hi is None):
            raise LoadError("invalid format")
        if lo is not None:
            name = words[2] if not dots and hi is not None else words[1]
            hi = lo if hi is None else hi
            if hi < lo:
                raise LoadError("invalid format")
            ranges = overlay(ranges, [(lo, hi + 1, BY_NAME.get(name, CharClass.UNKNOWN))])
            continue
        numbers = [decimal(x) for x in words[1:4]]
        if len(numbers) < 3 or None in numbers:
            raise LoadError("invalid format")
        cls = CharClass.UNKNOWN if words[0] == "DEFAULT" else BY_NAME.get(words[0])
        if cls is not None:
            flags[cls] = CharFlags(numbers[0] != 0, numbers[1] != 0, max(0, min(255, numbers[2])))
    return ranges, flags


def matrix_cells(lines: DataFrame) -> DataFrame:
    """(left, right, cost) of matrix lines (line_no, value), the last line of a cell winning."""
    words = F.split(F.trim(F.translate(F.col("value"), "\t", " ")), " +")
    cells = lines.where(F.trim(F.translate(F.col("value"), "\t", " ")) != "").select("line_no", *[F.get(words, F.lit(i)).alias(n) for i, n in enumerate(("left", "right", "cost"))])
    return cells.groupBy("left", "right").agg(F.max_by("cost", "line_no").alias("cost"))


#: Cells of plain numbers, which are read as one array; anything else is read line by line.
_PLAIN_CELLS = re.compile(r"(?:[ \t]*[0-9]{1,9}[ \t]+[0-9]{1,9}[ \t]+-?[0-9]{1,9}[ \t]*\r?(?:\n|\Z)|[ \t]*\r?\n)*+")


def matrix(text: str) -> Matrix:
    """A matrix file: the two sizes, then cells; what it doesn't state costs the default."""
    head, _, body = text.removeprefix("﻿").partition("\n")
    sizes = [decimal(x) for x in head.split()[:2]]
    if len(sizes) < 2 or any(n is None or not 0 <= n <= SHORT_MAX for n in sizes) or (sizes[0] == 0) != (sizes[1] == 0):
        raise LoadError("invalid format")
    costs = np.full(sizes, DEFAULT_EDGE, np.int16)
    seen = np.zeros(sizes, bool)
    if _PLAIN_CELLS.fullmatch(body):
        left, right, cost = np.fromstring(body, np.int64, sep=" ").reshape(-1, 3).T
        if len(left) and (left.max() >= sizes[0] or right.max() >= sizes[1]):
            raise LoadError("invalid format")
        costs[left, right] = np.clip(cost, SHORT_MIN, SHORT_MAX)  # of equal cells the last one stays
        seen[left, right] = True
        return Matrix(costs, int(seen.sum()))
    for line in body.split("\n"):
        words = line.removesuffix("\r").split()
        if not words:
            continue
        left, right = (decimal(x) for x in (words + ["", ""])[:2])
        cost = short(words[2]) if len(words) > 2 else None
        if cost is None or left is None or right is None or not (0 <= left < sizes[0] and 0 <= right < sizes[1]):
            raise LoadError("invalid format")
        costs[left, right] = cost
        seen[left, right] = True
    return Matrix(costs, int(seen.sum()))
