"""Character classes: the built-in ranges, declared ones over them, and their use as a column expression."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.types import CharClass, Language, LoadError

LIMIT = 0x110000

#: The classes of code points, by inclusive ranges.
BUILT_IN = {
    CharClass.SPACE: [(0x09, 0x0D), (0x20, 0x20)],
    CharClass.PUNCT: [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA1, 0xBF), (0x2018, 0x201F)],
    CharClass.DIGIT: [(0x30, 0x39)],
    CharClass.ASCII_LETTER: [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x17F), (0x1E9E, 0x1E9E)],
    CharClass.HIRAGANA: [(0x3040, 0x309F)],
    CharClass.KATAKANA: [(0x30A0, 0x30FF)],
    CharClass.HALFWIDTH_KATAKANA: [(0xFF66, 0xFF9F)],
    CharClass.HANZI: [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2EE5F), (0x30000, 0x323AF)],
    CharClass.EMOJI: [(0x231A, 0x231B), (0x23E9, 0x23FA), (0x2600, 0x27BF), (0x2B00, 0x2B5F), (0x1F000, 0x1F0FF), (0x1F1E6, 0x1F1FF), (0x1F300, 0x1FAFF)],
}
#: What texts in Taiwan and Hong Kong have beside these.
BOPOMOFO = [(0x3100, 0x312F), (0x31A0, 0x31BF)]

#: Names of classes in resource files.
NAMES = {
    CharClass.SYMBOL: ["DEFAULT"],
    CharClass.SPACE: ["SPACE"],
    CharClass.KANJI: ["KANJI"],
    CharClass.HIRAGANA: ["HIRAGANA"],
    CharClass.KATAKANA: ["KATAKANA"],
    CharClass.HALFWIDTH_KATAKANA: ["HALFWIDTHKATAKANA", "HALFWIDTH_KATAKANA"],
    CharClass.HANZI: ["CHINESE", "HANZI"],
    CharClass.BOPOMOFO: ["BOPOMOFO"],
    CharClass.ASCII_LETTER: ["ALPHA", "GREEK", "CYRILLIC", "LATIN"],
    CharClass.DIGIT: ["NUMERIC", "DIGIT", "CHINESENUMERIC", "KANJINUMERIC"],
    CharClass.PUNCT: ["SYMBOL", "PUNCT"],
    CharClass.EMOJI: ["EMOJI"],
}
BY_NAME = {name: cls for cls, names in NAMES.items() for name in names}

Range = tuple[int, int, CharClass]  # from, to (exclusive), class


def default_ranges(language: Language) -> list[Range]:
    out = [(lo, hi + 1, cls) for cls, ranges in BUILT_IN.items() for lo, hi in ranges]
    if language in (Language.CHINESE_TW, Language.CHINESE_HK):
        out += [(lo, hi + 1, CharClass.BOPOMOFO) for lo, hi in BOPOMOFO]
    return sorted(out)


def without(ranges: Iterable[Range], lo: int, hi: int) -> list[Range]:
    """``ranges`` less the interval [lo, hi)."""
    out = []
    for a, b, cls in ranges:
        out += [(x, y, cls) for x, y in ((a, min(b, lo)), (max(a, hi), b)) if x < y]
    return out


def overlay(base: list[Range], declared: Iterable[Range]) -> list[Range]:
    """Each declared range in its order, over what stands before."""
    out = list(base)
    for lo, hi, cls in declared:
        out = [*without(out, lo, hi), (lo, hi, cls)]
    return sorted(out)


def valid(ranges: list[Range]) -> bool:
    """Ascending, disjoint and within the code points."""
    return all(0 <= lo < hi <= LIMIT for lo, hi, _ in ranges) and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


class ClassTable:
    """Class of a character. Lone surrogates, which stand for malformed bytes, are of class Unknown."""

    def __init__(self, ranges: list[Range]):
        if not valid(ranges):
            raise LoadError("invalid format")
        self.ranges = ranges
        self._starts = [lo for lo, _, _ in ranges]
        self._known: dict[str, CharClass] = {}

    def __reduce__(self):
        return ClassTable, (self.ranges,)

    def of(self, char: str) -> CharClass:
        cls = self._known.get(char)
        if cls is None:
            i = bisect.bisect_right(self._starts, ord(char)) - 1
            cls = self.ranges[i][2] if i >= 0 and ord(char) < self.ranges[i][1] else CharClass.UNKNOWN
            self._known[char] = cls
        return cls

    def pattern(self) -> str:
        """A regular expression whose matches are the maximal runs of one class."""
        by_class: dict[CharClass, str] = {}
        for lo, hi, cls in self.ranges:
            by_class[cls] = by_class.get(cls, "") + f"\\U{lo:08x}-\\U{hi - 1:08x}"
        rest = "".join(by_class.values())
        return "|".join([*(f"[{x}]+" for x in by_class.values()), *([f"[^{rest}]+"] if rest else ["(?s:.+)"])])


def class_of(code: Column, ranges: list[Range] | None = None, language: Language = Language.GERMAN) -> Column:
    """Name of the class of a code point, as one CASE expression (a range join would be a nested loop)."""
    out = F
    for cls in CharClass:
        within = [(lo, hi) for lo, hi, c in (default_ranges(language) if ranges is None else ranges) if c == cls]
        if within:
            test = F.lit(False)
            for lo, hi in within:
                test = test | ((code == lo) if hi == lo + 1 else code.between(lo, hi - 1))
            out = out.when(test, F.lit(cls.name))
    return F.lit(CharClass.UNKNOWN.name) if out is F else out.otherwise(CharClass.UNKNOWN.name)
