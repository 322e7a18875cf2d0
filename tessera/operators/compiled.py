"""A dictionary in the form that kernels use: plain lists and numpy arrays, picklable, immutable, made for broadcasting."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from tessera.functions.charclass import ClassTable, Range, default_ranges
from tessera.sources.resources import CharFlags, Matrix, UnkPattern, UnkRule
from tessera.types import NONE, CharClass, Language, Mode, PatternKind, Stats

#: Fixed values of the fingerprint: the offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
WORD = (1 << 64) - 1


@dataclass(frozen=True)
class CompiledDictionary:
    """Entries are in id order: by surface, then by line; the columns are parallel lists."""

    language: Language
    mode: Mode
    surface: list[str]
    left_id: list[int]
    right_id: list[int]
    cost: list[int]
    pos: list[str]
    lemma: list[str]
    reading: list[str]
    reading_jyutping: list[str]
    extra: list[list[str]]
    ranges: list[Range]
    flags: dict[CharClass, CharFlags] = field(default_factory=dict)
    rules: list[UnkRule] = field(default_factory=list)
    patterns: list[UnkPattern] = field(default_factory=list)
    matrix: Matrix | None = None
    skipped: list[str] = field(default_factory=list)

    @classmethod
    def of_entries(cls, language: Language, entries: Iterable[tuple], mode: Mode = Mode.VITERBI, **more) -> CompiledDictionary:
        """From (surface, left_id, right_id, cost, pos[, lemma, reading, reading_jyutping, extra]) in file order."""
        rows = sorted((tuple(e) for e in entries), key=lambda e: e[0])
        rows = [(*e, *(e[0], NONE, NONE, [])[len(e) - 5 :]) for e in rows]
        return cls(language, mode, *([list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(9)]), more.pop("ranges", None) or default_ranges(language), **more)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def with_mode(self, mode: Mode) -> CompiledDictionary:
        return replace(self, mode=mode)

    @cached_property
    def classes(self) -> ClassTable:
        return ClassTable(self.ranges)

    @cached_property
    def groups(self) -> dict[str, range]:
        """Ids of the entries of each surface."""
        out: dict[str, range] = {}
        for i, s in enumerate(self.surface):
            out[s] = range(out[s].start, i + 1) if s in out else range(i, i + 1)
        return out

    @cached_property
    def lengths(self) -> dict[str, list[int]]:
        """Lengths of surfaces, ascending, by their first character."""
        found: dict[str, set[int]] = {}
        for s in self.groups:
            found.setdefault(s[0], set()).add(len(s))
        return {c: sorted(n) for c, n in found.items()}

    def flags_of(self, cls: CharClass) -> CharFlags:
        return self.flags.get(cls, CharFlags())

    @cached_property
    def one_class_words(self) -> bool:
        """Whether no surface spans two classes, so that runs of one class can be analysed alone."""
        of = self.classes.of
        return all(len({of(c) for c in s}) == 1 for s in self.groups)

    def resolve(self, cls: CharClass, text: str, start: int = 0, end: int | None = None) -> tuple[str, int, int, int]:
        """(pos, cost, left id, right id) of an unknown candidate: the first pattern, else the first rule, else the fallback.

        The candidate ``text[start:end]`` lies in one run, so that all its characters are of the class ``cls``.
        """
        end = len(text) if end is None else end
        for p in self.patterns:
            if (
                text.startswith(p.key, start, end)
                if p.kind is PatternKind.PREFIX
                else text.endswith(p.key, start, end)
                if p.kind is PatternKind.SUFFIX
                else p.key is cls
            ):
                return p.pos, p.cost, p.left_id, p.right_id
        for r in self.rules:
            if r.char_class is cls:
                return r.pos, r.cost, r.left_id, r.right_id
        return self.language.fallback_pos, 0, 0, 0

    @cached_property
    def fingerprint(self) -> int:
        """A 64-bit version stamp over all entries in order: FNV-1a by words of strings (length first), then of the numbers' bytes."""
        h = FNV_BASIS
        for i in range(len(self.surface)):
            for s in (self.surface[i], self.pos[i], self.lemma[i], self.reading[i], self.reading_jyutping[i]):
                raw = s.encode("utf-8", "surrogateescape")
                h = (h ^ len(raw)) * FNV_PRIME & WORD
                whole = len(raw) & ~7
                for a in range(0, whole, 8):
                    h = (h ^ int.from_bytes(raw[a : a + 8], "little")) * FNV_PRIME & WORD
                for b in raw[whole:]:
                    h = (h ^ b) * FNV_PRIME & WORD
            for v in (self.left_id[i], self.right_id[i], self.cost[i]):
                for b in (v & 0xFFFF).to_bytes(2, "little"):
                    h = (h ^ b) * FNV_PRIME & WORD
        return h

    def stats(self) -> Stats:
        rows, columns = self.matrix.costs.shape if self.matrix else (0, 0)
        cells, explicit = rows * columns, self.matrix.explicit if self.matrix else 0
        prefixes = len({s[:n] for s in self.groups for n in range(1, len(s) + 1)})
        return Stats(len(self.surface), len(self.groups), prefixes, len(self.rules), len(self.patterns), rows, columns, cells, explicit, explicit / cells if cells else 1.0, self.fingerprint, list(self.skipped))
