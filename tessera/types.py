"""Vocabulary of the analyser: enumerations, option and record types, result schemas and faults."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Cost of an edge that the connection matrix doesn't state.
DEFAULT_EDGE = 7000
#: Absence of a value, in dictionaries and results.
NONE = "*"
SHORT_MIN, SHORT_MAX = -(1 << 15), (1 << 15) - 1


# The members of the enumerations below, their numbers, and the messages of the faults.


class Language(enum.IntEnum):
    JAPANESE = 0
    CHINESE_CN = 1
    CHINESE_TW = 2
    CHINESE_HK = 3
    ENGLISH_GB = 4
    ENGLISH_US = 5
    GERMAN = 6

    @property
    def chinese(self) -> bool:
        return self.name.startswith("CHINESE")

    @property
    def english(self) -> bool:
        return self.name.startswith("ENGLISH")

    @property
    def locale(self) -> Locale:
        """The locale of a dictionary in this language."""
        suffix = self.name.rpartition("_")[2]
        return Locale[suffix] if suffix in Locale.__members__ else Locale.NONE

    @property
    def fallback_pos(self) -> str:
        """Part of speech of an unknown candidate that no pattern and no rule resolves."""
        if self is Language.JAPANESE:
            return "名詞,普通名詞"
        return "n" if self.chinese else "NOUN"


class Locale(enum.IntEnum):
    NONE = 0
    CN = 1
    TW = 2
    HK = 3
    GB = 4
    US = 5


class Mode(enum.IntEnum):
    VITERBI = 0
    LONGEST_MATCH = 1


class CharClass(enum.IntEnum):
    UNKNOWN = 0
    HIRAGANA = 1
    KATAKANA = 2
    KANJI = 3
    HANZI = 4
    HALFWIDTH_KATAKANA = 5
    BOPOMOFO = 6
    ASCII_LETTER = 7
    DIGIT = 8
    PUNCT = 9
    SPACE = 10
    SYMBOL = 11
    EMOJI = 12


class Schema(enum.IntEnum):
    IPADIC = 0
    UNIDIC = 1
    MECAB_JIEBA = 2
    MECAB_JIEBA_HK = 3
    ENGLISH_EXT = 4


class PatternKind(enum.IntEnum):
    PREFIX = 0
    SUFFIX = 1
    CHARSET = 2


class ConstraintReason(enum.IntEnum):
    OUT_OF_BOUNDS = 0
    EMPTY_SPAN = 1
    NOT_RUNE_BOUNDARY = 2
    TOKEN_OVERLAP = 3
    BOUNDARY_INSIDE_TOKEN = 4
    BOUNDARY_AT_TOKEN_EDGE = 5
    CONFLICTING_BOUNDARIES = 6
    BAD_POS_PATTERN = 7
    NORMALIZATION_RESCALED = 8

    @property
    def label(self) -> str:
        return "_".join(w.capitalize() for w in self.name.split("_"))


class TesseraError(Exception):
    """Any fault of the analyser."""


class LoadError(TesseraError):
    """A dictionary or resource can't be read: 'file not found', 'invalid format' or 'read failed'."""


class SchemaMismatchError(LoadError):
    def __init__(self, line: int, expected: int, got: int):
        super().__init__(f"schema mismatch at line {line} (expected {expected} columns, got {got})")
        self.line, self.expected, self.got = line, expected, got


class SaveError(TesseraError):
    """A snapshot can't be written."""


class UnavailableError(TesseraError):
    """The analyser is closed."""

    def __init__(self) -> None:
        super().__init__("unavailable (free raced the call)")


class MalformedInputError(TesseraError):
    def __init__(self, byte_offset: int):
        super().__init__(f"malformed UTF-8 at byte offset {byte_offset}")
        self.byte_offset = byte_offset

    def __reduce__(self):
        return type(self), (self.byte_offset,)


class CancelledError(TesseraError):
    def __init__(self, byte_offset: int):
        super().__init__(f"cancelled at byte offset {byte_offset}")
        self.byte_offset = byte_offset

    def __reduce__(self):
        return type(self), (self.byte_offset,)


class UnsatisfiableError(TesseraError):
    def __init__(self, byte_offset: int):
        super().__init__(f"constraints unsatisfiable at byte offset {byte_offset}")
        self.byte_offset = byte_offset

    def __reduce__(self):
        return type(self), (self.byte_offset,)


class ConstraintError(TesseraError):
    def __init__(self, reason: ConstraintReason, index: int, start: int, end: int):
        super().__init__(f"bad constraint {index}: {reason.label} (start {start}, end {end})")
        self.reason, self.index, self.start, self.end = reason, index, start, end

    def __reduce__(self):
        return type(self), (self.reason, self.index, self.start, self.end)


@dataclass(frozen=True)
class LoadOptions:
    """How a dictionary is loaded. ``threads`` and ``flat_char_class`` are taken for compatibility and change nothing."""

    mode: Mode = Mode.VITERBI
    unk_def_path: str | None = None
    char_def_path: str | None = None
    matrix_def_path: str | None = None
    qpat_path: str | None = None
    jyutping_csv_path: str | None = None
    lemma_locale: Locale = Locale.NONE
    zh_table: dict[str, str] | None = None
    threads: int = 0
    flat_char_class: bool = False


@dataclass(frozen=True)
class TokenConstraint:
    start: int
    end: int
    pos: str = ""


@dataclass(frozen=True)
class BoundaryConstraint:
    at: int
    must_exist: bool = True


@dataclass(frozen=True)
class Constraints:
    tokens: tuple[TokenConstraint, ...] = ()
    boundaries: tuple[BoundaryConstraint, ...] = ()

    @property
    def active(self) -> bool:
        return bool(self.tokens or self.boundaries)


@dataclass
class CancelToken:
    """A one-way flag. A token that is spent before a call makes the call fail; running jobs end with their job group."""

    cancelled: bool = False

    def cancel(self) -> None:
        self.cancelled = True


@dataclass(frozen=True)
class TokenizeOptions:
    unk_cost_bias: int = 0
    unk_cost_per_rune: int = 0
    normalize_nfc: bool = False
    strict_utf8: bool = False
    cancel_token: CancelToken | None = None


@dataclass(frozen=True)
class UserEntry:
    surface: str
    left_id: int = 0
    right_id: int = 0
    cost: int = 0
    pos: str = NONE
    lemma: str = NONE
    reading: str = NONE
    reading_jyutping: str = NONE

    def __post_init__(self) -> None:
        for name in ("left_id", "right_id", "cost"):
            if not SHORT_MIN <= getattr(self, name) <= SHORT_MAX:
                raise ValueError(f"{name} must fit 16 bits")
        if any("\0" in getattr(self, f) for f in ("surface", "pos", "lemma", "reading", "reading_jyutping")):
            raise ValueError("embedded NUL")


@dataclass(frozen=True)
class Stats:
    """What a dictionary holds. ``prefixes`` counts distinct prefixes of surfaces, the nodes of a trie over them."""

    entries: int
    terminals: int
    prefixes: int
    unk_rules: int
    unk_patterns: int
    matrix_left: int
    matrix_right: int
    matrix_cells: int
    matrix_explicit: int
    matrix_density: float
    entries_hash: int
    skipped: list[str] = field(default_factory=list)


MORPHEME = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("surface", "pos", "lemma", "reading", "reading_jyutping")]
    + [T.StructField("entry_id", T.IntegerType()), T.StructField("cost", T.ShortType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    + [T.StructField("locale", T.StringType()), T.StructField("char_class", T.StringType()), T.StructField("is_unknown", T.BooleanType())]
)
SPAN = T.StructType([T.StructField("surface", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
PATH = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("morphemes", T.ArrayType(MORPHEME))])
CONSTRAINTS = T.StructType(
    [
        T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pos", T.StringType())]))),
        T.StructField("boundaries", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("must_exist", T.BooleanType())]))),
    ]
)
LEXICON = T.StructType(
    [T.StructField("entry_id", T.IntegerType()), T.StructField("surface", T.StringType())]
    + [T.StructField(n, T.ShortType()) for n in ("left_id", "right_id", "cost")]
    + [T.StructField(n, T.StringType()) for n in ("pos", "lemma", "reading", "reading_jyutping")]
    + [T.StructField("extra", T.ArrayType(T.StringType()))]
)
