"""Column functions over texts: offsets, composition, variants of a language, safe places to cut, POS patterns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.types import Language, Locale

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words whose spelling tells British from American texts.
VARIANT_WORDS = {"colour": "color", "defence": "defense", "centre": "center", "travelling": "traveling"}


def classify_english(text: Column) -> Column:
    """GB or US, whichever spelling more of the words occur in, as substrings in either case; else NONE."""
    low = F.translate(text, _UPPER, _LOWER)
    score = F.lit(0)
    for gb, us in VARIANT_WORDS.items():
        score = score + F.contains(low, F.lit(gb)).cast("int") - F.contains(low, F.lit(us)).cast("int")
    return F.when(score > 0, Locale.GB.name).when(score < 0, Locale.US.name).otherwise(Locale.NONE.name)


def classify_chinese(text: Column) -> Column:
    """TW for a text with Bopomofo, else NONE."""
    return F.when(text.rlike("[㄀-ㄯㆠ-ㆿ]"), Locale.TW.name).otherwise(Locale.NONE.name)


def classify_locale(text: Column, language: Language) -> Column:
    if language.english:
        return classify_english(text)
    return classify_chinese(text) if language.chinese else F.lit(Locale.NONE.name)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition (Spark has no function for it)."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def malformed(text: Column) -> Column:
    return ~F.is_valid_utf8(text)


#: Cuts that a step of the fold copies at most.
CUTS_AT_ONCE = 256


def _lines(text: Column) -> Column:
    return F.split(text, "(?<=\n)(?=[^\t\n\x0b\f\r ])", -1)


def _cuts(lines: Column, target: int | Column) -> Column:
    """(line, at): the lines that open a new piece, with their byte offsets, by one fold over the sizes of the lines."""
    least = F.greatest(F.lit(target) if isinstance(target, int) else target, F.lit(1))
    none = F.array().cast("array<struct<line:int,at:int>>")
    start = F.struct(F.array().cast("array<array<struct<line:int,at:int>>>").alias("done"), none.alias("part"), *[F.lit(0).alias(c) for c in ("line", "at", "open")])

    def add(acc: Column, size: Column) -> Column:
        cut, full = acc["open"] >= least, F.size(acc["part"]) >= CUTS_AT_ONCE
        new = F.array(F.struct(acc["line"].alias("line"), acc["at"].alias("at")))
        return F.struct(
            F.when(cut & full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
            F.when(cut & full, new).when(cut, F.concat(acc["part"], new)).otherwise(acc["part"]).alias("part"),
            (acc["line"] + 1).alias("line"),
            (acc["at"] + size).alias("at"),
            (F.when(cut, 0).otherwise(acc["open"]) + size).alias("open"),
        )

    return F.aggregate(F.transform(lines, F.octet_length), start, add, lambda acc: F.concat(F.flatten(acc["done"]), acc["part"]))


def safe_chunks(text: Column, target: int | Column) -> Column:
    """The pieces of a text, cut after line feeds that no white space follows; each but the last has ``target`` bytes."""
    first = F.concat(F.array(F.lit(0)), F.transform(_cuts(_lines(text), target), lambda c: c["line"]))
    held = F.array(F.struct(_lines(text).alias("lines"), first.alias("first")))

    def pieces(h: Column) -> Column:
        after = F.concat(F.slice(h["first"], 2, F.size(h["first"])), F.array(F.size(h["lines"])))
        return F.zip_with(h["first"], after, lambda a, b: F.array_join(F.transform(F.sequence(a, b - 1), lambda i: F.get(h["lines"], i)), ""))

    return F.when(text.isNotNull(), F.get(F.transform(held, pieces), 0))


def safe_chunk_offsets(text: Column, target: int | Column) -> Column:
    """Byte offsets of the cuts of ``safe_chunks``."""
    return F.transform(_cuts(_lines(text), target), lambda c: c["at"])


def pos_has(pos: Column, part: str) -> Column:
    """Whether ``part`` occurs in a part of speech."""
    return F.contains(pos, F.lit(part))


def pos_pattern_valid(pattern: Column) -> Column:
    return (pattern == "") | ~pattern.rlike("^,|,$|,,")


def pos_prefix_matches(pattern: Column, pos: Column) -> Column:
    return (pattern == "") | (pos == pattern) | F.startswith(pos, F.concat(pattern, F.lit(",")))


def characters(df: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, pos, ch, start, end): the characters of each text with their byte ranges.

    The running sum is per text; a text's characters meet in one task, as its segmentation does.
    """
    from pyspark.sql.window import Window

    chars = df.where(F.length(text) > 0).select(id, F.posexplode(F.split(F.col(text), "")).alias("pos", "ch")).where(F.col("ch") != "")
    end = F.sum(F.octet_length("ch")).over(Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return chars.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.octet_length("ch"))
