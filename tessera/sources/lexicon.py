"""Dictionary CSV files as DataFrames: schema by column count, projection, ids by surface order, readings and lemmas."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.cluster import ship
from tessera.functions.lemma import lemma_expression
from tessera.sources.csv_format import join_pos, records, split_fields, triple
from tessera.types import NONE, Language, LoadError, Locale, Schema, SchemaMismatchError, UserEntry


@dataclass(frozen=True)
class Layout:
    """Columns of a schema, counted from 0; ``lemma`` None stands for the surface."""

    pos: slice
    lemma: int | None
    reading: int
    extra: slice


#: Columns after surface, left id, right id and cost.
LAYOUTS = {
    Schema.IPADIC: Layout(slice(4, 10), 10, 11, slice(0)),
    Schema.UNIDIC: Layout(slice(4, 10), 11, 13, slice(17, None)),
    Schema.MECAB_JIEBA: Layout(slice(4, 5), None, 5, slice(8, 9)),
    Schema.MECAB_JIEBA_HK: Layout(slice(4, 5), None, 5, slice(8, 9)),
    Schema.ENGLISH_EXT: Layout(slice(4, 10), 10, 11, slice(0)),
}
ROW = "line_no long, surface string, left_id short, right_id short, cost short, pos string, lemma string, reading string, reading_jyutping string, extra array<string>"


def detect_schema(language: Language, line: str) -> tuple[Schema, int]:
    """The schema and column count that the first record of a file shows."""
    n = len(split_fields(line))
    if n == 9:
        return (Schema.MECAB_JIEBA_HK if language is Language.CHINESE_HK else Schema.MECAB_JIEBA), n
    if n == 13:
        return (Schema.ENGLISH_EXT if language.english else Schema.IPADIC), n
    if 17 <= n <= 25:
        return Schema.UNIDIC, n
    raise LoadError("invalid format")


def parse_row(schema: Schema, columns: int, line_no: int, line: str) -> tuple:
    """One record as a row of ROW."""
    fields, layout = split_fields(line), LAYOUTS[schema]
    if len(fields) != columns:
        raise SchemaMismatchError(line_no, columns, len(fields))
    if not fields[0]:
        raise LoadError("invalid format")
    ids = triple(fields, 1)
    lemma = fields[0] if layout.lemma is None else fields[layout.lemma]
    return (line_no, fields[0], *ids, join_pos(fields[layout.pos]), lemma, fields[layout.reading], NONE, fields[layout.extra])


def parse_text(language: Language, text: str) -> list[tuple]:
    """All rows of a dictionary held in memory; a dictionary without rows is malformed."""
    found: tuple[Schema, int] | None = None
    rows = []
    for number, line in records(text):
        found = found or detect_schema(language, line)
        rows.append(parse_row(*found, number, line))
    if not rows:
        raise LoadError("invalid format")
    return rows


def read_lexicon(spark: SparkSession, language: Language, path: str) -> DataFrame:
    """A dictionary file as unnumbered rows (ROW), parsed on the executors.

    ``line_no`` grows with the position in the file. A faulty line gives a row without surface; who reads the rows
    parses the text again on the driver then, for the fault and its line. Malformed bytes become U+FFFD.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").cast("binary").alias("value"))
        first = lines.where(F.length(F.trim(F.translate(F.col("value").cast("string"), "\t\r", "  "))) > 0).first()
    except Exception as e:
        raise LoadError("file not found") from e
    if first is None:
        raise LoadError("invalid format")
    head = first.line_no
    schema, columns = detect_schema(language, bytes(first.value).decode("utf-8", "replace").removesuffix("\r").removeprefix("﻿"))
    ship(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            rows = []
            for n, raw in zip(batch["line_no"], batch["value"], strict=True):
                line = bytes(raw).decode("utf-8", "replace").removesuffix("\r")
                if line.strip():
                    try:
                        rows.append(parse_row(schema, columns, n, line.removeprefix("﻿") if n == head else line))
                    except LoadError:
                        rows.append((n, *[None] * 9))
            yield pd.DataFrame(rows, columns=names)

    return lines.mapInPandas(parse, ROW)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``entry_id``: the position by surface in byte order, then by line.

    The window has no partition key and so one task; a dictionary is of bounded size, unlike the texts it is applied to.
    """
    order = Window.orderBy("surface", "line_no")
    return rows.withColumn("entry_id", (F.row_number().over(order) - 1).cast("int"))


def with_jyutping(rows: DataFrame, donor: DataFrame) -> DataFrame:
    """The donor's first stated reading of each surface as Cantonese reading of all rows of that surface."""
    first = donor.where(~F.col("reading").isin("", NONE)).groupBy("surface").agg(F.min_by("reading", "line_no").alias("donated"))
    return rows.join(first, "surface", "left").withColumn(
        "reading_jyutping", F.when(F.col("reading_jyutping") == NONE, F.coalesce("donated", F.lit(NONE))).otherwise(F.col("reading_jyutping"))
    ).drop("donated")


def with_user_entries(rows: DataFrame, entries: Iterable[UserEntry]) -> DataFrame:
    """``rows`` (numbered or not) and then the user's, to be numbered anew. An empty surface rejects them all."""
    entries = list(entries)
    if any(not e.surface for e in entries):
        raise LoadError("invalid format")
    # existing rows keep their order: by id they are in line order within a surface
    old = rows.withColumn("line_no", F.col("entry_id").cast("long")) if "entry_id" in rows.columns else rows
    top = 1 << 60
    new = rows.sparkSession.createDataFrame([(top + i, e.surface, e.left_id, e.right_id, e.cost, e.pos, e.lemma, e.reading, e.reading_jyutping, []) for i, e in enumerate(entries)], ROW)
    return old.select(*new.columns).unionByName(new)


def with_lemmas_for(rows: DataFrame, language: Language, target: Locale, zh_table: dict[str, str] | None = None) -> DataFrame:
    return rows.withColumn("lemma", lemma_expression(F.col("lemma"), language, target, zh_table))
