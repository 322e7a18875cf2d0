"""The analyser in SQL: functions over a text column, and a table function that gives one row per morpheme."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import ship
from tessera.operators.batches import morphemes_of, segmenter_of
from tessera.operators.kernel import scan_text
from tessera.plans.analyzer import Analyzer
from tessera.types import MORPHEME, PATH, TokenizeOptions


def register(analyzer: Analyzer, prefix: str = "", opts: TokenizeOptions | None = None) -> None:
    """Register {prefix}tokenize, wakachi and nbest as functions and {prefix}tokens as a table function."""
    spark, opts = analyzer.spark, opts or TokenizeOptions()
    ship(spark)
    shared = spark.sparkContext.broadcast(analyzer._open())

    def rows(text: str | None) -> list[dict] | None:
        of = segmenter_of(shared.value, opts)
        return None if text is None else morphemes_of(of, of.kernel.segment(scan_text(text, opts), opts))

    @F.pandas_udf(T.ArrayType(MORPHEME))
    def tokenize(texts: pd.Series) -> pd.Series:
        return texts.map(rows)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def wakachi(texts: pd.Series) -> pd.Series:
        of = segmenter_of(shared.value, opts)

        def surfaces(text: str | None) -> list[str] | None:
            if text is None:
                return None
            numbers = of.numbers(scan_text(text, opts), opts)
            return [of.table.strings("surface")[i] for i in numbers]

        of.renew()
        return texts.map(surfaces)

    @F.pandas_udf(T.ArrayType(PATH))
    def nbest(texts: pd.Series, ks: pd.Series) -> pd.Series:
        of = segmenter_of(shared.value, opts)
        found = [None if t is None else [{"rank": i, "cost": c, "morphemes": morphemes_of(of, m)} for i, (c, m) in enumerate(of.kernel.nbest(scan_text(t, opts), int(k), opts), 1)] for t, k in zip(texts, ks, strict=True)]
        return pd.Series(found, dtype=object)

    class Tokens:
        def eval(self, text: str):
            for seq, m in enumerate(rows(text) or []):
                yield seq, *[m[f] for f in MORPHEME.names]

    table = T.StructType([T.StructField("seq", T.IntegerType()), *MORPHEME.fields])
    for name, f in (("tokenize", tokenize), ("wakachi", wakachi), ("nbest", nbest)):
        spark.udf.register(prefix + name, f)
    spark.udtf.register(prefix + "tokens", F.udtf(Tokens, returnType=table))
