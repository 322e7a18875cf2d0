"""Boundary accuracy of a segmentation against another: precision, recall and F1 over interior boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.types import TokenizeOptions


def interior(surfaces: Column) -> Column:
    """Ends in characters of all surfaces but the last."""
    sizes = F.transform(surfaces, F.char_length)
    folded = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    return F.slice(folded, F.lit(1), F.greatest(F.size(folded) - 1, F.lit(0)))


def counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Adds the boundaries of both sides and those they share, row by row."""
    a, b = interior(F.col(gold)), interior(F.col(predicted))
    return df.withColumns({"n_gold": F.size(a), "n_predicted": F.size(b), "n_shared": F.size(F.array_intersect(a, b))})


def f1_of(gold: Column, predicted: Column, shared: Column) -> Column:
    """2 * shared / (gold + predicted); 1 where neither side has a boundary."""
    return F.when(gold + predicted == 0, 1.0).otherwise(2.0 * shared / (gold + predicted))


def boundary_scores(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 over all rows, or by groups."""
    sums = counts(df, gold, predicted).groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in ("n_gold", "n_predicted", "n_shared")])
    ratio = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    return sums.withColumns({"precision": ratio("n_shared", "n_predicted"), "recall": ratio("n_shared", "n_gold"), "f1": f1_of(F.col("n_gold"), F.col("n_predicted"), F.col("n_shared"))})


def mismatches(df: DataFrame, text: str, gold: str, predicted: str, class_of_code) -> DataFrame:
    """(kind, char_class, n): boundaries that only one side has, by the class of the character before."""
    a, b = interior(F.col(gold)), interior(F.col(predicted))
    parts = [df.select(F.col(text).alias("t"), F.lit(kind).alias("kind"), F.explode(F.array_except(x, y)).alias("at")) for kind, x, y in (("miss", a, b), ("over_split", b, a))]
    return parts[0].union(parts[1]).groupBy("kind", class_of_code(F.ascii(F.substring("t", F.col("at"), F.lit(1)))).alias("char_class")).agg(F.count("*").alias("n"))


def median(values: str | Column) -> Column:
    """The exact median, the mean of the middle two; 0 of no values."""
    return F.coalesce(F.median(values), F.lit(0.0))


def grid_sweep(analyzer, df: DataFrame, text: str, gold: str, biases: list[int], per_runes: list[int]) -> DataFrame:
    """(bias, per_rune, f1) of the cheapest path against ``gold`` for every point of a grid of unknown-word costs."""
    parts = []
    for bias in biases:
        for per_rune in per_runes:
            found = analyzer.wakachi(df, text, "found_", TokenizeOptions(unk_cost_bias=bias, unk_cost_per_rune=per_rune))
            parts.append(boundary_scores(found, gold, "found_").select(F.lit(bias).alias("bias"), F.lit(per_rune).alias("per_rune"), "f1"))
    return reduce(DataFrame.union, parts)


def oracle_at_k(df: DataFrame, key: str, gold: str, paths: str, ks: list[int]) -> DataFrame:
    """(k, f1): the best path of the first k of each row, micro-averaged; of equal paths the cheaper one.

    ``paths`` is an array of (rank, cost, morphemes); ``key`` tells the rows apart.
    """
    ranked = df.select(F.col(key).alias("row"), F.col(gold).alias("gold"), F.explode(paths).alias("p"))
    surfaces = F.transform("p.morphemes", lambda m: m["surface"])
    scored = counts(ranked.withColumn("predicted", surfaces), "gold", "predicted").withColumn("f", f1_of(F.col("n_gold"), F.col("n_predicted"), F.col("n_shared")))
    wide = scored.select("row", F.col("p.rank").alias("rank"), "f", "n_gold", "n_predicted", "n_shared", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k")
    best = wide.groupBy("row", "k").agg(F.max(F.struct("f", (-F.col("rank")).alias("r"), "n_gold", "n_predicted", "n_shared")).alias("b"))
    sums = best.groupBy("k").agg(*[F.sum(f"b.{c}").alias(c) for c in ("n_gold", "n_predicted", "n_shared")])
    return sums.select("k", f1_of(F.col("n_gold"), F.col("n_predicted"), F.col("n_shared")).alias("f1"))
