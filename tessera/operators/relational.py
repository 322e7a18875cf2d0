"""The lattice as DataFrame plans: runs, matches, candidates, edges, and the greedy walk's longest match. No Python runs.

Texts here are (id, text). Positions are characters of the text, ends exclusive; the matches of a position are one
equi-join of its substrings with the lexicon, over the lengths that the lexicon has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.charclass import Range, class_of, default_ranges
from tessera.sources.resources import CharFlags, UnkPattern, UnkRule
from tessera.types import DEFAULT_EDGE, CharClass, Language, PatternKind


def run_pattern(ranges: list[Range]) -> str:
    """A regular expression (Java) whose matches are the maximal runs of one class."""
    by_class: dict[CharClass, str] = {}
    for lo, hi, cls in ranges:
        by_class[cls] = by_class.get(cls, "") + f"\\x{{{lo:X}}}-\\x{{{hi - 1:X}}}"
    return "|".join([*(f"[{x}]+" for x in by_class.values()), f"[^{''.join(by_class.values())}]+"])


def class_runs(df: DataFrame, id: str = "id", text: str = "text", language: Language = Language.GERMAN) -> DataFrame:
    """(id, seq, run, char_class, start, end): maximal runs of one class with their byte ranges."""
    ranges = default_ranges(language)
    runs = df.select(id, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(run_pattern(ranges)), F.lit(0))).alias("seq", "run"))
    end = F.sum(F.octet_length("run")).over(Window.partitionBy(id).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return runs.select(id, "seq", "run", class_of(F.ascii("run"), ranges).alias("char_class"), end.alias("end")).withColumn("start", F.col("end") - F.octet_length("run"))


def lengths_of(lexicon: DataFrame) -> list[int]:
    """The surface lengths of a lexicon, a few numbers."""
    return sorted(r[0] for r in lexicon.select(F.char_length("surface")).distinct().collect())


def prefix_matches(df: DataFrame, lexicon: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, start, end, entry_id, ...): every entry that is a prefix of the text from some position on."""
    lengths = lengths_of(lexicon)
    n = F.char_length(text)
    at = df.where(n > 0).select(id, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    cut = at.select(id, text, "start", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("len")).where(F.col("start") + F.col("len") <= n)
    return cut.select(id, "start", (F.col("start") + F.col("len")).alias("end"), F.substring(text, F.col("start") + 1, F.col("len")).alias("surface")).join(lexicon, "surface")


def longest_matches(df: DataFrame, lexicon: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """The longest match of each position, of one surface the cheapest entry, then the lowest id."""
    best = F.min(F.struct((-F.col("end")).alias("e"), "cost", "entry_id", "surface")).alias("best")
    return prefix_matches(df, lexicon, id, text).groupBy(id, "start").agg(best).select(id, "start", (-F.col("best.e")).alias("end"), F.col("best.entry_id").alias("entry_id"), F.col("best.surface").alias("surface"))


def resolve_unknown(surface: Column, char_class: Column, rules: list[UnkRule], patterns: list[UnkPattern], fallback: str, ranges: list[Range]) -> Column:
    """(pos, cost) of an unknown candidate: the first pattern that fits, else the first rule of its class, else the fallback."""
    out = F

    def then(test: Column, r: UnkRule | UnkPattern) -> None:
        nonlocal out
        out = out.when(test, F.struct(F.lit(r.pos).alias("pos"), F.lit(r.cost).alias("cost")))

    for p in patterns:
        if p.kind is PatternKind.CHARSET:
            body = "".join(f"\\x{{{lo:X}}}-\\x{{{hi - 1:X}}}" for lo, hi, c in ranges if c is p.key)
            then(surface.rlike(f"^[{body}]+$") if body else F.lit(False), p)
        else:
            then(F.startswith(surface, F.lit(p.key)) if p.kind is PatternKind.PREFIX else F.endswith(surface, F.lit(p.key)), p)
    for r in rules:
        then(char_class == r.char_class.name, r)
    last = F.struct(F.lit(fallback).alias("pos"), F.lit(0).alias("cost"))
    return last if out is F else out.otherwise(last)


def lattice_nodes(runs: DataFrame, lexicon: DataFrame, flags: CharFlags = CharFlags(), id: str = "id", text: str = "text") -> DataFrame:
    """(id, node, start, end, entry_id, left_id, right_id, cost): all candidates of texts that are runs of one class.

    ``node`` numbers them in lattice order from 1; entry_id -1 is an unknown candidate, of cost and ids 0.
    """
    words = prefix_matches(runs, lexicon, id, text).select(id, "start", "end", "entry_id", "left_id", "right_id", "cost", F.lit(0).alias("kind"), F.col("end").alias("place"), (-F.col("entry_id")).alias("then"))
    n = F.char_length(text)
    at = runs.where(n > 0).select(id, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    if not flags.invoke:
        at = at.join(words.select(id, "start").distinct(), [id, "start"], "left_anti")
    shorter = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(flags.length, 1))), lambda x: F.col("start") + x), lambda e: e <= F.col("n"))
    if flags.group:
        ends = F.array_distinct(F.concat(F.array("n"), shorter if flags.length else F.array().cast("array<int>")))
    else:
        ends = shorter
    none = F.lit(0).cast("short")
    unknown = at.select(id, "start", F.posexplode(ends).alias("place", "end")).select(id, "start", "end", F.lit(-1).alias("entry_id"), none.alias("left_id"), none.alias("right_id"), none.alias("cost"), F.lit(1).alias("kind"), "place", F.lit(0).alias("then"))
    order = Window.partitionBy(id).orderBy("start", "kind", "place", "then")
    return words.unionByName(unknown).select(id, F.row_number().over(order).alias("node"), "start", "end", "entry_id", "left_id", "right_id", "cost")


def lattice_edges(nodes: DataFrame, matrix: DataFrame | None = None, id: str = "id") -> DataFrame:
    """(id, from, to, cost): pairs of candidates that meet, at the matrix's cost or the default, plus the second's own."""
    left = nodes.select(id, F.col("node").alias("from"), F.col("end").alias("at"), "right_id")
    right = nodes.select(id, F.col("node").alias("to"), F.col("start").alias("at"), "left_id", F.col("cost").alias("own"))
    pairs = left.join(right, [id, "at"])
    if matrix is None:
        edge = F.lit(DEFAULT_EDGE)
    else:
        cells = matrix.select(F.col("left").alias("right_id"), F.col("right").alias("left_id"), F.col("cost").alias("edge"))
        pairs = pairs.join(cells, ["right_id", "left_id"], "left")
        edge = F.coalesce("edge", F.lit(DEFAULT_EDGE))
    return pairs.select(id, "from", "to", (edge + F.col("own")).cast("long").alias("cost"))
