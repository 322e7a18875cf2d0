"""Gold corpora of segmented sentences, listings of their files, and samples of dictionaries for fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The first characters of lines that are no morphemes, and the line that ends a sentence.
STRUCTURE, END = "#*+@E", "EOS"


def listing(text: str) -> list[str]:
    """The paths of a listing, one a line; blank lines and the blanks around paths don't count."""
    return [line.strip() for line in text.splitlines() if line.strip()]


def gold_sentences(lines: DataFrame, file: str = "file", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """(file, sentence, surfaces) of the lines of corpus files: morpheme lines begin with the surface, EOS ends a sentence.

    Lines after the last EOS make no sentence, and one without morphemes has no surfaces. A file's lines are counted in
    one task, as they are in order.
    """
    text = F.regexp_replace(value, "\r$", "")
    before = Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.select(file, line_no, text.alias("v")).withColumn("sentence", F.coalesce(F.sum((F.col("v") == END).cast("int")).over(before), F.lit(0)))
    surface = F.when((F.col("v") != "") & ~F.substring("v", 1, 1).isin(*STRUCTURE), F.regexp_extract("v", "^[^ \t]*", 0))
    folded = marked.groupBy(file, "sentence").agg(F.array_sort(F.collect_list(F.when(surface.isNotNull(), F.struct(F.col(line_no).alias("n"), surface.alias("s"))))).alias("m"), F.max((F.col("v") == END).cast("int")).alias("ended"))
    return folded.where("ended = 1").select(file, F.col("sentence").cast("int").alias("sentence"), F.transform("m", lambda x: x["s"]).alias("surfaces"))


def has_blank(surfaces: Column) -> Column:
    """Whether a surface holds a space or a tab, which a segmentation joined by spaces can't show."""
    return F.exists(surfaces, lambda s: s.contains(" ") | s.contains("\t"))


def sample(rows: DataFrame, n: int, seed: int, surface: str = "surface", line_no: str = "line_no") -> DataFrame:
    """``n`` rows without replacement, by a hash of the seed and the line, and then the first two rows of the first
    surface that occurs again, so that a fixture has a homograph."""
    drawn = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(line_no).cast("string"))), line_no).limit(n)
    place = F.row_number().over(Window.partitionBy(surface).orderBy(line_no))
    again = rows.withColumn("place_", place)
    first = again.where("place_ = 2").orderBy(line_no).limit(1).select(surface)
    return drawn.union(again.where("place_ <= 2").join(first, surface, "left_semi").select(*rows.columns))


#: The linking elements of German compounds.
LINKS = ["s", "es", "e", "n", "en", "ns"]


def german_entries(forms: DataFrame, cost: int = 1000) -> DataFrame:
    """Dictionary rows (surface, left_id, right_id, cost, pos, lemma) of a wordbook's forms (form, lemma, pos).

    Forms of several words are left out. A capitalised noun comes in lower case, too, as it stands within compounds; the
    linking elements are rows of their own.
    """
    plain = forms.where((F.col("form") != "") & ~F.col("form").rlike(r"\s")).select(F.col("form").alias("surface"), "pos", "lemma")
    low = plain.where(F.col("pos").startswith("NOUN") & (F.lower("surface") != F.col("surface"))).withColumn("surface", F.lower("surface"))
    links = forms.sparkSession.createDataFrame([(x, "FUGE", x) for x in LINKS], "surface string, pos string, lemma string")
    zero = F.lit(0).cast("short")
    return plain.union(low).union(links).distinct().select("surface", zero.alias("left_id"), zero.alias("right_id"), F.lit(cost).cast("short").alias("cost"), "pos", "lemma")
