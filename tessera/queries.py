"""Queries over the analyser's operators, and the SQL they are held against.

Their dictionary comes from the data, so that SQL can make the same: the most frequent letter runs of ``documents``,
with costs and connection ids by rank. Unless a query says otherwise, it covers all texts of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.charclass import class_of, default_ranges
from tessera.functions.lemma import SPELLINGS, lemma_expression
from tessera.functions.text import characters, classify_english, nfc, safe_chunk_offsets
from tessera.operators import relational as rel
from tessera.plans import evaluate
from tessera.plans.analyzer import Analyzer
from tessera.sources import lexicon as lx
from tessera.sources.resources import UnkPattern, UnkRule
from tessera.types import BoundaryConstraint, CharClass, Constraints, Language, Locale, Mode, PatternKind, TokenConstraint, UserEntry

#: Entries of the dictionary.
WORDS = 2000
LETTERS = "[A-Za-zÀ-ſ]+"

SQL_RUNS = rf"""
runs AS (
  SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}')) AS run FROM documents) GROUP BY run
), lexicon AS (
  SELECT run AS surface, rank, CAST(1000 + 7 * rank + rank * rank % 13 AS INTEGER) AS cost, CAST(rank % 3 AS INTEGER) AS left_id, CAST(rank % 2 AS INTEGER) AS right_id,
         CASE WHEN rank % 4 = 0 THEN 'NOUN,common' WHEN rank % 4 = 1 THEN 'VERB' WHEN rank % 4 = 2 THEN 'NOUN,proper' ELSE 'ADP' END AS pos,
         CAST(row_number() OVER (ORDER BY run) - 1 AS INTEGER) AS entry_id
  FROM (SELECT run, row_number() OVER (ORDER BY n DESC, run) AS rank FROM runs WHERE length(run) BETWEEN 2 AND 8)
  WHERE rank <= {WORDS}
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, n): the distinct letter runs of all documents."""
    return documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_rows(runs(spark, sf_dir))


def ranked_rows(words: DataFrame) -> DataFrame:
    """The lexicon that the most frequent of ``words`` (run, n) make."""
    top = words.where(F.char_length("run").between(2, 8)).orderBy(F.desc("n"), "run").limit(WORDS)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "run"))
    pos = F.element_at(F.array(*[F.lit(p) for p in ("NOUN,common", "VERB", "NOUN,proper", "ADP")]), F.col("rank") % 4 + 1)
    return top.withColumn("rank", rank).select(
        F.col("run").alias("surface"), "rank", (1000 + 7 * F.col("rank") + F.col("rank") * F.col("rank") % 13).cast("short").alias("cost"),
        (F.col("rank") % 3).cast("short").alias("left_id"), (F.col("rank") % 2).cast("short").alias("right_id"), pos.alias("pos"), F.col("rank").cast("long").alias("line_no"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.numbered(lexicon_rows(spark, sf_dir))


def analyzer(spark: SparkSession, sf_dir: str, mode: Mode = Mode.VITERBI, **more) -> Analyzer:
    return Analyzer.of_frame(spark, Language.GERMAN, lexicon_rows(spark, sf_dir), mode, **more)


# -- the dictionary


def lexicon_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark, sf_dir).select("entry_id", "surface", "cost", "left_id", "right_id", "pos")


def homograph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of entries whose surfaces are equal in lower case, and the entry that a longest match takes of each."""
    rows = lexicon(spark, sf_dir).withColumn("folded", F.lower("surface"))
    return rows.groupBy("folded").agg(F.count("*").alias("n"), F.min(F.struct("cost", "entry_id")).alias("m")).select("folded", "n", F.col("m.entry_id").alias("entry_id"))


def alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the dictionary numbered by falling frequency, then by code point."""
    chars = lexicon_rows(spark, sf_dir).select(F.explode(F.split("surface", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select("ch", "n", (F.row_number().over(Window.orderBy(F.desc("n"), F.ascii("ch"))) - 1).alias("code"))


def user_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary with three more entries, numbered anew."""
    new = [UserEntry("zzz", cost=-3000, pos="USER"), UserEntry("the", cost=5, pos="USER"), UserEntry("aaa", cost=7, pos="USER")]
    return lx.numbered(lx.with_user_entries(lexicon(spark, sf_dir).withColumns({"lemma": F.col("surface"), "reading": F.lit("*"), "reading_jyutping": F.lit("*"), "extra": F.array().cast("array<string>")}), new)).select("entry_id", "surface", "cost", "pos")


def jyutping_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a donor dictionary (every third entry twice, once without a reading) on the entries."""
    rows = lexicon_rows(spark, sf_dir).withColumns({"reading": F.lit("*"), "reading_jyutping": F.lit("*")})
    donor = rows.where("rank % 3 = 0").select("surface", F.explode(F.array(F.lit("*"), F.concat(F.lit("r"), F.col("rank").cast("string")))).alias("reading"), "line_no")
    return lx.numbered(lx.with_jyutping(rows, donor)).select("entry_id", "surface", "reading_jyutping")


def lemma_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    """American lemmas of all British spellings and of the dictionary."""
    spelled = spark.createDataFrame([(x,) for x in SPELLINGS], "surface string")
    both = spelled.union(lexicon_rows(spark, sf_dir).select("surface")).distinct()
    return both.select("surface", lemma_expression(F.col("surface"), Language.ENGLISH_GB, Locale.US).alias("lemma"))


def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every pair of connection ids, stated ones by the last line of a cell, others the default."""
    from tessera.sources.resources import matrix_cells as cells

    lines = spark.range(1, 8).select(F.col("id").alias("line_no"), F.concat_ws(" ", (F.col("id") % 2).cast("string"), (F.col("id") % 3).cast("string"), (F.col("id") * 100).cast("string")).alias("value"))
    ids = lexicon_rows(spark, sf_dir).select("left_id", "right_id")
    # the two id sets have at most three members each
    pairs = ids.select(F.col("right_id").cast("int").alias("left")).distinct().join(F.broadcast(ids.select(F.col("left_id").cast("int").alias("right")).distinct()))
    stated = cells(lines).select(F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right"), F.col("cost").cast("int").alias("stated"))
    return pairs.join(stated, ["left", "right"], "left").select("left", "right", F.coalesce("stated", F.lit(7000)).alias("cost"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analyzer(spark, sf_dir).stats()
    return spark.createDataFrame([(s.entries, s.terminals, s.prefixes, f"{s.entries_hash:016x}", s.matrix_density)], "entries int, terminals int, prefixes int, entries_hash string, matrix_density double")


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary after it was written to an image and read back."""
    return Analyzer.restore(spark, analyzer(spark, sf_dir).snapshot()).lexicon().select("entry_id", "surface", "cost", "left_id", "right_id", "pos")


# -- characters and runs


def char_class_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    counted = chars.groupBy("ch").agg(F.count("*").alias("n"))
    return counted.groupBy(class_of(F.ascii("ch"), default_ranges(Language.GERMAN)).alias("char_class")).agg(F.sum("n").alias("n"))


def class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one class of all documents, summed by class: how many, their bytes, and the sum of their starts."""
    found = rel.class_runs(documents(spark, sf_dir), "doc_id")
    return found.groupBy("doc_id", "char_class").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"), F.sum("start").alias("starts"))


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of all characters of the benchmark passages."""
    return characters(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id").select("item_id", "pos", "ch", "start", "end")


# -- matches and the lattice, over the distinct letter runs


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(F.col("run").alias("id"), F.col("run").alias("text"))


def prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rel.prefix_matches(_words(spark, sf_dir), lexicon(spark, sf_dir).select("surface", "entry_id"))
    return found.select(F.col("id").alias("run"), "start", "end", "entry_id")


def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rel.longest_matches(_words(spark, sf_dir), lexicon(spark, sf_dir).select("surface", "entry_id", "cost"))
    return found.select(F.col("id").alias("run"), "start", "end", "entry_id")


def lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rel.lattice_nodes(_words(spark, sf_dir), lexicon(spark, sf_dir))
    return found.select(F.col("id").alias("run"), "node", "start", "end", "entry_id", "cost")


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each run's lattice, counted and summed."""
    edges = rel.lattice_edges(rel.lattice_nodes(_words(spark, sf_dir), lexicon(spark, sf_dir)))
    return edges.groupBy(F.col("id").alias("run")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


RULES = [UnkRule(CharClass.DIGIT, 0, 0, 1500, "NUM"), UnkRule(CharClass.PUNCT, 0, 0, 300, "PUNCT"), UnkRule(CharClass.SPACE, 0, 0, 0, "SPACE")]
PATTERNS = [UnkPattern(PatternKind.PREFIX, "un", 0, 0, 4100, "ADJ"), UnkPattern(PatternKind.SUFFIX, "tion", 0, 0, 4200, "NOUN,abstract"), UnkPattern(PatternKind.CHARSET, CharClass.DIGIT, 0, 0, 1400, "NUM,whole")]


def unk_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all distinct runs would resolve as unknown candidates."""
    ranges = default_ranges(Language.GERMAN)
    found = rel.class_runs(documents(spark, sf_dir), "doc_id").select("run", "char_class").distinct()
    got = rel.resolve_unknown(F.col("run"), F.col("char_class"), RULES, PATTERNS, Language.GERMAN.fallback_pos, ranges)
    return found.select("run", got.alias("r")).groupBy("r.pos", "r.cost").agg(F.count("*").alias("n"))


# -- segmentation


def greedy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match segmentation of every distinct run."""
    out = analyzer(spark, sf_dir, Mode.LONGEST_MATCH).wakati(runs(spark, sf_dir), "run")
    return out.select("run", "wakati")


def viterbi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest segmentation of every distinct run."""
    return analyzer(spark, sf_dir).wakati(runs(spark, sf_dir), "run").select("run", "wakati")


def nbest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the three cheapest paths of every distinct run."""
    out = analyzer(spark, sf_dir).nbest(runs(spark, sf_dir), 3, "run")
    return out.select("run", F.explode("paths").alias("p")).select("run", "p.rank", "p.cost")


def constrained_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest path of every distinct run of four ASCII letters and more that has a boundary after two and none after three."""
    cons = Constraints((), (BoundaryConstraint(2, True), BoundaryConstraint(3, False)))
    words = runs(spark, sf_dir).where(F.col("run").rlike("^[A-Za-z]{4,}$"))
    out = analyzer(spark, sf_dir).tokenize_constrained(words, cons, "run", on_error="column")
    return out.select("run", F.coalesce(F.array_join(F.transform("morphemes", lambda m: m["surface"]), " "), F.col("error")).alias("wakati"))


def pinned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct run of four ASCII letters and more with its first three letters pinned to a noun, or the fault."""
    words = runs(spark, sf_dir).where(F.col("run").rlike("^[A-Za-z]{4,}$"))
    out = analyzer(spark, sf_dir).tokenize_constrained(words, Constraints((TokenConstraint(0, 3, "NOUN"),)), "run", on_error="column")
    return out.groupBy(F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


def wakati_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match segmentation of every document."""
    return analyzer(spark, sf_dir, Mode.LONGEST_MATCH).wakati(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.md5("wakati").alias("wakati_md5"))


def parse_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document's longest-match analysis."""
    return analyzer(spark, sf_dir, Mode.LONGEST_MATCH).parse(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.md5("parse").alias("parse_md5"))


def spans_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document: how many there are, whether they tile the text, and the sum of their starts."""
    out = analyzer(spark, sf_dir, Mode.LONGEST_MATCH).spans(documents(spark, sf_dir).select("doc_id", "text"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["start"])
    last = F.try_element_at("spans", F.lit(-1))["end"]
    return out.select("doc_id", F.size("spans").alias("n"), total.alias("starts"), (F.coalesce(last, F.lit(0)) == F.octet_length("text")).alias("whole"))


def pos_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyzer(spark, sf_dir, Mode.LONGEST_MATCH).tokens(documents(spark, sf_dir).select("text"), fields=("pos", "is_unknown"))
    return rows.groupBy("pos", "is_unknown").agg(F.count("*").alias("n"))


def unknown_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of unknown morphemes that are letters, by language of the document; the flagship."""
    rows = analyzer(spark, sf_dir).tokens(documents(spark, sf_dir).select("lang", "text"), fields=("char_class", "is_unknown")).where("char_class = 'ASCII_LETTER'")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("is_unknown").alias("n_unknown"))


def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of longest match against the cheapest path as gold, over distinct runs."""
    words = runs(spark, sf_dir)
    gold = analyzer(spark, sf_dir).wakachi(words, "run", "gold")
    both = analyzer(spark, sf_dir, Mode.LONGEST_MATCH).wakachi(gold, "run", "greedy")
    out = evaluate.boundary_scores(both, "gold", "greedy")
    return out.select("n_gold", "n_predicted", "n_shared", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def oracle_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best F1 within the k cheapest paths, against longest match as gold, over distinct runs.

    Which of equally cheap paths comes first is the search's own order, which SQL can't follow: there is none for this.
    """
    gold = analyzer(spark, sf_dir, Mode.LONGEST_MATCH).wakachi(runs(spark, sf_dir), "run", "gold")
    out = evaluate.oracle_at_k(analyzer(spark, sf_dir).nbest(gold, 3, "run"), "run", "gold", "paths", [1, 2, 3])
    return out.select("k", F.round("f1", 9).alias("f1"))


def mismatch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries that only the cheapest path or only longest match has, by the class of the character before."""
    gold = analyzer(spark, sf_dir).wakachi(runs(spark, sf_dir), "run", "gold")
    both = analyzer(spark, sf_dir, Mode.LONGEST_MATCH).wakachi(gold, "run", "greedy")
    return evaluate.mismatches(both, "run", "gold", "greedy", class_of)


# -- functions over texts


def locale_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variant of every document and conversation turn."""
    texts = documents(spark, sf_dir).select("text").union(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text"))
    marked = texts.select(F.explode(F.array(F.col("text"), F.concat("text", F.lit(" Colourless centre")), F.concat("text", F.lit(" color")))).alias("text"))
    return marked.groupBy(classify_english(F.col("text")).alias("locale")).agg(F.count("*").alias("n"))


def safe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document may be cut into pieces of 256 bytes and more."""
    cuts = documents(spark, sf_dir).select("doc_id", safe_chunk_offsets(F.col("text"), 256).alias("cuts"))
    return cuts.select("doc_id", F.array_join(F.transform("cuts", lambda x: x.cast("string")), ",").alias("cuts"))


def nfc_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of every document after its e with acute was decomposed."""
    return documents(spark, sf_dir).select("doc_id", F.md5(nfc(F.replace(F.col("text"), F.lit("é"), F.lit("é")))).alias("nfc_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lexicon_ids, homograph_groups, alphabet, user_merge, jyutping_merge, lemma_us, matrix_cells, fingerprint, snapshot_roundtrip,
        char_class_hist, class_runs, byte_offsets, prefix_matches, longest_match, lattice_nodes, lattice_edges, unk_resolve,
        greedy_words, viterbi_words, nbest_words, constrained_words, pinned_words, wakati_docs, parse_docs, spans_docs, pos_counts,
        unknown_rate_by_lang, boundary_f1, oracle_at_k, mismatch_classes, locale_en, safe_chunks, nfc_docs,
    )
}
FLAGSHIP = unknown_rate_by_lang

# -- SQL

_CLASS = """CASE WHEN unicode({0}) BETWEEN 9 AND 13 OR unicode({0}) = 32 THEN 'SPACE'
  WHEN unicode({0}) BETWEEN 48 AND 57 THEN 'DIGIT'
  WHEN unicode({0}) BETWEEN 65 AND 90 OR unicode({0}) BETWEEN 97 AND 122 OR unicode({0}) BETWEEN 192 AND 383 OR unicode({0}) = 7838 THEN 'ASCII_LETTER'
  WHEN unicode({0}) BETWEEN 33 AND 126 OR unicode({0}) BETWEEN 161 AND 191 OR unicode({0}) BETWEEN 8216 AND 8223 THEN 'PUNCT'
  WHEN unicode({0}) BETWEEN 9728 AND 10175 OR unicode({0}) BETWEEN 127744 AND 129791 THEN 'EMOJI' ELSE 'UNKNOWN' END"""
_CHARS = rf"""
chars AS (
  SELECT doc_id, i, ch, {_CLASS.format("ch")} AS char_class
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents WHERE text <> '')
), marked AS (
  SELECT *, sum(CAST(char_class IS DISTINCT FROM before AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS seq,
         sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT *, lag(char_class) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM chars)
), doc_runs AS (
  SELECT doc_id, seq, any_value(char_class) AS char_class, string_agg(ch, '' ORDER BY i) AS run, max(stop) AS stop,
         max(stop) - sum(strlen(ch)) AS start
  FROM marked GROUP BY doc_id, seq
)"""
_MATCHES = """
matches AS (
  SELECT run, p AS start, p + length(surface) AS stop, entry_id, cost, surface, pos, left_id, right_id
  FROM (SELECT run, unnest(range(length(run))) AS p FROM runs) AS spots
  JOIN (SELECT DISTINCT length(surface) AS n FROM lexicon) AS sizes ON p + n <= length(run)
  JOIN lexicon ON surface = substr(run, p + 1, n)
)"""
_NODES = """
nodes AS (
  SELECT run, start, stop, entry_id, cost, pos, 0 AS kind, stop AS place FROM matches
  UNION ALL
  SELECT run, p, stop, -1, 0, 'NOUN', 1, place FROM (
    SELECT run, p, unnest(CASE WHEN p + 1 = length(run) THEN [p + 1] ELSE [length(run), p + 1] END) AS stop,
           unnest(CASE WHEN p + 1 = length(run) THEN [0] ELSE [0, 1] END) AS place
    FROM (SELECT run, unnest(range(length(run))) AS p FROM runs) AS spots
    WHERE NOT EXISTS (SELECT 1 FROM matches WHERE matches.run = spots.run AND matches.start = p))
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY start, kind, place) AS node FROM nodes
)"""
# keys of a path, last node first: of equally cheap ones the search keeps the least
_PATHS = """
paths AS (
  SELECT run, stop, cost + 7000 AS cost, [node] AS keys, [substr(run, start + 1, stop - start)] AS surfaces FROM numbered WHERE start = 0 {where}
  UNION ALL
  SELECT paths.run, numbered.stop, paths.cost + numbered.cost + 7000, list_prepend(node, keys), list_append(surfaces, substr(paths.run, start + 1, numbered.stop - start))
  FROM paths JOIN numbered ON numbered.run = paths.run AND numbered.start = paths.stop {where}
), ranked AS (
  SELECT run, cost + 7000 AS cost, surfaces, row_number() OVER (PARTITION BY run ORDER BY cost, keys) AS rank
  FROM paths WHERE stop = length(run)
)"""
_GREEDY = """
longest AS (
  SELECT run, start, max(stop) AS stop FROM matches GROUP BY run, start
), walk AS (
  SELECT run, 0 AS stop, CAST([] AS VARCHAR[]) AS surfaces, 0 AS seq FROM runs
  UNION ALL
  SELECT walk.run, coalesce(longest.stop, length(walk.run)), list_append(surfaces, substr(walk.run, walk.stop + 1, coalesce(longest.stop, length(walk.run)) - walk.stop)), seq + 1
  FROM walk LEFT JOIN longest ON longest.run = walk.run AND longest.start = walk.stop
  WHERE walk.stop < length(walk.run)
), greedy AS (
  SELECT run, surfaces FROM walk WHERE stop = length(run)
)"""
_DOC_TOKENS = """
tokens AS (
  SELECT doc_id, seq, i, s AS surface, start + off AS start, char_class, lexicon.entry_id, coalesce(lexicon.pos, 'NOUN') AS pos, lexicon.surface IS NULL AS is_unknown
  FROM (SELECT doc_id, seq, start, char_class, unnest(l) AS s, unnest(range(len(l))) AS i,
               unnest(list_transform(range(len(l)), lambda k: coalesce(list_sum(list_transform(l[1:k], lambda x: strlen(x))), 0))) AS off
        FROM (SELECT doc_runs.*, coalesce({words}, [doc_runs.run]) AS l FROM doc_runs LEFT JOIN {table} AS w ON w.run = doc_runs.run AND doc_runs.char_class = 'ASCII_LETTER' {more})) AS t
  LEFT JOIN lexicon ON lexicon.surface = s AND char_class = 'ASCII_LETTER'
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n" + select


_BEST = (SQL_RUNS, _MATCHES, _NODES, _PATHS.format(where=""))
_GREEDY_DOCS = (SQL_RUNS, _MATCHES, _GREEDY, _CHARS, _DOC_TOKENS.format(words="w.surfaces", table="greedy", more=""))
_INNER = "list_transform(range(1, len({0})), lambda k: CAST(list_sum(list_transform({0}[1:k], lambda x: length(x))) AS BIGINT))"
_BOTH = f"""
boundaries AS (
  SELECT ranked.run, {_INNER.format("ranked.surfaces")} AS gold, {_INNER.format("greedy.surfaces")} AS predicted
  FROM ranked JOIN greedy USING (run) WHERE rank = 1
)"""

ORACLES: dict[str, str] = {
    "lexicon_ids": _with(SQL_RUNS, select="SELECT entry_id, surface, CAST(cost AS SMALLINT) AS cost, CAST(left_id AS SMALLINT) AS left_id, CAST(right_id AS SMALLINT) AS right_id, pos FROM lexicon"),
    "homograph_groups": _with(SQL_RUNS, select="SELECT lower(surface) AS folded, count(*) AS n, arg_min(entry_id, cost * 100000 + entry_id) AS entry_id FROM lexicon GROUP BY ALL"),
    "alphabet": _with(SQL_RUNS, select="SELECT ch, n, CAST(row_number() OVER (ORDER BY n DESC, unicode(ch)) - 1 AS INTEGER) AS code FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(surface, '')) AS ch FROM lexicon) GROUP BY ch)"),
    "user_merge": _with(SQL_RUNS, select="SELECT CAST(row_number() OVER (ORDER BY surface, o, entry_id) - 1 AS INTEGER) AS entry_id, surface, CAST(cost AS SMALLINT) AS cost, pos FROM (SELECT surface, cost, pos, 0 AS o, entry_id FROM lexicon UNION ALL VALUES ('zzz', -3000, 'USER', 1, 0), ('the', 5, 'USER', 1, 1), ('aaa', 7, 'USER', 1, 2))"),
    "jyutping_merge": _with(SQL_RUNS, select="SELECT entry_id, surface, CASE WHEN rank % 3 = 0 THEN 'r' || rank ELSE '*' END AS reading_jyutping FROM lexicon"),
    "lemma_us": _with(SQL_RUNS, "spelled AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SPELLINGS.items()) + ") AS t(gb, us))", select="SELECT surface, coalesce(us, surface) AS lemma FROM (SELECT gb AS surface FROM spelled UNION SELECT surface FROM lexicon) LEFT JOIN spelled ON gb = surface"),
    "matrix_cells": _with(SQL_RUNS, "stated AS (SELECT i % 2 AS l, i % 3 AS r, arg_max(i * 100, i) AS cost FROM range(1, 8) AS t(i) GROUP BY ALL)", select="SELECT a.right_id AS left, b.left_id AS right, CAST(coalesce(stated.cost, 7000) AS INTEGER) AS cost FROM (SELECT DISTINCT right_id FROM lexicon) AS a CROSS JOIN (SELECT DISTINCT left_id FROM lexicon) AS b LEFT JOIN stated ON l = a.right_id AND r = b.left_id"),
    "char_class_hist": f"SELECT {_CLASS.format('ch')} AS char_class, CAST(sum(n) AS BIGINT) AS n FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ch) GROUP BY 1",
    "class_runs": _with(_CHARS, select="SELECT doc_id, char_class, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS n_bytes, CAST(sum(start) AS BIGINT) AS starts FROM doc_runs GROUP BY ALL"),
    "byte_offsets": """SELECT item_id, CAST(pos AS INTEGER) AS pos, ch, CAST(stop - strlen(ch) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end"
FROM (SELECT item_id, pos, ch, sum(strlen(ch)) OVER (PARTITION BY item_id ORDER BY pos) AS stop
      FROM (SELECT item_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS pos FROM benchmark))""",
    "prefix_matches": _with(SQL_RUNS, _MATCHES, select='SELECT run, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", entry_id FROM matches'),
    "longest_match": _with(SQL_RUNS, _MATCHES, select='SELECT run, CAST(start AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS "end", arg_max(entry_id, stop) AS entry_id FROM matches GROUP BY run, start'),
    "lattice_nodes": _with(SQL_RUNS, _MATCHES, _NODES, select='SELECT run, CAST(node AS INTEGER) AS node, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", entry_id, CAST(cost AS SMALLINT) AS cost FROM numbered'),
    "lattice_edges": _with(SQL_RUNS, _MATCHES, _NODES, select="SELECT a.run, count(*) AS n, CAST(sum(7000 + b.cost) AS BIGINT) AS cost FROM numbered AS a JOIN numbered AS b ON a.run = b.run AND a.stop = b.start GROUP BY a.run"),
    "unk_resolve": _with(_CHARS, select="""SELECT pos, cost, count(*) AS n FROM (
  SELECT CASE WHEN starts_with(run, 'un') THEN 'ADJ' WHEN ends_with(run, 'tion') THEN 'NOUN,abstract' WHEN char_class = 'DIGIT' THEN 'NUM,whole' WHEN char_class = 'PUNCT' THEN 'PUNCT' WHEN char_class = 'SPACE' THEN 'SPACE' ELSE 'NOUN' END AS pos,
         CASE WHEN starts_with(run, 'un') THEN 4100 WHEN ends_with(run, 'tion') THEN 4200 WHEN char_class = 'DIGIT' THEN 1400 WHEN char_class = 'PUNCT' THEN 300 ELSE 0 END AS cost
  FROM (SELECT DISTINCT run, char_class FROM doc_runs)) GROUP BY ALL"""),
    "greedy_words": _with(SQL_RUNS, _MATCHES, _GREEDY, select="SELECT run, array_to_string(surfaces, ' ') AS wakati FROM greedy"),
    "viterbi_words": _with(*_BEST, select="SELECT run, array_to_string(surfaces, ' ') AS wakati FROM ranked WHERE rank = 1"),
    "nbest_words": _with(*_BEST, select="SELECT run, CAST(rank AS INTEGER) AS rank, CAST(cost AS BIGINT) AS cost FROM ranked WHERE rank <= 3"),
    "constrained_words": _with(SQL_RUNS, _MATCHES, _NODES, _PATHS.format(where="AND NOT (numbered.start < 2 AND numbered.stop > 2) AND numbered.stop <> 3 AND regexp_full_match(numbered.run, '[A-Za-z]{{4,}}')".replace("{{", "{").replace("}}", "}")),
        "asked AS (SELECT run FROM runs WHERE regexp_full_match(run, '[A-Za-z]{4,}'))",
        "ends AS (SELECT run, list(DISTINCT stop) AS reached FROM paths GROUP BY run)",
        select="""SELECT asked.run, coalesce(array_to_string(ranked.surfaces, ' '),
  'constraints unsatisfiable at byte offset ' || list_min(list_filter(range(1, length(asked.run) + 1), lambda q: NOT list_contains(coalesce(reached, []), q)))) AS wakati
FROM asked LEFT JOIN ranked ON ranked.run = asked.run AND rank = 1 LEFT JOIN ends ON ends.run = asked.run"""),
    "wakati_docs": _with(*_GREEDY_DOCS, select="SELECT documents.doc_id, md5(coalesce(string_agg(surface, ' ' ORDER BY seq, i), '')) AS wakati_md5 FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY documents.doc_id"),
    "parse_docs": _with(*_GREEDY_DOCS, select="SELECT documents.doc_id, md5(coalesce(string_agg(surface || E'\\t' || pos || E'\\t' || surface || E'\\t*\\t*', E'\\n' ORDER BY seq, i), '')) AS parse_md5 FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY documents.doc_id"),
    "spans_docs": _with(*_GREEDY_DOCS, select="SELECT documents.doc_id, CAST(count(surface) AS INTEGER) AS n, CAST(coalesce(sum(start), 0) AS BIGINT) AS starts, TRUE AS whole FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY documents.doc_id"),
    "pos_counts": _with(*_GREEDY_DOCS, select="SELECT pos, is_unknown, count(*) AS n FROM tokens GROUP BY ALL"),
    "unknown_rate_by_lang": _with(*_BEST, _CHARS, _DOC_TOKENS.format(words="w.surfaces", table="ranked", more="AND w.rank = 1"), select="SELECT lang, count(*) AS n, count(*) FILTER (is_unknown) AS n_unknown FROM tokens JOIN documents USING (doc_id) WHERE char_class = 'ASCII_LETTER' GROUP BY lang"),
    "boundary_f1": _with(*_BEST, _GREEDY, _BOTH, select="""SELECT n_gold, n_predicted, n_shared, round(n_shared / n_predicted, 9) AS precision, round(n_shared / n_gold, 9) AS recall, round(2.0 * n_shared / (n_gold + n_predicted), 9) AS f1
FROM (SELECT CAST(sum(len(gold)) AS BIGINT) AS n_gold, CAST(sum(len(predicted)) AS BIGINT) AS n_predicted, CAST(sum(len(list_intersect(gold, predicted))) AS BIGINT) AS n_shared FROM boundaries)"""),
    "mismatch_classes": _with(*_BEST, _GREEDY, _BOTH, select=f"""SELECT kind, {_CLASS.format("substr(run, spot, 1)")} AS char_class, count(*) AS n
FROM (SELECT run, 'miss' AS kind, unnest(list_filter(gold, lambda x: NOT list_contains(predicted, x))) AS spot FROM boundaries
      UNION ALL SELECT run, 'over_split', unnest(list_filter(predicted, lambda x: NOT list_contains(gold, x))) FROM boundaries) GROUP BY ALL"""),
    "locale_en": """WITH texts AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations),
marked AS (SELECT lower(unnest([text, text || ' Colourless centre', text || ' color'])) AS t FROM texts)
SELECT CASE WHEN s > 0 THEN 'GB' WHEN s < 0 THEN 'US' ELSE 'NONE' END AS locale, count(*) AS n
FROM (SELECT CAST(contains(t, 'colour') AS INTEGER) + CAST(contains(t, 'defence') AS INTEGER) + CAST(contains(t, 'centre') AS INTEGER) + CAST(contains(t, 'travelling') AS INTEGER)
  - CAST(contains(t, 'color') AS INTEGER) - CAST(contains(t, 'defense') AS INTEGER) - CAST(contains(t, 'center') AS INTEGER) - CAST(contains(t, 'traveling') AS INTEGER) AS s FROM marked) GROUP BY 1""",
    "safe_chunks": r"""WITH RECURSIVE lines AS (
  SELECT doc_id, text, p FROM (SELECT doc_id, text, unnest(range(2, length(text) + 1)) AS p FROM documents WHERE text <> '')
  WHERE substr(text, p - 1, 1) = chr(10) AND NOT contains(E' \t\n\x0b\x0c\r', substr(text, p, 1))
), cuts AS (SELECT doc_id, list(strlen(substr(text, 1, p - 1)) ORDER BY p) AS c FROM lines GROUP BY doc_id),
chosen AS (
  SELECT doc_id, c, CAST([] AS BIGINT[]) AS out, CAST(0 AS BIGINT) AS last FROM cuts
  UNION ALL
  SELECT doc_id, c, list_append(out, next), next FROM (
    SELECT doc_id, c, out, CAST(list_min(list_filter(c, lambda x: x - last >= 256)) AS BIGINT) AS next FROM chosen) WHERE next IS NOT NULL
)
SELECT documents.doc_id, coalesce(array_to_string(arg_max(out, len(out)), ','), '') AS cuts FROM documents LEFT JOIN chosen USING (doc_id) GROUP BY documents.doc_id""",
    "nfc_docs": "SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS nfc_md5 FROM documents",
    "snapshot_roundtrip": _with(SQL_RUNS, select="SELECT entry_id, surface, CAST(cost AS SMALLINT) AS cost, CAST(left_id AS SMALLINT) AS left_id, CAST(right_id AS SMALLINT) AS right_id, pos FROM lexicon"),
}
