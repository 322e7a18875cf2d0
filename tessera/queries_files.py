"""More queries and their SQL: dictionaries and resources read from files, languages, faults, and the evaluation's tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import queries as q
from tessera.functions.charclass import class_of, default_ranges, overlay
from tessera.functions.lemma import SIMPLIFIED, SPELLINGS, lemma_expression
from tessera.functions.text import classify_chinese, pos_has, pos_pattern_valid, pos_prefix_matches, safe_chunks
from tessera.operators import relational as rel
from tessera.plans import evaluate
from tessera.plans.analyzer import Analyzer
from tessera.sources import corpora
from tessera.sources import resources as rs
from tessera.sources.files import shared_folder, write_text
from tessera.types import BoundaryConstraint, Constraints, Language, Locale, Mode, TokenConstraint, TokenizeOptions

# -- dictionaries from files

MATRIX = "2 3\n0 0 1\n0 1 6500\n0 2 5800\n1 0 6900\n1 1 5000\n0 0 6000\n"
SQL_EDGE = "(CASE 10 * {0} + {1} WHEN 0 THEN 6000 WHEN 1 THEN 6500 WHEN 2 THEN 5800 WHEN 10 THEN 6900 WHEN 11 THEN 5000 ELSE 7000 END)"


def _csv(spark: SparkSession, sf_dir: str) -> str:
    """The lexicon as a file of 13 columns; its rows are bounded by the size of the lexicon."""
    lines = []
    for r in q.lexicon_rows(spark, sf_dir).orderBy("line_no").collect():
        pos = [*r.pos.split(","), *["*"] * 5][:6]
        lines.append(",".join([f'"{r.surface}"', str(r.left_id), str(r.right_id), str(r.cost), *pos, f"{r.surface}-", f"r{r['rank']}", "*"]))
    return "\r\n".join(lines) + "\r\n\n"


def _loaded(spark: SparkSession, sf_dir: str, **files: str) -> Analyzer:
    """A German dictionary read from a file, with the resource files beside it."""
    folder = shared_folder(spark)
    for name, text in {"german_csv": _csv(spark, sf_dir), **files}.items():
        write_text(spark, f"{folder}/{name.replace('_', '.')}", text)
    return Analyzer.load(spark, Language.GERMAN, f"{folder}/german.csv")


def loaded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a dictionary read from a file."""
    return _loaded(spark, sf_dir).lexicon().select("entry_id", "surface", "cost", "pos", "lemma", "reading")


def matrix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest segmentation of every distinct run, and its cost, by connection costs, unknown rules, patterns and flags from files."""
    a = _loaded(spark, sf_dir, matrix_def=MATRIX, char_def="ALPHA 0 1 0\n", unk_def="ALPHA,0,0,1200,NOUN\n", patterns_qpat="prefix,un,0,0,900,ADJ\nsuffix,t,0,0,1100,VERB\ncharset,ALPHA,0,0,1150,NOUN\n")
    out = a.nbest(a.wakati(q.runs(spark, sf_dir), "run"), 1, "run")
    return out.select("run", "wakati", F.get("paths", F.lit(0))["cost"].alias("cost"))


def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dictionary and its matrix hold."""
    s = _loaded(spark, sf_dir, matrix_def=MATRIX).stats()
    return spark.createDataFrame([(s.entries, s.terminals, s.prefixes, s.matrix_cells, s.matrix_explicit)], "entries int, terminals int, prefixes int, matrix_cells int, matrix_explicit int")


def entry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth entry by its id, from an analyser that was cloned before the other was closed."""
    with q.analyzer(spark, sf_dir) as first:
        a = first.clone()
    n = a.stats().entries
    found = [(i, *[a.entry_info(i)[f] for f in ("surface", "cost", "pos")]) for i in range(0, n, 100)]
    return spark.createDataFrame(found, "entry_id int, surface string, cost short, pos string")


# -- resources

CHAR_DEF = "0x41..0x5A KANJI\n0x30..0x39 HIRAGANA # all digits\n0x35 EMOJI\n97 122 NOBODY\nKANJI 1 0 2\n"


def char_def_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents by class, after declared ranges lie over the built-in ones."""
    ranges = overlay(default_ranges(Language.GERMAN), rs.char_definitions(CHAR_DEF)[0])
    counted = q.documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return counted.groupBy(class_of(F.ascii("ch"), ranges).alias("char_class")).agg(F.sum("n").alias("n"))


UNK_DEF = "NUMERIC,0,0,1500,NUM,*\nPUNCT,0,0,300,PUNCT\nSPACE,0,0,0,SPACE\n"
QPAT = "prefix,un,0,0,4100,ADJ\n\nsuffix,tion,0,0,4200,NOUN,abstract\ncharset,DIGIT,0,0,1400,NUM,whole\n"


def unk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all distinct runs resolve as unknown candidates by rules and patterns in the form of files."""
    found = rel.class_runs(q.documents(spark, sf_dir), "doc_id").select("run", "char_class").distinct()
    got = rel.resolve_unknown(F.col("run"), F.col("char_class"), rs.unk_rules(UNK_DEF), rs.unk_patterns(QPAT), Language.GERMAN.fallback_pos, default_ranges(Language.GERMAN))
    return found.select("run", got.alias("r")).groupBy("r.pos", "r.cost").agg(F.count("*").alias("n"))


def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words that begin at a position of a distinct run: how many, and the sums of their places and ids."""
    found = rel.prefix_matches(q._words(spark, sf_dir), q.lexicon(spark, sf_dir).select("surface", "entry_id"))
    return found.groupBy(F.col("id").alias("run")).agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum("entry_id").alias("ids"))


# -- languages: all documents with their Latin letters written as characters of another script

LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HAN = "天地人日月山川水火木金土上下左右東西南北春夏秋冬風雨"
KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def _written(spark: SparkSession, sf_dir: str, script: str) -> tuple[DataFrame, DataFrame]:
    """(run) of all documents in the script, and a lexicon of the most frequent ones."""
    text = F.translate("text", LATIN, script * 2)
    found = q.documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(text, F.lit(f"[{script}]+"), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    return found.select("run"), q.ranked_rows(found)


def chinese_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest segmentation of every distinct run of Han characters."""
    words, rows = _written(spark, sf_dir, HAN)
    return Analyzer.of_frame(spark, Language.CHINESE_TW, rows).wakati(words, "run").select("run", "wakati")


def japanese_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match segmentation of every distinct run of Hiragana."""
    words, rows = _written(spark, sf_dir, KANA)
    return Analyzer.of_frame(spark, Language.JAPANESE, rows, Mode.LONGEST_MATCH).wakati(words, "run").select("run", "wakati")


def lemma_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplified lemmas of the Han dictionary and of all characters of the table."""
    spelled = spark.createDataFrame([("".join(SIMPLIFIED),), *[(x,) for x in SIMPLIFIED]], "surface string")
    both = spelled.union(_written(spark, sf_dir, HAN)[1].select("surface")).distinct()
    return both.select("surface", lemma_expression(F.col("surface"), Language.CHINESE_TW, Locale.CN).alias("lemma"))


def lemma_gb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """British lemmas of all American spellings and of the dictionary."""
    spelled = spark.createDataFrame([(x,) for x in SPELLINGS.values()], "surface string")
    both = spelled.union(q.lexicon_rows(spark, sf_dir).select("surface")).distinct()
    return both.select("surface", lemma_expression(F.col("surface"), Language.ENGLISH_US, Locale.GB).alias("lemma"))


def locale_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant of every document, and of those with Bopomofo after them."""
    marked = q.documents(spark, sf_dir).select(F.explode(F.array(F.col("text"), F.concat("text", F.lit("ㄅ")))).alias("text"))
    return marked.groupBy(classify_chinese(F.col("text")).alias("locale")).agg(F.count("*").alias("n"))


# -- options and faults


def biased_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest segmentation of every distinct run when unknown words cost more, the longer they are."""
    opts = TokenizeOptions(unk_cost_bias=2500, unk_cost_per_rune=1700)
    return q.analyzer(spark, sf_dir).wakati(q.runs(spark, sf_dir), "run", opts=opts).select("run", "wakati")


def strict_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fault of every document under strict UTF-8, after a third of them got a byte that is none."""
    raw = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.lit(b"\x80")).otherwise(F.lit(b"")))
    docs = q.documents(spark, sf_dir).select("doc_id", raw.alias("text"))
    out = q.analyzer(spark, sf_dir, Mode.LONGEST_MATCH).wakachi(docs, opts=TokenizeOptions(strict_utf8=True), on_error="column")
    return out.select("doc_id", "error", F.size("surfaces").isNotNull().alias("done"))


def _pin(*spans: tuple) -> Constraints:
    return Constraints(tuple(TokenConstraint(*s) for s in spans))


FAULTS = [
    _pin((0, 1_000_000)),
    _pin((1, 1)),
    _pin((0, 1, ",X")),
    _pin((0, 1), (0, 1)),
    Constraints((), (BoundaryConstraint(0),)),
    Constraints((), (BoundaryConstraint(1, True), BoundaryConstraint(1, False))),
    Constraints((TokenConstraint(0, 1),), (BoundaryConstraint(1, False),)),
]


def constraint_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with sets of constraints, for every distinct run."""
    a, words = q.analyzer(spark, sf_dir), q.runs(spark, sf_dir).select("run")
    parts = [a.tokenize_constrained(words, c, "run", on_error="column").select(F.lit(i).alias("fault"), "error") for i, c in enumerate(FAULTS)]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("fault", "error").agg(F.count("*").alias("n"))


def constrained_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the two cheapest paths of every distinct run, under a column of constraints that are all null."""
    out = q.analyzer(spark, sf_dir).nbest(q.runs(spark, sf_dir).select("run").withColumn("c", F.lit(None).cast(CONSTRAINT_TYPE)), 2, "run", constraints="c", on_error="column")
    return out.select("run", F.explode("paths").alias("p")).select("run", "p.rank", "p.cost")


CONSTRAINT_TYPE = "struct<tokens:array<struct<start:int,end:int,pos:string>>,boundaries:array<struct<at:int,must_exist:boolean>>>"


def pos_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by whether their part of speech has a part, begins with a pattern, and is a pattern itself."""
    rows = q.lexicon_rows(spark, sf_dir)
    return rows.groupBy(pos_has(F.col("pos"), "proper").alias("proper"), pos_prefix_matches(F.lit("NOUN"), F.col("pos")).alias("noun"), pos_pattern_valid(F.concat("pos", F.lit(","))).alias("valid")).agg(F.count("*").alias("n"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document of 300 bytes and more, put together again, and how many there are."""
    found = q.documents(spark, sf_dir).select("doc_id", safe_chunks(F.col("text"), 300).alias("c"))
    return found.select("doc_id", F.md5(F.array_join("c", "")).alias("text_md5"), F.forall("c", lambda x: (x != "") | (F.size("c") == 1)).alias("whole"))


# -- evaluation


def run_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.runs(spark, sf_dir).groupBy(F.char_length("run").alias("size")).agg(evaluate.median("n").alias("median"))


def gold_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a corpus in lines, one for each document, read back."""
    words = F.regexp_extract_all("text", F.lit(q.LETTERS), F.lit(0))
    lines = F.concat(F.array(F.lit("# S-ID:1"), F.lit("* 1D")), F.transform(words, lambda w: F.concat(w, F.lit(" x NOUN\r"))), F.array(F.lit("EOS"), F.lit("left over")))
    corpus = q.documents(spark, sf_dir).select(F.col("doc_id").alias("file"), F.posexplode(lines).alias("line_no", "value"))
    return corpora.gold_sentences(corpus).select(F.col("file").alias("doc_id"), "sentence", F.size("surfaces").alias("n"), F.md5(F.array_join("surfaces", " ")).alias("surfaces_md5"))


def fixture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty lines of a dictionary in lower case, and its first homograph."""
    rows = q.lexicon_rows(spark, sf_dir).select(F.lower("surface").alias("surface"), "cost", "line_no")
    return corpora.sample(rows, 50, 7)


def german_wordbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary rows of a wordbook whose forms are the lexicon's words, their capitals, and pairs of words."""
    rows = q.lexicon_rows(spark, sf_dir)
    forms = rows.select(F.explode(F.array(F.col("surface"), F.initcap("surface"), F.concat_ws(" ", "surface", "surface"))).alias("form"), F.col("surface").alias("lemma"), "pos")
    return corpora.german_entries(forms.where(F.col("lemma").rlike("^[A-Za-z]+$")))


def bias_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the cheapest path against longest match on a grid of unknown-word costs, over distinct runs.

    Each point is a search of its own; the paths of one of them are held against SQL by ``biased_words``.
    """
    gold = q.analyzer(spark, sf_dir, Mode.LONGEST_MATCH).wakachi(q.runs(spark, sf_dir), "run", "gold")
    out = evaluate.grid_sweep(q.analyzer(spark, sf_dir), gold, "run", "gold", [0, 2500], [0, 1700])
    return out.select("bias", "per_rune", F.round("f1", 9).alias("f1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        loaded_lexicon, matrix_words, dictionary_stats, entry_lookup, char_def_hist, unk_files, prefix_sums, chinese_words, japanese_words, lemma_zh, lemma_gb, locale_zh,
        biased_words, strict_docs, constraint_faults, constrained_nbest, pos_tests, chunk_texts, run_median, gold_corpus, fixture_sample, german_wordbook, bias_grid,
    )
}

# -- SQL


def _script_runs(script: str) -> str:
    return q.SQL_RUNS.replace(f"regexp_extract_all(text, '{q.LETTERS}')", f"regexp_extract_all(translate(text, '{LATIN}', '{script * 2}'), '[{script}]+')")


_NODES = """
nodes AS (
  SELECT run, start, stop, entry_id, cost, left_id AS l, right_id AS r, 0 AS kind, stop AS place FROM matches
  UNION ALL
  SELECT run, p, length(run), -1, CASE WHEN substr(run, p + 1, 2) = 'un' THEN 900 WHEN suffix(run, 't') THEN 1100 ELSE 1150 END, 0, 0, 1, 0
  FROM (SELECT run, unnest(range(length(run))) AS p FROM runs) AS spots
  WHERE NOT EXISTS (SELECT 1 FROM matches WHERE matches.run = spots.run AND matches.start = p)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY start, kind, place) AS node FROM nodes
)"""
_PATHS = f"""
paths AS (
  SELECT run, stop, r, cost + {SQL_EDGE.format("0", "l")} AS cost, [node] AS keys, [substr(run, start + 1, stop - start)] AS surfaces FROM numbered WHERE start = 0
  UNION ALL
  SELECT paths.run, numbered.stop, numbered.r, paths.cost + numbered.cost + {SQL_EDGE.format("paths.r", "numbered.l")}, list_prepend(node, keys), list_append(surfaces, substr(paths.run, start + 1, numbered.stop - start))
  FROM paths JOIN numbered ON numbered.run = paths.run AND numbered.start = paths.stop
), ranked AS (
  SELECT run, cost + {SQL_EDGE.format("r", "0")} AS cost, surfaces, row_number() OVER (PARTITION BY run ORDER BY cost + {SQL_EDGE.format("r", "0")}, keys) AS rank
  FROM paths WHERE stop = length(run)
)"""
_ASCII = "unicode(substr(run, 1, 1)) < 128"
_NOT_RUNE = "'bad constraint 0: Not_Rune_Boundary (start {0}, end {1})'"
_ALL_PREFIXES = "(SELECT count(DISTINCT substr(surface, 1, n)) FROM (SELECT surface, unnest(range(1, length(surface) + 1)) AS n FROM lexicon))"

ORACLES: dict[str, str] = {
    "loaded_lexicon": q._with(q.SQL_RUNS, select="SELECT entry_id, surface, CAST(cost AS SMALLINT) AS cost, pos, surface || '-' AS lemma, 'r' || rank AS reading FROM lexicon"),
    "matrix_words": q._with(q.SQL_RUNS, q._MATCHES, _NODES, _PATHS, select="SELECT run, array_to_string(surfaces, ' ') AS wakati, CAST(cost AS BIGINT) AS cost FROM ranked WHERE rank = 1"),
    "dictionary_stats": q._with(q.SQL_RUNS, select=f"SELECT CAST(count(*) AS INTEGER) AS entries, CAST(count(DISTINCT surface) AS INTEGER) AS terminals, CAST({_ALL_PREFIXES} AS INTEGER) AS prefixes, 6 AS matrix_cells, 5 AS matrix_explicit FROM lexicon"),
    "entry_lookup": q._with(q.SQL_RUNS, select="SELECT entry_id, surface, CAST(cost AS SMALLINT) AS cost, pos FROM lexicon WHERE entry_id % 100 = 0"),
    "char_def_hist": f"""SELECT CASE WHEN ch = '5' THEN 'EMOJI' WHEN ch BETWEEN '0' AND '9' THEN 'HIRAGANA' WHEN ch BETWEEN 'A' AND 'Z' THEN 'KANJI' WHEN ch BETWEEN 'a' AND 'z' THEN 'UNKNOWN' ELSE {q._CLASS.format("ch")} END AS char_class, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ch) GROUP BY 1""",
    "unk_files": q.ORACLES["unk_resolve"],
    "prefix_sums": q._with(q.SQL_RUNS, q._MATCHES, select="SELECT run, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS ends, CAST(sum(entry_id) AS BIGINT) AS ids FROM matches GROUP BY run"),
    "chinese_words": q._with(_script_runs(HAN), q._MATCHES, q._NODES, q._PATHS.format(where=""), select="SELECT run, array_to_string(surfaces, ' ') AS wakati FROM ranked WHERE rank = 1"),
    "japanese_words": q._with(_script_runs(KANA), q._MATCHES, q._GREEDY, select="SELECT run, array_to_string(surfaces, ' ') AS wakati FROM greedy"),
    "lemma_zh": q._with(_script_runs(HAN), select="SELECT surface, translate(surface, '{0}', '{1}') AS lemma FROM (SELECT surface FROM lexicon UNION SELECT unnest(string_split('{0}', '')) UNION SELECT '{0}')".format("".join(SIMPLIFIED), "".join(SIMPLIFIED.values()))),
    "lemma_gb": q._with(q.SQL_RUNS, "spelled AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SPELLINGS.items()) + ") AS t(gb, us))", select="SELECT surface, coalesce(gb, surface) AS lemma FROM (SELECT us AS surface FROM spelled UNION SELECT surface FROM lexicon) LEFT JOIN spelled ON us = surface"),
    "locale_zh": "SELECT CASE WHEN regexp_matches(t, '[㄀-ㄯㆠ-ㆿ]') THEN 'TW' ELSE 'NONE' END AS locale, count(*) AS n FROM (SELECT unnest([text, text || 'ㄅ']) AS t FROM documents) GROUP BY 1",
    "biased_words": q._with(q.SQL_RUNS, q._MATCHES, q._NODES.replace("SELECT run, p, stop, -1, 0, 'NOUN', 1, place", "SELECT run, p, stop, -1, 2500 + 1700 * (stop - p), 'NOUN', 1, place"), q._PATHS.format(where=""), select="SELECT run, array_to_string(surfaces, ' ') AS wakati FROM ranked WHERE rank = 1"),
    "strict_docs": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'malformed UTF-8 at byte offset ' || strlen(text) END AS error, text IS NOT NULL AND doc_id % 3 <> 0 AS done FROM documents",
    "constraint_faults": q._with(q.SQL_RUNS, "found AS (" + " UNION ALL ".join(f"SELECT {i} AS fault, {e} AS error FROM runs" for i, e in enumerate([
        "'bad constraint 0: Out_Of_Bounds (start 0, end 1000000)'",
        "'bad constraint 0: Empty_Span (start 1, end 1)'",
        f"CASE WHEN {_ASCII} THEN 'bad constraint 0: Bad_Pos_Pattern (start 0, end 1)' ELSE {_NOT_RUNE.format(0, 1)} END",
        f"CASE WHEN {_ASCII} THEN 'bad constraint 1: Token_Overlap (start 0, end 1)' ELSE {_NOT_RUNE.format(0, 1)} END",
        "'bad constraint 0: Out_Of_Bounds (start 0, end -1)'",
        f"CASE WHEN strlen(run) = 1 THEN 'bad constraint 0: Out_Of_Bounds (start 1, end -1)' WHEN {_ASCII} THEN 'bad constraint -1: Conflicting_Boundaries (start 1, end -1)' ELSE {_NOT_RUNE.format(1, -1)} END",
        f"CASE WHEN NOT {_ASCII} THEN {_NOT_RUNE.format(0, 1)} WHEN strlen(run) = 1 THEN 'bad constraint 0: Out_Of_Bounds (start 1, end -1)' ELSE 'bad constraint 0: Boundary_At_Token_Edge (start 1, end -1)' END",
    ])) + ")", select="SELECT fault, error, count(*) AS n FROM found GROUP BY ALL"),
    "constrained_nbest": q._with(*q._BEST, select="SELECT run, CAST(rank AS INTEGER) AS rank, CAST(cost AS BIGINT) AS cost FROM ranked WHERE rank <= 2"),
    "pos_tests": q._with(q.SQL_RUNS, select="SELECT contains(pos, 'proper') AS proper, pos = 'NOUN' OR starts_with(pos, 'NOUN,') AS noun, FALSE AS valid, count(*) AS n FROM lexicon GROUP BY ALL"),
    "chunk_texts": "SELECT doc_id, md5(text) AS text_md5, TRUE AS whole FROM documents",
    "run_median": q._with(q.SQL_RUNS, select="SELECT CAST(length(run) AS INTEGER) AS size, CAST(median(n) AS DOUBLE) AS median FROM runs GROUP BY 1"),
    "gold_corpus": f"""SELECT doc_id, 0 AS sentence, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, ' ')) AS surfaces_md5
FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{q.LETTERS}'), lambda x: x[1] <> 'E') AS s FROM documents)""",
    "fixture_sample": q._with(q.SQL_RUNS, "r AS (SELECT lower(surface) AS surface, CAST(cost AS SMALLINT) AS cost, CAST(rank AS BIGINT) AS line_no FROM lexicon)", "p AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY line_no) AS k FROM r)",
        select="(SELECT * FROM r ORDER BY md5('7:' || line_no), line_no LIMIT 50) UNION ALL SELECT surface, cost, line_no FROM p WHERE k <= 2 AND surface = (SELECT surface FROM p WHERE k = 2 ORDER BY line_no LIMIT 1)"),
    "german_wordbook": q._with(q.SQL_RUNS, "f AS (SELECT unnest([surface, upper(surface[1]) || lower(surface[2:])]) AS surface, pos, surface AS lemma FROM lexicon WHERE regexp_full_match(surface, '[A-Za-z]+'))",
        select="SELECT surface, CAST(0 AS SMALLINT) AS left_id, CAST(0 AS SMALLINT) AS right_id, CAST(1000 AS SMALLINT) AS cost, pos, lemma FROM (SELECT surface, pos, lemma FROM f UNION SELECT lower(surface), pos, lemma FROM f WHERE starts_with(pos, 'NOUN') AND lower(surface) <> surface UNION SELECT l, 'FUGE', l FROM (SELECT unnest(['s', 'es', 'e', 'n', 'en', 'ns']) AS l))"),
}
