"""The analyser: a dictionary, loaded as DataFrames and broadcast once, applied to text columns.

Each method that reads texts adds a column to the given DataFrame by one ``mapInArrow``: no shuffle, and filters on
other columns and column pruning stay below it. A method asks its kernel for what it returns and no more, so
``wakachi`` doesn't build morphemes.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.cluster import ship
from tessera.functions.charclass import default_ranges, overlay
from tessera.functions.text import classify_locale
from tessera.operators.batches import BatchSegmenter, decoded, joined, nbest_rows, segmented, segmenter_of, slices
from tessera.operators.compiled import CompiledDictionary
from tessera.operators.kernel import Segmenter, Token, scan_text
from tessera.plans.views import Morphemes
from tessera.sources import lexicon as lx
from tessera.sources import resources as rs
from tessera.types import LEXICON, MORPHEME, PATH, SPAN, CancelledError, CharClass, Constraints, Language, LoadError, LoadOptions, Mode, PatternKind, SaveError, Stats, TesseraError, TokenizeOptions, UnavailableError, UserEntry

#: Texts of a batch; long texts make batches of many bytes.
BATCH_ROWS = 500
SNAPSHOT_VERSION = 1


#: A scan of few files and of no more bytes than this for each core is dealt over the cores.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, in as many partitions as there are cores where it is small and comes from fewer files than that.

    A small file may be one row group, and so one task. Large inputs have splits enough and are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or not 0 < len(df.inputFiles()) < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES * cores else df


class Analyzer:
    """An immutable dictionary in a session. Changes give new analysers; ``close`` releases the broadcast."""

    def __init__(self, spark: SparkSession, dictionary: CompiledDictionary):
        self.spark, self.dictionary = spark, dictionary
        self._shared, self.closed = None, False

    # -- loading

    @classmethod
    def load(cls, spark: SparkSession, language: Language, path: str, opts: LoadOptions | None = None) -> Analyzer:
        """From a dictionary file, with the resource files beside it or at stated paths."""
        rows = lx.read_lexicon(spark, Language(language), path)
        return cls._build(spark, Language(language), rows, lambda: lx.parse_text(Language(language), rs.read_text(spark, path)), opts or LoadOptions(), path)

    @classmethod
    def load_bytes(cls, spark: SparkSession, language: Language, data: bytes, opts: LoadOptions | None = None) -> Analyzer:
        """From a dictionary in memory; resource files count only at stated paths."""
        rows = lx.parse_text(Language(language), bytes(data).decode("utf-8", "replace"))
        return cls._build(spark, Language(language), spark.createDataFrame(rows, lx.ROW), None, opts or LoadOptions(), None)

    @classmethod
    def of_frame(cls, spark: SparkSession, language: Language, rows: DataFrame, mode: Mode = Mode.VITERBI, **more) -> Analyzer:
        """From a DataFrame with surface, left_id, right_id, cost, pos and, if wanted, the other columns and line_no."""
        have = set(rows.columns)
        defaults = {"line_no": F.monotonically_increasing_id(), "lemma": F.col("surface"), "reading": F.lit("*"), "reading_jyutping": F.lit("*"), "extra": F.array().cast("array<string>")}
        rows = rows.withColumns({k: v for k, v in defaults.items() if k not in have})
        return cls(spark, cls._compiled(rows, language, mode, more))

    @staticmethod
    def _compiled(rows: DataFrame, language: Language, mode: Mode, more: dict) -> CompiledDictionary:
        """The numbered rows on the driver. This is the dictionary, whose size doesn't depend on the texts."""
        table = lx.numbered(rows).orderBy("entry_id").select("surface", "left_id", "right_id", "cost", "pos", "lemma", "reading", "reading_jyutping", "extra").toArrow()
        if table.column("surface").null_count:
            raise LoadError("invalid format")
        columns = [c.to_pylist() for c in table.columns]
        return CompiledDictionary(language, mode, *columns, more.pop("ranges", None) or default_ranges(language), **more)

    @classmethod
    def _build(cls, spark: SparkSession, language: Language, rows: DataFrame, again: Callable | None, opts: LoadOptions, path: str | None) -> Analyzer:
        skipped: list[str] = []

        def resource(stated: str | None, name: str) -> str | None:
            for p in (stated, str(PurePosixPath(path).parent / name) if path else None):
                if p:
                    try:
                        return rs.read_text(spark, p)
                    except LoadError:
                        pass
            skipped.append(name)
            return None

        declared = resource(opts.char_def_path, "char.def")
        ranges, flags = rs.char_definitions(declared) if declared is not None else ([], {})
        rules = resource(opts.unk_def_path, "unk.def")
        costs = resource(opts.matrix_def_path, "matrix.def")
        patterns = resource(opts.qpat_path, "patterns.qpat")
        more = {
            "ranges": overlay(default_ranges(language), ranges),
            "flags": flags,
            "rules": rs.unk_rules(rules) if rules is not None else [],
            "matrix": _matrix_or_none(costs),
            "patterns": rs.unk_patterns(patterns) if patterns is not None else [],
            "skipped": skipped,
        }
        if opts.jyutping_csv_path:
            rows = lx.with_jyutping(rows, _donor(spark, opts.jyutping_csv_path))
        rows = lx.with_lemmas_for(rows, language, opts.lemma_locale, opts.zh_table)
        try:
            return cls(spark, cls._compiled(rows, language, opts.mode, more))
        except LoadError:
            if again is not None:
                again()
            raise

    # -- lifecycle

    def __enter__(self) -> Analyzer:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Release the executors' copies; later calls raise UnavailableError."""
        if self._shared is not None:
            self._shared.unpersist()
        self._shared, self.closed = None, True

    def clone(self) -> Analyzer:
        return Analyzer(self.spark, self._open())

    def _open(self) -> CompiledDictionary:
        if self.closed:
            raise UnavailableError
        return self.dictionary

    # -- analysis of columns

    def _map(self, df: DataFrame, text: str, out: str, kind: T.DataType, work: Callable, opts: TokenizeOptions, on_error: str) -> DataFrame:
        if on_error not in ("raise", "column"):
            raise ValueError("on_error is 'raise' or 'column'")
        d = self._open()
        if opts.cancel_token is not None and opts.cancel_token.cancelled:
            raise CancelledError(0)
        opts = replace(opts, cancel_token=None)
        ship(self.spark)
        if self._shared is None:
            self._shared = self.spark.sparkContext.broadcast(d)
        shared, keep_errors = self._shared, on_error == "column"
        new = [out, "error"] if keep_errors else [out]
        keep = [f for f in df.schema if f.name not in new]
        schema = T.StructType([*keep, T.StructField(out, kind), *([T.StructField("error", T.StringType())] * keep_errors)])

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, BATCH_ROWS):
                    result, error = work(batch, segmenter_of(shared.value, opts), opts, keep_errors)
                    yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), result, *([error] * keep_errors)], schema.fieldNames())

        return spread(df).mapInArrow(kernel, schema)

    def _segmented(self, df: DataFrame, fields: T.StructType | None, text: str, out: str, opts: TokenizeOptions | None, on_error: str, constraints: str | None = None) -> DataFrame:
        kind = T.ArrayType(T.StringType() if fields is None else fields)
        if text == out:
            raise ValueError("the result needs a column of its own")
        names = None if fields is None else tuple(fields.names)
        return self._map(df, text, out, kind, lambda b, of, o, keep: segmented(b, of, o, names, text, constraints, keep), opts or TokenizeOptions(), on_error)

    def _joined(self, df: DataFrame, kind: str, between: str, text: str, out: str, opts: TokenizeOptions | None) -> DataFrame:
        if text == out:
            raise ValueError("the result needs a column of its own")
        return self._map(df, text, out, T.StringType(), lambda b, of, o, keep: joined(b, of, o, kind, between, text, keep), opts or TokenizeOptions(), "raise")

    def tokenize(self, df: DataFrame, text: str = "text", out: str = "morphemes", opts: TokenizeOptions | None = None, on_error: str = "raise") -> DataFrame:
        """Adds the morphemes of a text column (string or binary). A null text gives null."""
        return self._segmented(df, MORPHEME, text, out, opts, on_error)

    def tokens(self, df: DataFrame, text: str = "text", opts: TokenizeOptions | None = None, fields: Iterable[str] | None = None) -> DataFrame:
        """One row per morpheme: the other columns, ``seq`` from 0 and the morpheme's fields, or those asked for alone."""
        kind = MORPHEME if fields is None else T.StructType([MORPHEME[f] for f in fields])
        rows = self._segmented(df, kind, text, "morphemes_", opts, "raise")
        keep = [c for c in df.columns if c != text and c not in ("seq", *kind.names)]
        return rows.select(*[f"`{c}`" for c in keep], F.posexplode("morphemes_").alias("seq", "m")).select(*[f"`{c}`" for c in keep], "seq", "m.*")

    def tokenize_into(self, df: DataFrame, path: str, text: str = "text", opts: TokenizeOptions | None = None) -> DataFrame:
        """Write the morphemes to a Parquet table at ``path``, whose old contents go, and return it."""
        done = self.tokenize(df, text, opts=opts)
        done.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(done.schema).parquet(path)

    def wakachi(self, df: DataFrame, text: str = "text", out: str = "surfaces", opts: TokenizeOptions | None = None, on_error: str = "raise") -> DataFrame:
        return self._segmented(df, None, text, out, opts, on_error)

    def spans(self, df: DataFrame, text: str = "text", out: str = "spans", opts: TokenizeOptions | None = None, on_error: str = "raise") -> DataFrame:
        """Adds (surface, start, end), contiguous and total over the text."""
        return self._segmented(df, SPAN, text, out, opts, on_error)

    def wakati(self, df: DataFrame, text: str = "text", out: str = "wakati", opts: TokenizeOptions | None = None) -> DataFrame:
        """Adds the surfaces joined by spaces."""
        return self._joined(df, "surface", " ", text, out, opts)

    def parse(self, df: DataFrame, text: str = "text", out: str = "parse", opts: TokenizeOptions | None = None) -> DataFrame:
        """Adds one line per morpheme: surface, pos, lemma and readings between tabs."""
        return self._joined(df, "line", "\n", text, out, opts)

    def nbest(self, df: DataFrame, k: int, text: str = "text", out: str = "paths", opts: TokenizeOptions | None = None, constraints: str | None = None, on_error: str = "raise") -> DataFrame:
        """Adds the k cheapest paths (rank, cost, morphemes), under the constraint column if given."""
        kind = T.ArrayType(PATH)
        arrow = to_arrow_type(kind)
        return self._map(df, text, out, kind, lambda b, of, o, keep: nbest_rows(b, of, o, k, text, constraints, keep, arrow), opts or TokenizeOptions(), on_error)

    def tokenize_constrained(self, df: DataFrame, constraints: str | Constraints, text: str = "text", out: str = "morphemes", opts: TokenizeOptions | None = None, on_error: str = "raise") -> DataFrame:
        """As ``tokenize`` in the cheapest-path mode, under a constraint column (type CONSTRAINTS) or one set for all."""
        if isinstance(constraints, str):
            return self._segmented(df, MORPHEME, text, out, opts, on_error, constraints)
        return self._segmented(df.withColumn("constraints_", constraint_literal(constraints)), MORPHEME, text, out, opts, on_error, "constraints_").drop("constraints_")

    def classify_locale(self, text: Column) -> Column:
        return classify_locale(text, self._open().language)

    # -- analysis of one text on the driver

    def _scanned(self, text: str | bytes, opts: TokenizeOptions, cons: Constraints = Constraints()) -> str:
        return scan_text(decoded(text), opts, cons)

    def tokenize_text(self, text: str | bytes, opts: TokenizeOptions = TokenizeOptions(), constraints: Constraints | None = None) -> list[Token]:
        return Segmenter(self._open()).segment(self._scanned(text, opts, constraints or Constraints()), opts, constraints)

    def morphemes_text(self, text: str | bytes, opts: TokenizeOptions = TokenizeOptions(), constraints: Constraints | None = None) -> Morphemes:
        """The morphemes of one text as a lazy sequence, which needs the analyser no more."""
        return Morphemes.whole(BatchSegmenter(self._open()), self.tokenize_text(text, opts, constraints))

    def nbest_text(self, text: str | bytes, k: int, opts: TokenizeOptions = TokenizeOptions(), constraints: Constraints = Constraints()) -> list[tuple[int, list[Token]]]:
        return Segmenter(self._open()).nbest(self._scanned(text, opts, constraints), k, opts, constraints)

    # -- the dictionary

    def lexicon(self) -> DataFrame:
        d = self._open()
        rows = list(zip(range(len(d.surface)), d.surface, d.left_id, d.right_id, d.cost, d.pos, d.lemma, d.reading, d.reading_jyutping, d.extra, strict=True))
        return self.spark.createDataFrame(rows, LEXICON)

    def entry_info(self, entry_id: int) -> dict | None:
        """The entry of an id, or None."""
        d = self._open()
        if not 0 <= entry_id < len(d.surface):
            return None
        return {f: getattr(d, f)[entry_id] for f in ("surface", "left_id", "right_id", "cost", "pos", "lemma", "reading", "reading_jyutping")}

    def stats(self) -> Stats:
        return self._open().stats()

    def add_user_entries(self, entries: Iterable[UserEntry]) -> Analyzer:
        """A new analyser with the entries after those of equal surface; an empty surface rejects them all."""
        entries = list(entries)
        d = self._open()
        if any(not e.surface for e in entries):
            raise LoadError("invalid format")
        if not entries:
            return self.clone()
        old = zip(d.surface, d.left_id, d.right_id, d.cost, d.pos, d.lemma, d.reading, d.reading_jyutping, d.extra, strict=True)
        new = [(e.surface, e.left_id, e.right_id, e.cost, e.pos, e.lemma, e.reading, e.reading_jyutping, []) for e in entries]
        more = {k: getattr(d, k) for k in ("ranges", "flags", "rules", "patterns", "matrix", "skipped")}
        return Analyzer(self.spark, CompiledDictionary.of_entries(d.language, [*old, *new], d.mode, **more))

    # -- snapshots

    def save(self, path: str) -> None:
        """Write the compiled dictionary as two Parquet tables: entries, and one row of everything else."""
        image = _manifest(self._open())
        try:
            self.lexicon().write.mode("overwrite").parquet(f"{path}/entries")
            self.spark.createDataFrame([image], "manifest string, matrix binary").write.mode("overwrite").parquet(f"{path}/manifest")
        except Exception as e:
            raise SaveError("write failed") from e

    @classmethod
    def load_snapshot(cls, spark: SparkSession, path: str) -> Analyzer:
        try:
            image = spark.read.parquet(f"{path}/manifest").first()
            table = spark.read.parquet(f"{path}/entries").orderBy("entry_id").toArrow()
        except Exception as e:
            raise LoadError("file not found") from e
        return cls(spark, _restored(table, image.manifest, bytes(image.matrix)))

    def snapshot(self) -> bytes:
        """The compiled dictionary as one Arrow file; equal dictionaries give equal bytes."""
        d = self._open()
        manifest, matrix = _manifest(d)
        names = LEXICON.fieldNames()
        columns = [range(len(d.surface)), d.surface, d.left_id, d.right_id, d.cost, d.pos, d.lemma, d.reading, d.reading_jyutping, d.extra]
        schema = pa.schema([(n, to_arrow_type(LEXICON[n].dataType)) for n in names], metadata={b"manifest": manifest.encode(), b"matrix": matrix})
        sink = io.BytesIO()
        with pa.ipc.new_file(sink, schema) as out:
            out.write_table(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return sink.getvalue()

    @classmethod
    def restore(cls, spark: SparkSession, data: bytes) -> Analyzer:
        try:
            table = pa.ipc.open_file(pa.BufferReader(data)).read_all()
            manifest, matrix = table.schema.metadata[b"manifest"].decode(), table.schema.metadata[b"matrix"]
        except Exception as e:
            raise LoadError("invalid format") from e
        return cls(spark, _restored(table, manifest, matrix))


def constraint_literal(cons: Constraints) -> Column:
    from tessera.types import CONSTRAINTS

    token = lambda t: F.struct(F.lit(t.start).alias("start"), F.lit(t.end).alias("end"), F.lit(t.pos).alias("pos"))
    bound = lambda b: F.struct(F.lit(b.at).alias("at"), F.lit(b.must_exist).alias("must_exist"))
    parts = [F.array(*map(token, cons.tokens)).cast(CONSTRAINTS["tokens"].dataType), F.array(*map(bound, cons.boundaries)).cast(CONSTRAINTS["boundaries"].dataType)]
    return F.struct(parts[0].alias("tokens"), parts[1].alias("boundaries"))


def _matrix_or_none(text: str | None) -> rs.Matrix | None:
    m = rs.matrix(text) if text is not None else None
    return m if m is not None and m.costs.size else None


def _donor(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Cantonese dictionary; unlike other resources it must be there and well-formed."""
    text = rs.read_text(spark, path)
    first = next((line for _, line in lx.records(text)), "")
    if first and lx.detect_schema(Language.CHINESE_HK, first)[0] is not lx.Schema.MECAB_JIEBA_HK:
        raise LoadError("invalid format")
    rows = lx.parse_text(Language.CHINESE_HK, text) if first else []
    return spark.createDataFrame(rows, lx.ROW)


def _manifest(d: CompiledDictionary) -> tuple[str, bytes]:
    plain = {
        "version": SNAPSHOT_VERSION,
        "language": d.language,
        "mode": d.mode,
        "ranges": d.ranges,
        "flags": [(c, f.invoke, f.group, f.length) for c, f in sorted(d.flags.items())],
        "rules": [(r.char_class, r.left_id, r.right_id, r.cost, r.pos) for r in d.rules],
        "patterns": [(p.kind, p.key, p.left_id, p.right_id, p.cost, p.pos) for p in d.patterns],
        "matrix": [*d.matrix.costs.shape, d.matrix.explicit] if d.matrix else None,
        "skipped": d.skipped,
        "hash": d.fingerprint,
    }
    return json.dumps(plain, ensure_ascii=False), d.matrix.costs.astype("<i2").tobytes() if d.matrix else b""


def _restored(table: pa.Table, manifest: str, matrix: bytes) -> CompiledDictionary:
    """A dictionary from its tables, after a check of all that later code relies on."""
    try:
        m = json.loads(manifest)
        columns = {n: table.column(n).to_pylist() for n in LEXICON.fieldNames()}
        ranges = [(lo, hi, CharClass(c)) for lo, hi, c in m["ranges"]]
        costs = None
        if m["matrix"]:
            rows, cols, explicit = m["matrix"]
            costs = rs.Matrix(np.frombuffer(matrix, "<i2").reshape(rows, cols).astype(np.int16), explicit)
            if rows < 1 or cols < 1 or not 0 <= explicit <= rows * cols:
                raise ValueError("matrix")
        d = CompiledDictionary(
            Language(m["language"]), Mode(m["mode"]), *[columns[n] for n in LEXICON.fieldNames()[1:]], ranges,
            {CharClass(c): rs.CharFlags(bool(i), bool(g), n) for c, i, g, n in m["flags"]},
            [rs.UnkRule(CharClass(c), *rest) for c, *rest in m["rules"]],
            [rs.UnkPattern(PatternKind(k), CharClass(key) if k == PatternKind.CHARSET else key, *rest) for k, key, *rest in m["patterns"]],
            costs, list(m["skipped"]),
        )
        sound = (
            m["version"] == SNAPSHOT_VERSION
            and columns["entry_id"] == list(range(len(d.surface)))
            and all(d.surface)
            and d.surface == sorted(d.surface)
            and all(p.key != "" for p in d.patterns)
            and d.classes is not None
            and d.fingerprint == m["hash"]
        )
    except (KeyError, TypeError, ValueError, TesseraError) as e:
        raise LoadError("invalid format") from e
    if not sound:
        raise LoadError("invalid format")
    return d


__all__ = ["Analyzer", "BatchSegmenter", "constraint_literal"]
