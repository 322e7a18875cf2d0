"""Blocks of vectors, and how a stated set of queries meets all of them.

Vectors are packed into blocks. Blocks of candidates are dealt over groups, and query blocks are sent to every group, of
which there are no more than candidates for each query: so the copies of the queries never outweigh the candidates, and
what is shuffled stays in proportion to the input. Queries beyond ``HELD`` bytes are split into slices, each with groups
of its own. A task reads the queries of its group first and then its candidates, block by block, keeping the k best of
each query; no join buffers blocks, no task depends on how vectors are spread in space, and one vector that a third of
the rows share is dealt like any other. Ranking merges k rows for each query and group. Floats travel as such.

Null vectors, empty ones and those with a null or non-finite component take no part, nor do rows without an id. A
vector shorter than another is taken to go on with zeros. A query id that occurs more than once counts once, with the
smallest of its vectors; every row with the query's id is its own and is no candidate. Candidate rows that repeat an id
are ranked each. Equal scores rank by id. Only the id and the vector are read, so other columns of whatever name don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from tessera.llm.common import map_arrow, partitions

#: Rows of a block: the most and the least.
ROWS, FEW_ROWS = 4096, 256
QUERY_ROWS = 512
#: Blocks of candidates are put together to as many rows before they are searched.
ROWS_AT_ONCE = 16_384
#: Bytes of queries that a task holds.
HELD = 64 << 20
BLOCK = "at int, ids binary, width int, data binary"


def usable(df: DataFrame, id: str = "vec_id", vector: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(id, v): the rows that take part, with components in double precision unless they are floats."""
    kind = df.schema[vector].dataType
    v = F.col(vector) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = F.col(id).isNotNull() & (F.size(v) > 0) & ~bad
    if nonzero:
        keep &= F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(keep, F.lit(False))).select(F.col(id).cast("long").alias("id"), v.alias("v"))


def dealt(spark: SparkSession, groups: int) -> list[int]:
    """``groups`` numbers that Spark's hash partitioning deals to as many different partitions."""
    number = F.col("id").cast("int")
    rows = spark.range(32 * groups + 64).groupBy(F.pmod(F.hash(number), F.lit(groups)).alias("place")).agg(F.min(number).alias("g")).collect()
    return sorted(r.g for r in rows)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` rows of (id, v), numbered anew from a number of its own in each partition.

    Vectors of a block are as wide as its widest.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        at, held = 31 * TaskContext.get().partitionId(), 0

        def block() -> pa.RecordBatch:
            nonlocal at, held
            data = padded(parts)
            out = [pa.array([at], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([data.shape[1]], pa.int32()), pa.array([data.tobytes()], pa.binary())]
            at, held = at + 1, 0
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(out, ["at", "ids", "width", "data"])

        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                piece = batch.slice(a, rows)
                lists = piece.column("v")
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                wide = np.zeros((len(size), int(size.max(initial=1))), flat.dtype)
                wide[np.arange(wide.shape[1])[None, :] < size[:, None]] = flat
                if held + len(size) > rows and held:
                    yield block()
                ids.append(piece.column("id").to_numpy())
                parts.append(wide)
                held += len(size)
        if held:
            yield block()

    return map_arrow(df.select("id", "v"), kernel, BLOCK)


def padded(parts: list[np.ndarray]) -> np.ndarray:
    """The rows of all ``parts``, with zeros up to the widest."""
    out = np.zeros((sum(map(len, parts)), max(p.shape[1] for p in parts)), parts[0].dtype)
    row = 0
    for p in parts:
        out[row : row + len(p), : p.shape[1]] = p
        row += len(p)
    return out


class Best:
    """The k best (score, id) that each of some queries has met."""

    def __init__(self, n: int, k: int, score: type, descending: bool):
        self.k, self.descending = k, descending
        self.none = np.array(NEVER if descending else np.inf, score)[()]
        self.score, self.id, self.n = np.full((n, k), self.none), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    @property
    def bound(self) -> np.ndarray:
        """What a candidate has to reach, and pass unless its id is smaller."""
        return self.score[:, -1]

    def merge(self, which: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(which):
            return
        some, place = np.unique(which, return_inverse=True)
        old = np.flatnonzero(np.arange(self.k)[None, :] < self.n[some][:, None])
        row = np.concatenate((old // self.k, place))
        ids, score = np.concatenate((self.id[some].ravel()[old], ids)), np.concatenate((self.score[some].ravel()[old], score))
        order = np.lexsort((ids, -score if self.descending else score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        self.id[some[row], rank], self.score[some[row], rank] = ids[order], score[order]
        self.n[some] = np.bincount(row, minlength=len(some))


Side = tuple[np.ndarray, np.ndarray]
#: Takes a block of candidates and merges what it finds.
Search = Callable[[Side], None]
NEVER = -(1 << 63)


def grid(df: DataFrame, rows: DataFrame, is_query: Column, id: str) -> tuple[int, int, int]:
    """Groups of candidates, slices of queries and rows of a block, by numbers of rows that cost a scan of the ids alone."""
    n, asked = df.select(F.col(id).cast("long").alias("id")).agg(F.count("id"), F.count_if(is_query)).first()
    wide = rows.select(F.size("v").alias("n")).first()
    groups = max(1, min(partitions(df.sparkSession), -(-n // max(asked, 1))))
    slices = max(1, -(-asked * 8 * (wide.n if wide else 1) // HELD))
    return groups, slices, int(min(ROWS, max(FEW_ROWS, n // (4 * groups))))


def search_blocks(df: DataFrame, is_query: Column, search: Callable[[Side, Best], Search], k: int, score_type: str, descending: bool, id: str, vector: str, nonzero: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query (rows where ``is_query``, over the column id).

    ``search`` takes the queries of a group and where to merge, and returns what is called with each block of
    candidates. A side is ids, in ascending order, and vectors.
    """
    rows, kind = usable(df, id, vector, nonzero), np.int64 if score_type == "long" else np.float64
    single = isinstance(rows.schema["v"].dataType.elementType, FloatType)
    a, b, size = grid(df, rows, is_query, id)
    groups = dealt(df.sparkSession, a * b)
    of_rows = F.element_at(F.array(*[F.array(*[F.lit(g) for g in groups[i * b : i * b + b]]) for i in range(a)]), F.pmod("at", F.lit(a)) + 1)
    of_queries = F.element_at(F.array(*[F.array(*[F.lit(g) for g in groups[i::b]]) for i in range(b)]), F.pmod("at", F.lit(b)) + 1)
    queries = packed(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")), QUERY_ROWS)
    sides = [x.select(F.explode(g).alias("g"), F.lit(role).alias("role"), "ids", "width", "data") for x, g, role in ((queries, of_queries, 0), (packed(rows, size), of_rows, 1))]
    ordered = sides[0].union(sides[1]).repartition(a * b, "g").sortWithinPartitions("g", "role")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, q_ids, best, go = None, None, None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def side() -> Side:
            ids, v = np.concatenate([x for x, _ in held]), padded([x for _, x in held])
            held.clear()
            order = np.argsort(ids, kind="stable")
            return ids[order], v[order]

        def found() -> Iterator[pa.RecordBatch]:
            if held and go:
                go(side())
            if best:
                q, place = np.nonzero(np.arange(k)[None, :] < best.n[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(best.id[q, place]), pa.array(best.score[q, place])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["g"] != group:
                    yield from found()
                    group, q_ids, best, go = row["g"], None, None, None
                    held.clear()
                if row["role"] and go is None and held:
                    q_ids, q = side()
                    best = Best(len(q_ids), k, kind, descending)
                    go = search((q_ids, q), best)
                if row["role"] and go is None:
                    continue  # no queries
                held.append((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.float32 if single else np.float64).reshape(-1, row["width"])))
                if go and sum(len(x) for x, _ in held) >= ROWS_AT_ONCE:
                    go(side())
        yield from found()

    pairs = map_arrow(ordered, kernel, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score") if descending else F.asc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def widened(v: np.ndarray, width: int) -> np.ndarray:
    return np.hstack((v, np.zeros((len(v), width - v.shape[1]), v.dtype))) if v.shape[1] < width else v


def own_rows(q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query index, candidate index) of all rows that have a query's id; candidate ids ascend."""
    low, high = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
    n = high - low
    return np.repeat(np.arange(len(q_ids)), n), np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if a < b] or [np.zeros(0, np.int64)]).astype(np.int64)
