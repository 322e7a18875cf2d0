"""Op 9, token files: directly addressable codes with random access to any token.

Ids are split into 8-bit chunks. Level 0 holds the low chunk of every id; a bitmap says which ids go on in level 1, and
a rank directory (ids that go on before each 512 bits) finds their place there, and so on. One token costs one lookup
per level, and a range of tokens is one range in each level, so nothing else is decoded.

An image holds the documents of one segment. Images are rows of a Parquet table in the shared folder, written by
Spark's committer: a task that is lost or run twice leaves no half file. Rows carry the range partition and the tokens
before the segment there; what lies before a partition is one sum for each partition.

Nulls and edge cases: a null text is an empty one. Rows are ordered by (doc_id, hash of the text), nulls first, so
repeated ids stay apart and get consecutive ranges; rows that repeat wholly are written each. A document of any length is
one range, in a segment of its own size. Only doc_id and text are read, so other columns of whatever name don't matter;
an empty table gives empty files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, partitions, spans_of_bytes, stored, texts_of
from tessera.llm.word_tokens import BATCH_CHARS, END_ID, VOCABULARY, vocabulary_path, with_end, word_tokenizer

MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIQQ")  # magic, levels, documents, tokens
LEVEL = struct.Struct("<QQQ")  # bytes of chunks, of the bitmap and of the rank directory
STEP = 512
#: A segment ends with the document that reaches this many tokens.
SEGMENT_TOKENS = 1 << 17


def image_of(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The image of a segment: ``ids`` in order, ``starts`` of its documents and the end of the last."""
    levels, rest = [], ids.astype(np.uint64)
    while not levels or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
        levels.append((rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()))
        rest = rest[more] >> np.uint64(8)
    out = [HEAD.pack(MAGIC, len(levels), len(starts) - 1, len(ids)), starts.astype("<u8").tobytes()]
    out += [LEVEL.pack(*map(len, level)) for level in levels]
    return b"".join([*out, *(part for level in levels for part in level)])


class Image:
    """Random access to an image. Raises ValueError on bytes that are none."""

    def __init__(self, data: bytes | memoryview):
        if len(data) < HEAD.size:
            raise ValueError("no token image")
        magic, n_levels, self.n_docs, self.n_tokens = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token image")
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, HEAD.size).astype(np.int64)
        at = HEAD.size + 8 * (self.n_docs + 1)
        sizes = [LEVEL.unpack_from(data, at + i * LEVEL.size) for i in range(n_levels)]
        at += n_levels * LEVEL.size
        self.levels = []
        for chunks, bits, ranks in sizes:
            self.levels.append((np.frombuffer(data, np.uint8, chunks, at), np.frombuffer(data, np.uint8, bits, at + chunks), np.frombuffer(data, "<u8", ranks // 8, at + chunks + bits)))
            at += chunks + bits + ranks
        if at != len(data):
            raise ValueError("token image of the wrong size")

    def _rank(self, level: int, i: int) -> int:
        """How many of the first ``i`` entries of a level go on."""
        chunks, bits, ranks = self.levels[level]
        if i >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        base = i // STEP
        whole, odd = bits[base * STEP // 8 : i // 8], i % 8
        n = int(ranks[base]) + int(np.bitwise_count(whole).sum())
        return n + (int(bits[i // 8]) & ((1 << odd) - 1)).bit_count() if odd else n

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def tokens(self, i: int, j: int) -> np.ndarray:
        """Ids of the range [i, j): one range of each level."""
        ranges = []
        for level, (chunks, bits, _) in enumerate(self.levels):
            if i >= j:
                break
            more = np.unpackbits(bits[i // 8 : (j + 7) // 8], bitorder="little")[i % 8 : i % 8 + j - i].astype(bool)
            ranges.append((chunks[i:j], more))
            i, j = self._rank(level, i), self._rank(level, j)
        out = np.zeros(0, np.uint32)
        for chunks, more in reversed(ranges):
            value = chunks.astype(np.uint32)
            value[more] |= out << np.uint32(8)
            out = value
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


SEGMENTS = "part int, before long, n_tokens long, doc_ids array<long>, image binary"


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) in ascending order of doc_id into a stored table of segments, and returns it.

    A segment has its range partition, the tokens before it there, its documents' ids and its image.
    """
    path = path or vocabulary_path(VOCABULARY)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, open_ids, open_docs = TaskContext.get().partitionId(), 0, [], []

        def segment() -> pa.RecordBatch:
            nonlocal before
            starts = np.concatenate(([0], np.cumsum([len(x) for x in open_ids])))
            image = image_of(np.concatenate(open_ids), starts)
            row = [pa.array([part], pa.int32()), pa.array([before]), pa.array([int(starts[-1])]), pa.array([open_docs], pa.list_(pa.int64())), pa.array([image], pa.binary())]
            before += int(starts[-1])
            open_ids.clear()
            open_docs.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "before", "n_tokens", "doc_ids", "image"])

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in spans_of_bytes(texts, BATCH_CHARS):
                ids, offsets = with_end(*word_tokenizer(path).encode(texts[a:b]), end_id)
                size = 0
                for i in range(a, b):
                    open_ids.append(ids[offsets[i - a] : offsets[i - a + 1]])
                    open_docs.append(names[i])
                    size = size + len(open_ids[-1])
                    if size >= SEGMENT_TOKENS:
                        yield segment()
                        size = 0
                if open_ids:
                    yield segment()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return stored(map_arrow(ordered.select("doc_id", "text"), kernel, SEGMENTS), "tokens")


def with_bases(segments: DataFrame) -> DataFrame:
    """Adds ``base``: the tokens before each segment in all files. The driver sees one number for each range partition."""
    totals = sorted(segments.groupBy("part").agg(F.sum("n_tokens")).collect())
    rows, total = [], 0
    for part, n in totals:
        rows.append((part, total))
        total += n
    bases = segments.sparkSession.createDataFrame(rows, "part int, part_base long")
    return segments.join(F.broadcast(bases), "part").withColumn("base", F.col("part_base") + F.col("before"))


def read_tokens(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, names, data in zip(batch.column("base").to_pylist(), batch.column("doc_ids"), batch.column("image"), strict=True):
                image = Image(data.as_buffer())
                ids = [image.document(k) for k in range(image.n_docs)]
                columns = [names.values, pa.array(image.starts[:-1] + base), pa.array(np.diff(image.starts)), pa.array([zlib.crc32(x.astype("<u4", copy=False)) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([(n, c.type) for n, c in zip(["doc_id", "start", "n_tokens", "ids_crc32", "ids"], columns, strict=False)]))

    return map_arrow(with_bases(segments).select("base", "doc_ids", "image"), kernel, schema)
