"""Op 4, harmonic packing of token documents into sequences of fixed capacity.

A length r falls into class k when capacity/(k+1) < r <= capacity/k; a bin of class k takes exactly k pieces. As
documents may be cut, a remainder that would leave much of its slot empty gives up a full slot of the next class first,
so what stays over falls into ever finer classes. Each worker fills its own bins; nothing is shuffled. What is left in
open bins when a partition ends is laid end to end, so a partition pads one sequence beside the small slack of slots.

Nulls and edge cases: a null text is an empty one, whose document is its end id alone. Rows are packed as they come;
repeated rows are packed each, and lengths that tie in a class fill its bins in the order of rows. Texts of any length
are cut into as many pieces as they need. Only doc_id and text are read, so other columns of whatever name don't matter;
an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import map_arrow, spans_of_bytes, texts_of
from tessera.llm.word_tokens import BATCH_CHARS, END_ID, VOCABULARY, vocabulary_path, with_end, word_tokenizer

CAPACITY = 2048
#: A piece may leave 1/SLACK of its length empty in its slot before it is cut.
SLACK = 24


def harmonic_class(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Piece lengths of a document: full sequences, slots of growing classes, and an end that nearly fills its slot."""
    out, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = harmonic_class(rest, capacity)
        if (capacity // k - rest) * slack <= rest:
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


@dataclass
class Packer:
    """Bins of one worker. ``put`` and ``close`` return finished sequences: lists of (doc, start, ids, doc_tokens)."""

    capacity: int = CAPACITY
    slack: int = SLACK
    open: dict[int, list[tuple]] = field(default_factory=lambda: defaultdict(list))

    def put(self, doc: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        at = 0
        for n in cuts(len(ids), self.capacity, self.slack):
            piece, k = (doc, at, ids[at : at + n], len(ids)), harmonic_class(n, self.capacity)
            at += n
            if k == 1:
                yield [piece]
                continue
            # an open bin outlives the batch that the ids are a view of
            self.open[k].append((doc, piece[1], piece[2].copy(), piece[3]))
            if len(self.open[k]) == k:
                yield self.open.pop(k)

    def close(self) -> Iterator[list[tuple]]:
        """At most one open bin per class is left; its pieces are laid end to end and cut at the capacity."""
        row, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while len(ids):
                    row.append((doc, start, ids[:room], total))
                    start, ids, room = start + len(row[-1][2]), ids[room:], room - len(row[-1][2])
                    if not room:
                        yield row
                        row, room = [], self.capacity
        self.open.clear()
        if row:
            yield row


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): where it came from, its sequence and its offset there.

    ``with_ids`` adds the ids themselves. A sequence id holds the partition in its high bits.
    """
    path = path or vocabulary_path(VOCABULARY)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    kinds = pa.schema([(n.split()[0], pa.int64()) for n in schema.split(", ")[:7]] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = Packer(capacity), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def add(bins: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for pieces in bins:
                offset = 0
                for doc, start, ids, total in pieces:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), total, sequence, offset, *[ids.astype(np.int32)] * with_ids))
                    offset += len(ids)
                sequence += 1

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            rows.clear()
            return out

        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in spans_of_bytes(texts, BATCH_CHARS):
                ids, offsets = with_end(*word_tokenizer(path).encode(texts[a:b]), END_ID)
                for i in range(a, b):
                    add(packer.put(ids_of[i], ids[offsets[i - a] : offsets[i - a + 1]]))
                if rows:
                    yield batch_of()
        add(packer.close())
        if rows:
            yield batch_of()

    return map_arrow(docs.select("doc_id", "text"), kernel, schema)
