"""Op 8, byte-level BPE: encoding by merges over length-bucketed padded matrices, and decoding.

The distinct pieces of a batch are padded into matrices of similar width. Each round looks the pairs up in a hash
table, merges in every row the leftmost pair of least rank, drops one column, and takes finished rows out.

Nulls and edge cases: a null text is encoded as an empty one, which has no ids and decodes to nothing; null ids decode
to null. Texts of any length are encoded whole. A piece of more than ``WIDEST`` bytes would take time in the square of
its length in a matrix, so a heap does the same merges. Of pairs of equal rank the leftmost is merged first. Every row
is handled alone, so repeated rows get equal results, and an empty table an empty one. Columns named like an added one
are replaced; others stay.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_arrow, spans_of_bytes, texts_of
from tessera.llm.pretokens import OTHER, SPACE, PieceCache, class_table, code_points, contractions, ids_of_pieces, mixed, per_text, runs, taken
from tessera.llm.word_tokens import vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BATCH_CHARS = 1_000_000
#: Pieces of more bytes merge through a heap, as a matrix of that width would take time in the square of it.
WIDEST = 256
NEVER = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)


class PairTable:
    """Rank of the token that two tokens make together, by open addressing over 64-bit pair keys."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64(2**bits - 1)
        self.keys, self.ranks = np.full(2**bits, EMPTY), np.full(2**bits, NEVER)
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks, at = np.fromiter(pairs.values(), np.int32, len(pairs)), self.home(keys)
        while len(keys):
            place, first = np.unique(at, return_index=True)
            first = first[self.keys[place] == EMPTY]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        out, at, rest = np.full(len(keys), NEVER), self.home(keys), np.arange(len(keys))
        while len(rest):
            found = self.keys[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[at[hit]]
            more = ~hit & (found != EMPTY)
            rest, at = rest[more], (at[more] + 1) & self.mask
        return out.reshape(shape)


class ByteBpe:
    def __init__(self, path: str, cache: int = 700_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if min(ranks.values()) < 0 or max(ranks.values()) > 0xFFFF or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary needs all single bytes and ranks of 16 bits")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs, self.pair_of = PairTable(pairs), pairs
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.size[r] = len(t)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.zeros(int(self.size.sum()), np.uint8)
        for t, r in ranks.items():
            self.flat[self.at[r] : self.at[r] + len(t)] = np.frombuffer(t, np.uint8)
        self.whole, self.kinds, self.cache = ranks, class_table(), PieceCache(cache)
        self.codes = mixed(np.arange(len(self.kinds)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (unsigned 32 bit), and the offsets of the texts in them."""
        ids, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for a, b in spans_of_bytes(texts, BATCH_CHARS):
            part, offsets = self._batch(texts[a:b])
            ids.append(part)
            ends.append(offsets[1:] + ends[-1][-1])
        return np.concatenate(ids), np.concatenate(ends)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts one after another, and the offsets of the texts in them."""
        size = self.size[ids]
        return taken(self.flat, self.at[ids], size), np.concatenate(([0], np.cumsum(size)))[offsets]

    def pieces(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches of the vocabulary's pattern as code-point ranges."""
        kinds = self.kinds[points]
        start, end = runs(kinds, starts)
        if not len(start):
            return start, end
        kind = kinds[start]
        text_end = starts[np.searchsorted(starts, start, side="right")]
        blank = kind == SPACE
        inner = blank & (end < text_end)  # white space with something after it: its last code point stands alone or leads
        leads = inner & (points[end - 1] == 0x20)
        led = np.concatenate(([False], leads[:-1]))
        take = contractions(points, kinds, start, end, text_end, (kind == OTHER) & ~led)
        late = np.concatenate(([0], take[:-1]))
        extra = np.flatnonzero(inner & ~leads & (end - start > 1))
        s = np.concatenate((start + late - led, end[extra] - 1))
        e = np.concatenate((end + take - (leads | inner & (end - start > 1)), end[extra]))
        keep = s < e
        order = np.argsort(s[keep], kind="stable")
        return s[keep][order], e[keep][order]

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, starts = code_points(texts)
        start, end = self.pieces(points, starts)
        flat = "".join(texts)

        def fresh(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self.merge([flat[i:j].encode("utf-8", "replace") for i, j in zip(s.tolist(), e.tolist(), strict=True)])

        ids, counts = ids_of_pieces(self.cache, self.codes, points, start, end, fresh)
        return ids.astype(np.uint32), per_text(counts, start, starts)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128, WIDEST):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                self._merge_bucket([pieces[i] for i in rows], rows, high, done)
            low = high
        for i in np.flatnonzero(size > WIDEST):
            done[i] = np.array(self._merge_long(pieces[i]), np.int64)
        return np.concatenate(done) if done else np.zeros(0, np.int64), np.array([len(x) for x in done], np.int64)

    def _merge_bucket(self, pieces: list[bytes], rows: np.ndarray, width: int, done: list[np.ndarray]) -> None:
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.single[raw]
        whole = np.array([self.whole.get(p, -1) for p in pieces])  # a piece that is a token is that token
        ids[whole >= 0, 0], length[whole >= 0] = whole[whole >= 0], 1
        ranks = self.pairs(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(ids), 0), NEVER)
        ranks[np.arange(1, width)[None, :] >= length[:, None]] = NEVER
        while True:
            least = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            rank = ranks[np.arange(len(ids)), least] if ranks.shape[1] else np.full(len(ids), NEVER)
            still = rank != NEVER
            for i in np.flatnonzero(~still):
                done[rows[i]] = ids[i, : length[i]].copy()
            if not still.any():
                return
            ids, ranks, least, rank, rows, length = ids[still], ranks[still], least[still], rank[still], rows[still], length[still] - 1
            n, line = ids.shape[1] - 1, np.arange(len(ids))
            ids[line, least] = rank
            columns = np.arange(n)[None, :]
            ids = np.take_along_axis(ids, columns + (columns > least[:, None]), 1)
            if n < 2:
                ranks = np.full((len(ids), 0), NEVER)
                continue
            columns = columns[:, :-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= least[:, None]), 1)
            for at in (least - 1, least):
                ok = np.flatnonzero((at >= 0) & (at + 1 < length))
                ranks[ok, at[ok]] = self.pairs(ids[ok, at[ok]], ids[ok, at[ok] + 1])
            last = np.flatnonzero(least < n - 1)
            last = last[least[last] + 1 >= length[last]]
            ranks[last, least[last]] = NEVER

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, position) over a linked list."""
        if piece in self.whole:
            return [self.whole[piece]]
        ids: list[int] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self.pair_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.pair_of.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (x := self.pair_of.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (x, k))
        return [x for x in ids if x >= 0]


@functools.lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder, with its cache, for each Python worker."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds ``ids`` (array<int>, unless ``with_ids`` is false), ``n_tokens``, ``decoded`` digests and id digests to each row.

    A null text is encoded as an empty one; every row keeps its other columns but those of the same names.
    """
    path = path or vocabulary_path(VOCABULARY)
    fields = [f for f in docs.schema if f.name not in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    docs = docs.select(*[f"`{f.name}`" for f in fields])
    keep = [f.name for f in fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != text] + ["ids array<int>"] * with_ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            all_texts = texts_of(batch, text)
            for a, b in spans_of_bytes(all_texts, BATCH_CHARS):
                ids, offsets = bpe.encode(all_texts[a:b])
                out, ends = bpe.decode(ids, offsets)
                raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(out.tobytes())
                columns = [batch.column(k).slice(a, b - a) for k in keep]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                columns += [
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]),
                    pa.array([hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs, kernel, schema)


def decode_documents(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) from an id array column; null ids give null."""
    path = path or vocabulary_path(VOCABULARY)
    keep = [f for f in df.schema if f.name != "decoded"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["decoded binary"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            out = [None if x is None else taken(bpe.flat, bpe.at[x], bpe.size[x]).tobytes() if x else b"" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(out, pa.binary())], [*(f.name for f in keep), "decoded"])

    return map_arrow(df.select(*[f"`{f.name}`" for f in keep]), kernel, schema)
