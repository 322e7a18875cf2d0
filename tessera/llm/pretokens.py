"""Vectorised pre-tokenisation: pieces of a batch of texts as code-point ranges with a 64-bit hash each.

Both tokenizers split on the same classes (white space, letters, numbers, others) and on English contractions; they
differ in what white space does. A batch is handled as one array, and only pieces that a worker has not met before
reach a tokenizer.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def class_table(size: int = 0x110000) -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(size)), np.uint8, size)
    out[[c for c in WHITE_SPACE if c < size]] = SPACE
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, the same wherever the range lies; values are scrambled words."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the batch, and where each text starts (with the end of the last)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))


def runs(kinds: np.ndarray, starts: np.ndarray, single: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one class within one text; a run of class ``single`` is one code point."""
    n = len(kinds)
    edge = np.empty(n, bool)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    edge[starts[:-1][starts[:-1] < n]] = True
    if single is not None:
        edge |= kinds == single
    start = np.flatnonzero(edge)
    return start, np.append(start[1:], n)


def contractions(points: np.ndarray, kinds: np.ndarray, start: np.ndarray, end: np.ndarray, text_end: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Letters that each run, if it is a lone apostrophe at the start of a match (``free``), takes from the run after it.

    'd 'm 's 't take one letter, 'll 're 've two.
    """
    take = np.zeros(len(start), np.int64)
    at = np.flatnonzero(free & (end - start == 1) & (points[np.minimum(start, len(points) - 1)] == 0x27) & (end < text_end))
    if len(at):
        one = points[end[at]]
        two = np.where(end[at] + 1 < text_end[at], points[np.minimum(end[at] + 1, len(points) - 1)], 0)
        take[at[np.isin(one, [0x64, 0x6D, 0x73, 0x74])]] = 1
        take[at[(one == 0x6C) & (two == 0x6C) | np.isin(one, [0x72, 0x76]) & (two == 0x65)]] = 2
    return take


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, an index at which each occurs, and the place among them of every key."""
    codes, found = pd.factorize(keys)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    at = np.empty(len(found), np.int64)
    at[codes] = np.arange(len(codes))
    return found[order], at[order], rank[codes]


class PieceCache:
    """Token ids of pieces already met, by hash, in flat sorted arrays; emptied when it holds ``limit`` pieces.

    The code points of a piece are kept with it, and a piece is found only if they are the same.
    """

    def __init__(self, limit: int = 700_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size, self.from_, self.length = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.points = np.zeros(0, np.uint16), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and whether its piece ``points[start:start+length]`` is there; keys ascend.

        If another piece with the same hash is there, the cache is emptied.
        """
        slot = np.searchsorted(self.keys, keys)
        slot[slot == len(self.keys)] = 0
        if not len(self.keys):
            return slot, np.zeros(len(keys), bool)
        there = self.keys[slot] == keys
        old, start, length = slot[there], start[there], length[there]
        if not (np.array_equal(self.length[old], length) and np.array_equal(taken(self.points, self.from_[old], length), taken(points, start, length))):
            self.clear()
            there[:] = False
        return slot, there

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        places = lambda n, after: np.concatenate(([0], np.cumsum(n)[:-1])) + after if len(n) else np.zeros(0, np.int64)
        at, from_ = places(size, len(self.ids)), places(length, len(self.points))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at, self.size = np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
        self.from_, self.length = np.concatenate((self.from_, from_))[order], np.concatenate((self.length, length))[order]
        self.ids, self.points = np.concatenate((self.ids, ids.astype(np.uint16))), np.concatenate((self.points, taken(points, start, length)))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slots one after another, and how many each has."""
        return taken(self.ids, self.at[slots], self.size[slots]), self.size[slots]


#: Makes the ids of pieces, given as starts and ends: all ids one after another, and how many each piece has.
Fresh = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def ids_of_pieces(cache: PieceCache, codes: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray, fresh: Fresh) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces ``points[start:end]`` one after another, and how many each has; ``fresh`` makes unknown ones.

    Pieces are numbered by hash, and every one is compared with the one that stands for its hash; should two differ,
    the batch is numbered by its texts and does without the cache.
    """
    keys, first, inverse = distinct(range_hashes(codes[points], start, end))
    length = end - start
    same = first[inverse]
    if not (np.array_equal(length, length[same]) and np.array_equal(taken(points, start, length), taken(points, start[same], length))):
        number, found = pd.factorize(np.array([points[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist(), strict=True)], object))
        first = np.empty(len(found), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        ids, size = fresh(start[first], end[first])
        return taken(ids, (np.cumsum(size) - size)[number], size[number]), size[number]
    start, length = start[first], length[first]
    slot, there = cache.find(keys, points, start, length)
    if not there.all():
        if len(cache.keys) + (~there).sum() > cache.limit:
            cache.clear()
            there[:] = False
        new = np.flatnonzero(~there)
        cache.add(keys[new], *fresh(start[new], start[new] + length[new]), points, start[new], length[new])
        slot = np.searchsorted(cache.keys, keys)
    return cache.gather(slot[inverse])


def taken(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges ``flat[at:at+size]`` one after another."""
    ends = np.cumsum(size)
    if not len(size) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]


def per_text(counts: np.ndarray, piece_start: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets of each text in the ids, from the ids of each piece and where pieces and texts start."""
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    return total[np.searchsorted(piece_start, starts)]
