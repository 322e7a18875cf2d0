"""Segmentation of one text: candidates, cheapest path, n cheapest paths, longest match. Pure functions, no Spark.

Positions are characters here; byte offsets are computed when results are emitted. A text of malformed bytes holds a
lone surrogate for each of them, one byte wide, which dictionary entries match as U+FFFD.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from typing import NamedTuple

import numpy as np

from tessera.operators.compiled import CompiledDictionary
from tessera.operators.constraints import allowed, validate
from tessera.types import DEFAULT_EDGE, NONE, CancelledError, CharClass, ConstraintError, ConstraintReason, Constraints, MalformedInputError, Mode, TokenizeOptions, UnsatisfiableError

NO_CONSTRAINTS = Constraints()


class Token(NamedTuple):
    """A morpheme without its place: ``entry_id`` -1 is an unknown one."""

    surface: str
    pos: str
    lemma: str
    reading: str
    reading_jyutping: str
    entry_id: int
    cost: int
    char_class: CharClass


class Node(NamedTuple):
    """A candidate over the characters [start, end). The two ends of a lattice have entry_id None."""

    start: int
    end: int
    entry_id: int | None
    char_class: CharClass
    pos: str
    left_id: int
    right_id: int
    cost: int


def byte_offsets(text: str) -> list[int]:
    """Byte offset of each character, and of the end."""
    if text.isascii():
        return list(range(len(text) + 1))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    return [0, *np.cumsum(width).tolist()]


def first_malformed(text: str) -> int | None:
    """Index of the first character that stands for a malformed byte."""
    if text.isascii():
        return None
    return next((i for i, c in enumerate(text) if "\udc80" <= c <= "\udcff"), None)


def matchable(text: str) -> str:
    return text if first_malformed(text) is None else "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text)


def compose(text: str) -> str:
    """Canonical composition; a text with malformed bytes stays as it is."""
    return text if first_malformed(text) is not None else unicodedata.normalize("NFC", text)


def rune_starts(text: str, at: list[int]) -> set[int]:
    """The byte offsets at which a character may start, by the top bits of its first byte, and the end of the text."""
    if first_malformed(text) is None:
        return set(at)
    return {b for b, c in zip(at, text, strict=False) if not "\udc80" <= c <= "\udcbf"} | {at[-1]}


def scan_text(text: str, opts: TokenizeOptions, cons: Constraints = NO_CONSTRAINTS) -> str:
    """The text to analyse, after the checks that come before: well-formedness, constraints, composition."""
    if opts.strict_utf8 and (bad := first_malformed(text)) is not None:
        raise MalformedInputError(byte_offsets(text)[bad])
    if cons.active:
        at = byte_offsets(text)
        validate(cons, rune_starts(text, at), at[-1])
    if opts.normalize_nfc and (composed := compose(text)) != text:
        if cons.active:
            raise ConstraintError(ConstraintReason.NORMALIZATION_RESCALED, -1, -1, -1)
        return composed
    return text


def spent(opts: TokenizeOptions) -> bool:
    return opts.cancel_token is not None and opts.cancel_token.cancelled


@dataclass(frozen=True)
class Lattice:
    text: str
    nodes: list[Node]

    def boundary_bytes(self) -> list[int]:
        return byte_offsets(self.text)


class Segmenter:
    """The operators of one dictionary."""

    def __init__(self, dictionary: CompiledDictionary):
        self.d = dictionary

    # -- candidates

    def matches(self, text: str, at: int) -> list[int]:
        """Entries that are prefixes of ``text[at:]``: shorter surfaces first, of one surface the highest id first."""
        groups, out = self.d.groups, []
        for n in self.d.lengths.get(text[at], ()):
            ids = groups.get(text[at : at + n])
            if ids is not None and at + n <= len(text):
                out += reversed(ids)
        return out

    def unknown(self, text: str, start: int, end: int, cls: CharClass) -> Node:
        pos, cost, left, right = self.d.resolve(cls, text, start, end)
        return Node(start, end, -1, cls, pos, left, right, cost)

    def run_ends(self, classes: list[CharClass]) -> list[int]:
        """For each position, where its run of one class ends."""
        ends = [0] * len(classes)
        for i in range(len(classes) - 1, -1, -1):
            ends[i] = ends[i + 1] if i + 1 < len(classes) and classes[i + 1] is classes[i] else i + 1
        return ends

    def lattice(self, text: str, cons: Constraints = NO_CONSTRAINTS, opts: TokenizeOptions = TokenizeOptions()) -> Lattice:
        """All candidates by start: words, then unknown ones (the run, then its prefixes from the shortest)."""
        d, found, edge = self.d, matchable(text), Node(0, 0, None, CharClass.UNKNOWN, "", 0, 0, 0)
        classes = [d.classes.of(c) for c in text]
        ends, nodes = self.run_ends(classes), [edge]
        for at, cls in enumerate(classes):
            if spent(opts):
                raise CancelledError(byte_offsets(text)[at])
            words = self.matches(found, at)
            for i in words:
                nodes.append(Node(at, at + len(d.surface[i]), i, cls, d.pos[i], d.left_id[i], d.right_id[i], d.cost[i]))
            flags = d.flags_of(cls)
            if words and not flags.invoke:
                continue
            stops = [ends[at]] if flags.group else []
            stops += [e for e in range(at + 1, min(at + flags.length, ends[at]) + 1) if e not in stops]
            nodes += [self.unknown(text, at, e, cls) for e in stops or [at + 1]]
        nodes.append(edge._replace(start=len(text), end=len(text)))
        if cons.active:
            at = byte_offsets(text)
            nodes = [n for n in nodes if n.entry_id is None or allowed(cons, at[n.start], at[n.end], n.pos)]
        return Lattice(text, nodes)

    # -- costs

    def edge(self, right_id: int, left_id: int) -> int:
        return self.d.matrix.cost(right_id, left_id) if self.d.matrix else DEFAULT_EDGE

    @staticmethod
    def own_cost(n: Node, opts: TokenizeOptions) -> int:
        """What a node adds to a path beside its edge."""
        return n.cost + (opts.unk_cost_bias + opts.unk_cost_per_rune * (n.end - n.start) if n.entry_id == -1 else 0)

    def best_path(self, lattice: Lattice, opts: TokenizeOptions = TokenizeOptions()) -> tuple[int, list[Node]]:
        """Cost and nodes of the cheapest path; of equally cheap predecessors the first in the lattice stays."""
        nodes, size = lattice.nodes, len(lattice.text)
        arriving: list[list[int]] = [[] for _ in range(size + 1)]
        arriving[0].append(0)
        total: list[int] = [0] * len(nodes)
        back: list[int] = [-1] * len(nodes)
        plain, memo, memo_at = self.d.matrix is None, {}, -1
        for j in range(1, len(nodes)):
            n = nodes[j]
            if n.start != memo_at:
                memo, memo_at = {}, n.start
            key = 0 if plain else n.left_id
            if key not in memo:
                memo[key] = min(((total[i] + (DEFAULT_EDGE if plain else self.edge(nodes[i].right_id, n.left_id)), i) for i in arriving[n.start]), default=None)
            if memo[key] is None:
                continue
            cost, back[j] = memo[key]
            total[j] = cost + self.own_cost(n, opts)
            if n.entry_id is not None:
                arriving[n.end].append(j)
        if back[-1] < 0:
            bytes_at = lattice.boundary_bytes()
            raise UnsatisfiableError(next((bytes_at[q] for q in range(1, size + 1) if not arriving[q]), bytes_at[size]))
        path, j = [], back[-1]
        while j > 0:
            path.append(nodes[j])
            j = back[j]
        return total[-1], path[::-1]

    def paths(self, lattice: Lattice, opts: TokenizeOptions = TokenizeOptions()) -> Iterator[tuple[int, list[Node]]]:
        """All paths from the cheapest on: A* with the exact rest of each node as estimate, ties in order of insertion."""
        nodes, size = lattice.nodes, len(lattice.text)
        leaving: list[list[int]] = [[] for _ in range(size + 1)]
        for j, n in enumerate(nodes):
            if j:
                leaving[n.start].append(j)
        steps: list[list[tuple[int, int]]] = [[] for _ in nodes]
        rest: list[int | None] = [None] * len(nodes)
        last = len(nodes) - 1
        rest[last] = 0
        for i in range(last - 1, -1, -1):
            for j in leaving[nodes[i].end]:
                if j != i and rest[j] is not None:
                    step = self.edge(nodes[i].right_id, nodes[j].left_id) + self.own_cost(nodes[j], opts)
                    steps[i].append((j, step))
                    if rest[i] is None or step + rest[j] < rest[i]:
                        rest[i] = step + rest[j]
        if rest[0] is None:
            bytes_at, open_ = lattice.boundary_bytes(), {n.end for n, r in zip(nodes, rest, strict=True) if r is not None}
            raise UnsatisfiableError(max((bytes_at[q] for q in range(1, size + 1) if q not in open_), default=0))
        order = count()
        heap: list[tuple[int, int, int, int, tuple | None]] = [(rest[0], next(order), 0, 0, None)]
        while heap:
            _, _, node, cost, path = heapq.heappop(heap)
            if spent(opts):
                raise CancelledError(lattice.boundary_bytes()[nodes[node].start])
            if node == last:
                out = []
                while path is not None:
                    out.append(nodes[path[0]])
                    path = path[1]
                yield cost, out[::-1]
                continue
            grown = (node, path) if node else None
            for j, step in steps[node]:
                heapq.heappush(heap, (cost + step + rest[j], next(order), j, cost + step, grown))

    # -- longest match

    def longest(self, text: str, at: int) -> tuple[int, int] | None:
        """(entry, end) of the longest word at a position; of one surface the cheapest entry, then the lowest id."""
        groups, cost = self.d.groups, self.d.cost
        for n in reversed(self.d.lengths.get(text[at], ())):
            ids = groups.get(text[at : at + n])
            if ids is not None:
                return min(ids, key=lambda i: (cost[i], i)), at + n
        return None

    def greedy(self, text: str) -> list[Node]:
        """Longest matches without going back; where there is none, the whole run of one class is unknown."""
        d, found, at, out = self.d, matchable(text), 0, []
        classes = [d.classes.of(c) for c in text]
        ends = self.run_ends(classes)
        while at < len(text):
            hit = self.longest(found, at)
            if hit:
                i, end = hit
                out.append(Node(at, end, i, classes[at], d.pos[i], d.left_id[i], d.right_id[i], d.cost[i]))
            else:
                out.append(self.unknown(text, at, ends[at], classes[at]))
            at = out[-1].end
        return out

    # -- results

    def token(self, text: str, n: Node) -> Token:
        d, surface = self.d, text[n.start : n.end]
        if n.entry_id == -1:
            return Token(surface, n.pos, surface, NONE, NONE, -1, n.cost, n.char_class)
        i = n.entry_id
        return Token(surface, d.pos[i], surface if d.lemma[i] in ("", NONE) else d.lemma[i], d.reading[i], d.reading_jyutping[i], i, d.cost[i], n.char_class)

    def separable(self, opts: TokenizeOptions) -> bool:
        """Whether runs of one class can be analysed apart: edges cost the same everywhere and no word leaves its run."""
        return self.d.one_class_words and (self.d.matrix is None or self.d.mode is Mode.LONGEST_MATCH) and opts.cancel_token is None

    def segment(self, text: str, opts: TokenizeOptions = TokenizeOptions(), cons: Constraints | None = None) -> list[Token]:
        """Tokens of a scanned text. Constraints, even an empty set, mean the cheapest path whatever the mode."""
        if cons is None and self.d.mode is Mode.LONGEST_MATCH:
            nodes = self.greedy(text)
        else:
            nodes = self.best_path(self.lattice(text, cons or NO_CONSTRAINTS, opts), opts)[1]
        return [self.token(text, n) for n in nodes]

    def nbest(self, text: str, k: int, opts: TokenizeOptions = TokenizeOptions(), cons: Constraints = NO_CONSTRAINTS) -> list[tuple[int, list[Token]]]:
        """The k cheapest paths (one at least; fewer if there are fewer) whatever the mode."""
        found = self.paths(self.lattice(text, cons, opts), opts)
        return [(cost, [self.token(text, n) for n in nodes]) for _, (cost, nodes) in zip(range(max(1, k)), found, strict=False)]
