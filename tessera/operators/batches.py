"""Segmentation of Arrow batches of texts into the result columns.

Tokens repeat, so a worker numbers the distinct ones and turns a text into a list of numbers; result columns are then
gathered from the table of distinct tokens, and byte offsets are a cumulative sum of their widths. Where runs of one
class are independent, each distinct run is analysed once for each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from tessera.operators.compiled import CompiledDictionary
from tessera.operators.kernel import Segmenter, Token, scan_text
from tessera.types import BoundaryConstraint, CharClass, Constraints, TesseraError, TokenConstraint, TokenizeOptions

#: Distinct tokens or runs that a worker keeps before it starts anew.
MOST_KEPT = 300_000


class TokenTable:
    """The distinct tokens met so far and their columns."""

    FIELDS = ("surface", "pos", "lemma", "reading", "reading_jyutping", "entry_id", "cost", "char_class")

    def __init__(self) -> None:
        self.number: dict[Token, int] = {}
        self.columns: dict[str, pa.Array] = {}
        self.made: dict[str, list[str]] = {"surface": [], "line": []}
        self.width = np.zeros(0, np.int64)

    def numbers(self, tokens: list[Token]) -> list[int]:
        known = self.number
        return [known.setdefault(t, len(known)) for t in tokens]

    def column(self, name: str) -> pa.Array:
        self._grow()
        return self.columns[name]

    def strings(self, kind: str) -> list[str]:
        """Of every token its surface, or its line: surface, pos, lemma and readings between tabs."""
        made = self.made[kind]
        if len(made) < len(self.number):
            names = ("surface",) if kind == "surface" else self.FIELDS[:5]
            made += ["\t".join([_text(getattr(t, f)) for f in names]) for t in list(self.number)[len(made) :]]
        return made

    def widths(self) -> np.ndarray:
        self._grow()
        return self.width

    def _grow(self) -> None:
        have = len(self.width)
        if have == len(self.number):
            return
        new = list(self.number)[have:]
        made = {f: pa.array([_text(getattr(t, f)) for t in new], pa.string()) for f in self.FIELDS[:5]}
        made["entry_id"] = pa.array([t.entry_id for t in new], pa.int32())
        made["cost"] = pa.array([t.cost for t in new], pa.int16())
        made["char_class"] = pa.array([CharClass(t.char_class).name for t in new], pa.string())
        made["is_unknown"] = pa.array([t.entry_id < 0 for t in new], pa.bool_())
        self.columns = {k: pa.concat_arrays([self.columns[k], v]) if have else v for k, v in made.items()}
        self.width = np.concatenate((self.width, np.array([len(t.surface.encode("utf-8", "surrogateescape")) for t in new], np.int64)))


def _text(s: str) -> str:
    """Malformed bytes can't be in a string column: there they are U+FFFD. Offsets count them as they are."""
    return s if s.isascii() else s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class BatchSegmenter:
    def __init__(self, dictionary: CompiledDictionary):
        self.kernel = Segmenter(dictionary)
        self.runs = re.compile(dictionary.classes.pattern())
        self.clear()

    def clear(self) -> None:
        self.table, self.by_run = TokenTable(), {}

    def numbers(self, text: str, opts: TokenizeOptions, cons: Constraints | None = None) -> list[int]:
        """The tokens of a scanned text by number."""
        if cons is not None or not self.kernel.separable(opts):
            return self.table.numbers(self.kernel.segment(text, opts, cons))
        known, runs = self.by_run, self.runs.findall(text)
        for run in set(runs).difference(known):
            known[run] = self.table.numbers(self.kernel.segment(run, opts))
        return list(chain.from_iterable(map(known.__getitem__, runs)))

    def renew(self) -> None:
        if len(self.by_run) + len(self.table.number) > MOST_KEPT:
            self.clear()


_segmenters: dict[int, tuple[CompiledDictionary, BatchSegmenter]] = {}


def segmenter_of(dictionary: CompiledDictionary, opts: TokenizeOptions) -> BatchSegmenter:
    """One segmenter for each worker, dictionary and cost options."""
    key = hash((id(dictionary), opts.unk_cost_bias, opts.unk_cost_per_rune))
    if key not in _segmenters or _segmenters[key][0] is not dictionary:
        _segmenters.clear()
        _segmenters[key] = dictionary, BatchSegmenter(dictionary)
    return _segmenters[key][1]


def decoded(value: str | bytes | None) -> str | None:
    return bytes(value).decode("utf-8", "surrogateescape") if isinstance(value, (bytes, bytearray)) else value


def constraints_of(value: dict | None) -> Constraints:
    value = value or {}
    return Constraints(
        tuple(TokenConstraint(t["start"], t["end"], t["pos"] or "") for t in value.get("tokens") or ()),
        tuple(BoundaryConstraint(b["at"], b["must_exist"]) for b in value.get("boundaries") or ()),
    )


def lists(offsets: np.ndarray, values: pa.Array, null: np.ndarray) -> pa.Array:
    """A list column; a null row is an empty range."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(null) if null.any() else None)


def numbered(batch: pa.RecordBatch, of: BatchSegmenter, opts: TokenizeOptions, text: str, constraints: str | None, keep_errors: bool) -> tuple[list[list[int]], np.ndarray, pa.Array]:
    """The tokens of each text by number, which results are null (of null texts and of faults), and the faults."""
    of.renew()
    numbers: list[list[int]] = []
    errors: list[str | None] = []
    cons = batch.column(constraints).to_pylist() if constraints else None
    texts = batch.column(text).to_pylist()
    for i, value in enumerate(texts):
        value, got, error = decoded(value), [], None
        if value is not None:
            try:
                c = None if cons is None else constraints_of(cons[i])
                got = of.numbers(scan_text(value, opts, c or Constraints()), opts, c)
            except TesseraError as e:
                if not keep_errors:
                    raise
                error = str(e)
        numbers.append(got)
        errors.append(error)
    return numbers, np.array([t is None or e is not None for t, e in zip(texts, errors, strict=True)], bool), pa.array(errors, pa.string())


def joined(batch: pa.RecordBatch, of: BatchSegmenter, opts: TokenizeOptions, kind: str, between: str, text: str, keep_errors: bool) -> tuple[pa.Array, pa.Array]:
    """(result, error) of a batch: the tokens' surfaces or lines in one string."""
    numbers, null, errors = numbered(batch, of, opts, text, None, keep_errors)
    string = of.table.strings(kind).__getitem__
    return pa.array([None if no else between.join(map(string, x)) for x, no in zip(numbers, null.tolist(), strict=True)], pa.string()), errors


def segmented(batch: pa.RecordBatch, of: BatchSegmenter, opts: TokenizeOptions, fields: tuple[str, ...] | None, text: str, constraints: str | None, keep_errors: bool) -> tuple[pa.Array, pa.Array]:
    """(result, error) of a batch. A token is a struct of ``fields``, or its surface alone. A null text gives a null result."""
    numbers, null, errors = numbered(batch, of, opts, text, constraints, keep_errors)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in numbers], dtype=np.int64)))
    at = np.fromiter(chain.from_iterable(numbers), np.int64, int(offsets[-1]))
    index = pa.array(at)
    take = lambda name: of.table.column(name).take(index) if len(at) else of_type(name)
    if fields is None:
        return lists(offsets, take("surface"), null), errors
    made = {}
    if "start" in fields or "end" in fields:
        width = of.table.widths()[at] if len(at) else np.zeros(0, np.int64)
        end = np.cumsum(width)
        first = np.concatenate(([0], end))[offsets[:-1]]
        base = np.repeat(first, np.diff(offsets))
        made = {"start": pa.array((end - width - base).astype(np.int32)), "end": pa.array((end - base).astype(np.int32))}
    if "locale" in fields:
        made["locale"] = pa.array([of.kernel.d.language.locale.name]).take(pa.array(np.zeros(len(at), np.int64)))
    return lists(offsets, pa.StructArray.from_arrays([made[f] if f in made else take(f) for f in fields], list(fields)), null), errors


def of_type(name: str) -> pa.Array:
    return pa.array([], {"entry_id": pa.int32(), "cost": pa.int16(), "is_unknown": pa.bool_()}.get(name, pa.string()))


def morphemes_of(of: BatchSegmenter, tokens: list[Token]) -> list[dict]:
    """Tokens as rows of the morpheme schema, for results that are few."""
    out, at = [], 0
    for t in tokens:
        end = at + len(t.surface.encode("utf-8", "surrogateescape"))
        texts = {f: _text(getattr(t, f)) for f in TokenTable.FIELDS[:5]}
        out.append(texts | {"entry_id": t.entry_id, "cost": t.cost, "start": at, "end": end, "locale": of.kernel.d.language.locale.name, "char_class": CharClass(t.char_class).name, "is_unknown": t.entry_id < 0})
        at = end
    return out


def nbest_rows(batch: pa.RecordBatch, of: BatchSegmenter, opts: TokenizeOptions, k: int, text: str, constraints: str | None, keep_errors: bool, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    cons = batch.column(constraints).to_pylist() if constraints else [None] * batch.num_rows
    out: list[list[dict] | None] = []
    errors: list[str | None] = []
    for value, c in zip(batch.column(text).to_pylist(), cons, strict=True):
        value, rows, error = decoded(value), None, None
        if value is not None:
            try:
                c = constraints_of(c)
                found = of.kernel.nbest(scan_text(value, opts, c), k, opts, c)
                rows = [{"rank": i, "cost": cost, "morphemes": morphemes_of(of, tokens)} for i, (cost, tokens) in enumerate(found, 1)]
            except TesseraError as e:
                if not keep_errors:
                    raise
                error = str(e)
        out.append(rows)
        errors.append(error)
    return pa.array(out, kind), pa.array(errors, pa.string())


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
