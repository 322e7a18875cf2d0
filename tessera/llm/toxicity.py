"""Op 5, toxicity: a factorization machine over hashed terms.

A text is the set of its lower-cased words, hashed to ``BITS`` bits. The model adds a weight per term and, for each pair
of terms, the inner product of their factors, so that two terms may mean together what neither means alone. It learns
from at most ``MOST_ROWS`` labelled rows of each class, those of the smallest hashed doc_id, which bounds its memory;
its prior is set back to that of all labelled rows. Terms are counted by class over these rows (one distributed sum).
A first machine over all terms in ``PAIR_DOCS`` of them or more nominates those that act in pairs; of these, the pairs
that tell more by chi-square than their terms alone stay, beside the ``MOST_TERMS`` single terms that tell most, and the
final machine is fitted over both.

Nulls and edge cases: a null text counts as empty and scores by the prior. Rows without a label or doc_id are scored but
not learned from. With no labelled rows of one class every score is that class's share (0 with no labels at all). Of
terms that tell alike, the smaller hash goes first; repeated rows are scored alike and learned from as often as they
occur. Texts of any length are read whole. Columns named score and predicted are replaced, others stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, map_arrow, spans_of_bytes, stored, texts_of
from tessera.llm.pretokens import LETTER, class_table, code_points, distinct, mixed, range_hashes, runs

THRESHOLD = 0.5
BITS = 32
MOST_TERMS = 2048
MOST_ROWS = 10_000
LEAST_DOCS = 4
FACTORS = 8
LEAST_CHI = 12.0
#: For pairs: texts that a term must be in, terms looked at, factors and epochs of the machine that nominates them, and
#: the least chi-square of a pair, which must be so many times that of its terms.
PAIR_DOCS, PAIR_TERMS, PAIR_FACTORS, PAIR_EPOCHS, LEAST_PAIR_CHI, PAIR_GAIN = 16, 256, 4, 4, 40.0, 3.0
PAIR_STEPS, PAIR_STEP, PAIR_LASSO = 400, 0.1, 3e-4
LEAST_STEPS, EPOCHS, STEP, ROWS_A_STEP = 3000, 10, 0.05, 256
#: The first fit draws weights to zero, where terms end that only go along with the telling ones; the second fits the rest.
LASSO, DECAY = 3e-4, 1e-4
LEAST_WEIGHT = 1e-3
BATCH_CHARS = 800_000

_letters: list[np.ndarray] = []


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text number, term) pairs of a batch, by text."""
    if not _letters:
        _letters.append(class_table() == LETTER)
    points, starts = code_points([x.lower() for x in texts])
    letter = _letters[0][points]
    start, end = runs(letter.astype(np.uint8), starts)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = start[letter[start]], end[letter[start]]
    owner = np.searchsorted(starts, start, side="right") - 1
    term = range_hashes(mixed(points.astype(np.uint64)), start, end) >> np.uint64(64 - BITS)
    _, at, _ = distinct((owner.astype(np.uint64) << np.uint64(BITS)) | term)
    return owner[at], term[at].astype(np.int64)


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, n, n1) over (text, label): in how many texts a term is, and in how many of class 1. Batches count first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = texts_of(batch), batch.column("label").to_numpy(zero_copy_only=False)
            for a, b in spans_of_bytes(texts, BATCH_CHARS):
                owner, term = terms(texts[a:b])
                if len(term):
                    found, _, place = distinct(term.astype(np.uint64))
                    n = np.bincount(place, minlength=len(found))
                    n1 = np.bincount(place[label[a:b][owner] == 1], minlength=len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n), pa.array(n1)], ["term", "n", "n1"])

    return map_arrow(rows.select("text", "label"), kernel, "term long, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def chi_square(both: np.ndarray, n: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Of a feature in ``n`` rows, ``both`` of which are in class 1, with the label of n0 + n1 rows."""
    a, b = both.astype(float), (n - both).astype(float)
    c, d = n1 - a, n0 - b
    below = (a + b) * (c + d) * n1 * n0
    return np.divide((a * d - b * c) ** 2 * (n0 + n1), below, out=np.zeros_like(a), where=below > 0)


def single_terms(counts: pa.Table, n0: float, n1: float) -> np.ndarray:
    """The terms of the highest chi-square with the label, at most ``MOST_TERMS``, in ascending order."""
    term, n, own = (counts.column(c).to_numpy() for c in ("term", "n", "n1"))
    chi = chi_square(own, n, n0, n1)
    best = np.flatnonzero((n >= LEAST_DOCS) & (chi >= LEAST_CHI))
    return np.sort(term[best[np.lexsort((term[best], -chi[best]))[:MOST_TERMS]]])


def nominated(m: int, owner: np.ndarray, column: np.ndarray, label: np.ndarray, seed: int = 7) -> np.ndarray:
    """The ``PAIR_TERMS`` columns of ``m`` with the longest factors in a machine over all of them.

    Steps touch only the terms of their rows (AdaGrad); a lasso on weights and on whole factors pulls idle ones to zero.
    """
    rng = np.random.default_rng(seed)
    order = np.argsort(owner, kind="stable")
    owner, column = owner[order], column[order]
    starts = np.searchsorted(owner, np.arange(len(label) + 1))
    x = np.hstack((np.zeros((m, 1)), rng.normal(0, 0.05, (m, PAIR_FACTORS))))
    squares, seen, bias, step = np.full(x.shape, 1e-4), np.zeros(m), math.log((label.sum() + 0.5) / ((1 - label).sum() + 0.5)), 0
    for _ in range(max(PAIR_EPOCHS, -(-PAIR_STEPS * ROWS_A_STEP // max(len(label), 1)))):
        shuffled = rng.permutation(len(label))
        for at in range(0, len(shuffled), ROWS_A_STEP):
            rows = shuffled[at : at + ROWS_A_STEP]
            size = starts[rows + 1] - starts[rows]
            ends = np.cumsum(size)
            pick = np.repeat(starts[rows] - (ends - size), size) + np.arange(ends[-1])
            cols, col = np.unique(column[pick], return_inverse=True)
            row, here = np.repeat(np.arange(len(rows)), size), x[cols]
            sums = np.stack([np.bincount(row, v[col], len(rows)) for v in here[:, 1:].T], axis=1)
            z = bias + np.bincount(row, here[col, 0], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (here[:, 1:] ** 2).sum(1)[col], len(rows)))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows))[row]
            total = np.bincount(col, error, len(cols))
            slope = np.column_stack((total, *(np.bincount(col, error * s[row], len(cols)) for s in sums.T)))
            slope[:, 1:] -= total[:, None] * here[:, 1:]
            step += 1
            squares[cols] += slope**2
            pace = PAIR_STEP / np.sqrt(squares[cols])
            here -= pace * slope
            due = PAIR_LASSO * (step - seen[cols])
            here[:, 0] = np.sign(here[:, 0]) * np.maximum(np.abs(here[:, 0]) - pace[:, 0] * due, 0)
            length = np.maximum(np.sqrt((here[:, 1:] ** 2).sum(1)), 1e-12)
            here[:, 1:] *= np.maximum(1 - pace[:, 1:].mean(1) * due / length, 0)[:, None]
            x[cols], seen[cols] = here, step
    return np.sort(np.argsort(-(x[:, 1:] ** 2).sum(1), kind="stable")[:PAIR_TERMS])


def telling_pairs(some: np.ndarray, owner: np.ndarray, column: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Those of the columns ``some`` (ascending) that tell far more together with another of them than either does alone."""
    there = np.isin(column, some)
    has = np.zeros((len(label), len(some)), np.float32)
    has[owner[there], np.searchsorted(some, column[there])] = 1
    n1 = float(label.sum())
    n0 = len(label) - n1
    n, both = has.T @ has, (has * label[:, None].astype(np.float32)).T @ has
    chi = chi_square(both, n, n0, n1)
    alone = np.maximum(np.diag(chi)[:, None], np.diag(chi)[None, :])
    tells = (chi >= LEAST_PAIR_CHI) & (chi >= PAIR_GAIN * alone) & (n >= LEAST_DOCS)
    np.fill_diagonal(tells, False)
    return some[tells.any(1)]


@dataclass
class Machine:
    """A factorization machine over the terms that it knows (ascending)."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    @classmethod
    def fit(cls, known: np.ndarray, owner: np.ndarray, column: np.ndarray, label: np.ndarray, prior: float, lasso: float = 0.0, seed: int = 7) -> Machine:
        """Adam over shuffled steps of the logistic loss, with a rate that falls to zero. (owner, column): the known terms of each row; prior: log odds of all rows."""
        rng, m = np.random.default_rng(seed), len(known)
        order = np.argsort(owner, kind="stable")
        owner, column = owner[order], column[order]
        starts = np.searchsorted(owner, np.arange(len(label) + 1))
        w, v, bias = np.zeros(m), rng.normal(0, 0.01, (m, FACTORS)), 0.0
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, np.zeros(1))]
        t, epochs = 0, max(EPOCHS, -(-LEAST_STEPS * ROWS_A_STEP // max(len(label), 1)))
        steps = epochs * -(-len(label) // ROWS_A_STEP)
        for _ in range(epochs):
            shuffled = rng.permutation(len(label))
            for at in range(0, len(shuffled), ROWS_A_STEP):
                rows = shuffled[at : at + ROWS_A_STEP]
                size = starts[rows + 1] - starts[rows]
                ends = np.cumsum(size)
                pick = np.repeat(starts[rows] - (ends - size), size) + np.arange(ends[-1])
                col, row = column[pick], np.repeat(np.arange(len(rows)), size)
                sums = np.zeros((len(rows), FACTORS))
                np.add.at(sums, row, v[col])
                z = bias + np.bincount(row, w[col], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (v[col] ** 2).sum(1), len(rows)))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
                g_w = np.bincount(col, error[row], m) + DECAY * w
                g_v = DECAY * v
                np.add.at(g_v, col, error[row][:, None] * (sums[row] - v[col]))
                t += 1
                rate = STEP * (1 - (t - 1) / steps)
                for x, g, (m1, m2) in zip((w, v), (g_w, g_v), moments, strict=False):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g * g - m2)
                    pace = rate / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-6)
                    x -= pace * m1 / (1 - 0.9**t)
                    x[:] = np.sign(x) * np.maximum(np.abs(x) - pace * lasso, 0)
                bias -= rate * float(error.sum()) * 4
        share = (label.sum() + 0.5) / (len(label) - label.sum() + 0.5)
        return cls(known, bias + prior - math.log(share), w, v)

    @classmethod
    def fit_sparse(cls, known: np.ndarray, owner: np.ndarray, column: np.ndarray, label: np.ndarray, prior: float) -> Machine:
        """Fit with the lasso, then again without it over the terms that kept a weight."""
        first = cls.fit(known, owner, column, label, prior, LASSO)
        left = np.flatnonzero(np.abs(first.weight) + np.abs(first.factor).sum(1) > LEAST_WEIGHT)
        there = np.isin(column, left)
        return cls.fit(known[left], owner[there], np.searchsorted(left, column[there]), label, prior)

    def scores(self, n: int, owner: np.ndarray, term: np.ndarray) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(self.terms):
            column = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            there = self.terms[column] == term
            owner, column = owner[there], column[there]
            sums = np.zeros((n, self.factor.shape[1]))
            np.add.at(sums, owner, self.factor[column])
            z += np.bincount(owner, self.weight[column], n) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (self.factor[column] ** 2).sum(1), n))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def sample_terms(rows: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, column, label) of the rows (text, label), which the caller has bounded: only known terms reach the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, term = terms(texts_of(batch))
            column = np.minimum(np.searchsorted(known, term), len(known) - 1)
            there = known[column] == term
            ends = np.searchsorted(owner[there], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(column[there].astype(np.int32)))], ["label", "columns"])

    got = map_arrow(rows.select("text", "label"), kernel, "label int, columns array<int>").toArrow()
    lists = got.column("columns").combine_chunks()
    label = got.column("label").to_numpy()
    return np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy(), label


def learn_machine(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, most_rows: int = MOST_ROWS) -> Machine:
    """The machine learned from ``docs`` (doc_id, text) and ``labels`` (doc_id, label), by default from rows not held out."""
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    none = Machine(np.zeros(0, np.int64), math.log((n1 + 0.5) / (n0 + 0.5)) if n0 and n1 else (700.0 if n1 else -700.0), np.zeros(0), np.zeros((0, FACTORS)))
    if not n0 or not n1:
        return none
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for k in (0, 1)]
    chosen = parts[0].union(parts[1])  # at most 2 * most_rows rows of two numbers
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"), "labelled")
    taken = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(taken) < 2:
        return none
    counts = term_counts(rows).where(F.col("n") >= LEAST_DOCS).toArrow()
    best = single_terms(counts, taken[0], taken[1])
    wide = np.sort(counts.column("term").to_numpy()[counts.column("n").to_numpy() >= PAIR_DOCS])
    known = np.union1d(best, wide)
    if not len(known):
        return none
    owner, column, y = sample_terms(rows, known)
    y = y.astype(float)
    here = np.isin(known, wide)[column]
    numbers = np.searchsorted(known, wide)
    near = nominated(len(wide), owner[here], np.searchsorted(numbers, column[here]), y) if len(wide) else np.zeros(0, np.int64)
    chosen = np.union1d(np.searchsorted(known, best), telling_pairs(numbers[near], owner, column, y))
    if not len(chosen):
        return none
    kept = np.isin(column, chosen)
    return Machine.fit_sparse(known[chosen], owner[kept], np.searchsorted(chosen, column[kept]), y, math.log((n1 + 0.5) / (n0 + 0.5)))


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (text, ...) with ``score`` and ``predicted`` added, or replaced."""
    keep = [f for f in docs.schema if f.name not in ("score", "predicted")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            score = np.concatenate([machine.scores(b - a, *terms(texts[a:b])) for a, b in spans_of_bytes(texts, BATCH_CHARS)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*(f.name for f in keep), "score", "predicted"])

    return map_arrow(docs.select(*[f"`{f.name}`" for f in keep]), kernel, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["score double", "predicted int"]))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (text, ...) that score under the threshold, with all their columns as they are."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            score = np.concatenate([machine.scores(b - a, *terms(texts[a:b])) for a, b in spans_of_bytes(texts, BATCH_CHARS)] or [np.zeros(0)])
            yield batch.filter(pa.array(score < threshold))

    return map_arrow(docs, kernel, docs.schema)
