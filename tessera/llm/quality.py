"""Op 1, quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics of every text are computed once and stored. One pass over the labelled rows sums, per class, the count, the
sum and the outer products, which is all that the model needs: its memory doesn't depend on the rows. Class covariances
are shrunk to the pooled one and that to a multiple of the identity, and factored once (Cholesky); a score is the
logistic of the difference of the classes' log densities plus the log prior odds.

Nulls and edge cases: a null text counts as empty and gets a score like any other. Rows without a label or without a
doc_id are scored but not learned from. With no labelled rows, or those of one class, every score is 0.5 or the class's
share. Repeated rows count as often as they occur, and equal texts score alike. Texts of any length are read whole. Only
doc_id, text and the label are read, so other columns of whatever name don't matter; without rows there are none.
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
from tessera.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, class_table, code_points, distinct, mixed, range_hashes, runs

BATCH_CHARS = 500_000
THRESHOLD = 0.3
#: Shares of the pooled covariance, and of the identity, in each class covariance.
TO_POOLED, TO_IDENTITY = 0.3, 0.02
#: Scores stay this far from 0 and 1 in log odds.
MOST_LOG_ODDS = 30.0

STATISTICS = [
    "log_chars", "log_words", "log_lines", "letters", "digits", "marks", "symbols", "capitals", "blanks",
    "mean_word", "spread_word", "short_words", "long_words", "plain_words", "distinct_words", "top_word", "words_a_line", "distinct_lines", "odd_chars",
]
#: The marks of ordinary prose.
PROSE_MARKS = [ord(c) for c in ".,;:!?'\"()-"]

_tables: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Classes of code points, with 4 for prose marks and 5 for capital letters."""
    if not _tables:
        kinds = class_table()
        kinds[PROSE_MARKS] = 4
        kinds[[c for c in range(0x250) if chr(c).isupper()]] = 5
        _tables.append(kinds)
    return _tables[0]


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a share, smoothed by half a case."""
    return np.log((x + 0.5) / (np.maximum(n - x, 0) + 0.5))


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics per text, in the order of STATISTICS."""
    points, starts = code_points(texts)
    n, kinds = len(texts), _classes()[points]
    chars = np.diff(starts)
    doc_of = np.repeat(np.arange(n), chars)
    by_kind = np.bincount(doc_of * 6 + kinds, minlength=6 * n).reshape(n, 6)
    letters = by_kind[:, LETTER] + by_kind[:, 5]
    blank = kinds == SPACE
    start, end = runs(blank.astype(np.uint8), starts)
    word = ~blank[start] if len(start) else np.zeros(0, bool)
    start, end = start[word], end[word]
    owner, size = doc_of[start], end - start
    count = lambda keep: np.bincount(owner[keep], minlength=n).astype(float)
    words = np.bincount(owner, minlength=n).astype(float)
    total, squares = np.bincount(owner, size, n), np.bincount(owner, size.astype(float) ** 2, n)
    mean = total / np.maximum(words, 1)
    hashes = mixed(points.astype(np.uint64))
    not_letter = np.concatenate(([0], np.cumsum((kinds != LETTER) & (kinds != 5))))
    plain = not_letter[end] - not_letter[start] <= (kinds[end - 1] == 4 if len(end) else 0)
    pair, where, place = distinct(range_hashes(hashes, start, end) ^ mixed(owner.astype(np.uint64)))
    times, whose = np.bincount(place, minlength=len(pair)), owner[where]
    top = np.zeros(n)
    np.maximum.at(top, whose, times)
    feed = points == 0x0A
    lines = np.bincount(doc_of[feed], minlength=n) + 1.0
    cut = np.flatnonzero(feed)
    line_start = np.sort(np.concatenate((starts[:-1], cut + 1)))
    line_end = np.sort(np.concatenate((starts[1:], cut)))
    filled = line_end > line_start
    line_owner = np.searchsorted(starts, line_start[filled], side="right") - 1
    _, first, _ = distinct(range_hashes(hashes, line_start[filled], line_end[filled]) ^ mixed(line_owner.astype(np.uint64)))
    full_lines = np.bincount(line_owner, minlength=n)
    return np.stack(
        [
            np.log1p(chars), np.log1p(words), np.log(lines), _share(letters, chars), _share(by_kind[:, NUMBER], chars), _share(by_kind[:, 4], chars),
            _share(by_kind[:, OTHER], chars), _share(by_kind[:, 5], letters), _share(by_kind[:, SPACE], chars), np.log1p(mean),
            np.log1p(np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))), _share(count(size <= 3), words), _share(count(size >= 12), words),
            _share(count(plain), words), _share(np.bincount(whose, minlength=n), words), _share(top, words), np.log1p(words / lines),
            _share(np.bincount(line_owner[first], minlength=n), full_lines), _share(np.bincount(doc_of[points >= 0x250], minlength=n), chars),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """Two Gaussians by their means and the inverses of their Cholesky factors, and the log prior odds of class 1."""

    log_odds: float
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]

    @classmethod
    def fit(cls, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
        """``sums``: per class the count, the sum and the sum of outer products."""
        counts = [sums[k][0] if k in sums else 0.0 for k in (0, 1)]
        log_odds = math.log((counts[1] + 0.5) / (counts[0] + 0.5)) if sum(counts) else 0.0
        if min(counts) < 2:
            return cls(log_odds, [], [], [])
        means = [sums[k][1] / counts[k] for k in (0, 1)]
        own = [sums[k][2] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (counts[0] * own[0] + counts[1] * own[1]) / sum(counts)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        whiten, log_det = [], []
        for k in (0, 1):
            c = ((1 - to_pooled) * own[k] + to_pooled * pooled) / np.outer(scale, scale)
            c = (1 - to_identity) * c + to_identity * np.eye(len(c))
            factor = np.linalg.cholesky((c + c.T) / 2 + 1e-9 * np.eye(len(c)))
            whiten.append(np.linalg.solve(factor, np.diag(1 / scale)))
            log_det.append(2 * float(np.log(np.diag(factor)).sum()))
        return cls(log_odds, means, whiten, log_det)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.log_odds)
        if self.means:
            for k, sign in ((0, -1.0), (1, 1.0)):
                y = (x - self.means[k]) @ self.whiten[k].T
                z += sign * -0.5 * ((y * y).sum(1) + self.log_det[k])
        return 1 / (1 + np.exp(-np.clip(z, -MOST_LOG_ODDS, MOST_LOG_ODDS)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row, x its statistics."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in spans_of_bytes(texts, BATCH_CHARS):
                x = statistics(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return map_arrow(docs.select("doc_id", "text"), kernel, "doc_id long, x array<double>")


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums over (x, label): each partition adds its rows up, and the entries of the sums are added up by Spark."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x, y = np.hstack((np.ones((len(x), 1)), x)), batch.column("label").to_numpy(zero_copy_only=False)
            for k in np.unique(y).tolist():
                sums[k] = sums.get(k, 0) + x[y == k].T @ x[y == k]
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], ["label", "sums"])

    parts = map_arrow(rows.select("x", "label"), kernel, "label int, sums array<double>")
    total: dict[int, dict[int, float]] = {}
    for k, at, value in parts.select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("value")).collect():
        total.setdefault(k, {})[at] = value
    out = {}
    for k, entries in total.items():
        m = np.array([entries[i] for i in range(len(entries))]).reshape(math.isqrt(len(entries)), -1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` (x, ...) with x replaced by ``score``."""
    keep = [f for f in rows.schema if f.name not in ("x", "score")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(model.scores(x))], [*(f.name for f in keep), "score"])

    return map_arrow(rows.select(*[f"`{f.name}`" for f in keep], "x"), kernel, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["score double"]))


def classify_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and the label.

    ``learn`` says which labelled rows may be learned from, all but the held-out ones by default.
    """
    x = stored(with_statistics(docs), "statistics")
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    model = Discriminant.fit(class_sums(x.join(known, "doc_id")))
    return score(x, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
