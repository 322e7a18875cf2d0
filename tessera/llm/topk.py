"""Op 7, exact top-k by integer inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row: its terms are the dimensions with a weight other than zero. The candidates of a block are
inverted into postings (row, weight) per term. Some queries at a time go through the terms; each scatters its weighted
postings into the dense score arrays of the queries that have it, few enough to stay in a core's cache. A partition then
selects the k best of each array, and blocks are merged by (score, id); once a query has k candidates, only scores that
reach the least of them are looked at.

Sums are exact, in 32 bits where the largest weights of two blocks allow it. A pair that might take a sum beyond 64 bits is added up in integers of any
size; a score that a long can't hold becomes the nearest one that it can. See ``vectors`` for nulls, ties, repeated rows
and clashing columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import NEVER, Best, Search, Side, own_rows, search_blocks, widened

SCALE = 256
K = 5
QUERIES_AT_ONCE, ROWS_AT_ONCE = 32, 4096
#: Sums under these can't overflow 64 and 32 bits; the highest score. NEVER is what a row that is no candidate scores.
SAFE, SHORT, MOST = 2.0**62, 2.0**30, (1 << 63) - 1


def weights(v: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * v) in 64 bits, or as integers of any size where one is larger."""
    with np.errstate(over="ignore"):
        w = np.nan_to_num(np.floor(scale * v.astype(np.float64)))
    if np.abs(w).max(initial=0) < SAFE:
        return w.astype(np.int64)
    return np.array([int(x) for x in w.ravel()], object).reshape(w.shape)


def largest(w: np.ndarray) -> float:
    return float(max(-w.min(initial=0), w.max(initial=0)))


def postings(w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per term the rows that have it, in ascending order, and their weights."""
    return [(rows := np.flatnonzero(column), column[rows]) for column in w.T]


def accumulate(q: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int, most: list[float] | None = None) -> np.ndarray:
    """Scores of the queries ``q`` (weights) over ``n`` candidates, a term at a time; ``most``: the largest weight of each list."""
    bound = float(np.abs(q.astype(np.float64)).max(0, initial=0) @ np.array(most or [largest(weight) for _, weight in lists]))
    wide = not bound < SAFE
    scores = np.zeros((len(q), n), object if wide else np.int32 if bound < SHORT else np.int64)
    q, room = q.astype(scores.dtype), np.empty_like(scores)
    for term, (rows, weight) in enumerate(lists):
        has = np.flatnonzero(q[:, term])
        if not len(has) or not len(rows):
            continue
        weight = weight.astype(scores.dtype)
        if 2 * len(rows) <= n:
            scores[np.ix_(has, rows)] += q[has, term, None] * weight
            continue
        if len(rows) < n:  # zeros where a row lacks the term
            weight, some = np.zeros(n, scores.dtype), weight
            weight[rows] = some
        if 2 * len(has) > len(q):
            scores += np.multiply(q[:, term, None], weight, out=room)
        else:
            scores[has] += q[has, term, None] * weight
    return np.clip(scores, NEVER + 1, MOST).astype(np.int64) if wide else scores.astype(np.int64)


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row, but for NEVER; of equal scores the lower columns."""
    n = scores.shape[1]
    if n > k:
        bound = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
        over, tied = scores > bound, scores == bound
        keep = over | tied & (np.cumsum(tied, axis=1) <= k - over.sum(1, keepdims=True))
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & (scores != NEVER))


def top_k(df: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``df`` where ``is_query`` (over the column id) holds."""

    def search(queries: Side, best: Best) -> Search:
        q_ids, q = queries

        def go(block: Side) -> None:
            ids, v = block
            width = max(q.shape[1], v.shape[1])
            for c in range(0, len(ids), ROWS_AT_ONCE):
                some = ids[c : c + ROWS_AT_ONCE]
                lists = postings(weights(widened(v[c : c + ROWS_AT_ONCE], width), scale))
                most = [largest(weight) for _, weight in lists]
                for a in range(0, len(q), QUERIES_AT_ONCE):
                    own = slice(a, a + QUERIES_AT_ONCE)
                    scores = accumulate(weights(widened(q[own], width), scale), lists, len(some), most)
                    scores[own_rows(q_ids[own], some)] = NEVER
                    row, column = np.nonzero((scores >= best.bound[own, None]) & (scores != NEVER))
                    if len(row) > 8 * k * len(scores):
                        row, column = select(scores, k)
                    best.merge(row + a, some[column], scores[row, column])

        return go

    return search_blocks(df, is_query, search, k, "long", True, id, vector)
