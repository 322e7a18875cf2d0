import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours, topk, vectors


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 24))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=24))], 1) for i in range(600)]
    rows += [(700 + i, rows[5][1], 1) for i in range(40)]  # one vector many times
    rows += [(900, None, 1), (901, [], 1), (902, [None] * 24, 1), (903, [math.nan] * 24, 1), (904, [math.inf] * 24, 1), (905, [0.0] * 24, 1), (None, [1.0] * 24, 1), (906, [1.0] * 7, 1), (50, [0.5] * 24, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long")


def usable(table, zero):
    out = []
    for r in table.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((r.vec_id, np.array(v + [0.0] * (24 - len(v)))))
    return out


def queries_of(rows, every):
    chosen = {}
    for i, v in rows:
        if i % every == 0 and (i not in chosen or v.tolist() < chosen[i].tolist()):
            chosen[i] = v
    return chosen


def test_exact_topk(table):
    rows = usable(table, True)
    ints = [(i, np.floor(256 * v).astype(np.int64)) for i, v in rows]
    got = {}
    for r in topk.top_k(table, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    want = {}
    for q, v in queries_of(rows, 50).items():
        w = np.floor(256 * v).astype(np.int64)
        best = sorted((-int(w @ x), i) for i, x in ints if i != q)[:5]
        want[q] = dict(enumerate(best, 1))
    assert got == want
    assert topk.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0
    few = topk.top_k(table.where("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0)
    assert few.count() == 2


def test_selection_with_ties():
    scores = np.array([[1, 5, 5, 5, 0], [7, topk.NEVER, 7, 1, 7]])
    row, column = topk.select(scores, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 2)]
    assert topk.select(scores[1:], 9)[1].tolist() == [0, 2, 3, 4]


def test_nearest_neighbours(table):
    rows = usable(table, False)
    got = {}
    for r in neighbours.nearest(table, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries, hits, total = queries_of(rows, 20), 0, 0
    assert set(got) == set(queries)
    for q, v in queries.items():
        all_ = sorted((math.sqrt(((x - v) ** 2).sum()), i) for i, x in rows if i != q)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[1] for m in mine] == [i for _, i in sorted((s, i) for _, i, s in mine)]
        assert all(min(abs(d - s) for d, j in all_ if j == i) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i in all_[:10]} & {m[1] for m in mine})
        total += 10
    assert hits / total >= 0.9
    few = neighbours.nearest(table.where("vec_id in (0, 1, 2, 905)"), F.col("id") % 20 == 0)
    assert few.count() == 2 and neighbours.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_recall_on_the_test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    hits = total = 0
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        d = ((x - v[q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
        total += 10
    assert total == 200 and hits / total >= 0.9


def test_rotations_keep_lengths_and_signed_axes():
    x = np.random.default_rng(1).normal(size=(9, 24))
    y = neighbours.rotated(x, 3)
    assert y.shape == (9, 32) and np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert neighbours.buckets(np.array([[0.1, -3.0], [2.0, 1.0]])).tolist() == [3, 0]
    asked = neighbours.probed(y, 4)
    assert asked.shape == (9, 4) and all(len(set(a)) == 4 and b in a for a, b in zip(asked.tolist(), neighbours.buckets(y).tolist(), strict=True))


def test_tables_of_a_block_hold_every_row_in_its_bucket():
    x = np.random.default_rng(2).normal(size=(50, 10))
    raw = np.frombuffer(neighbours.in_tables(x, 3, 1), np.int32)
    edges, members = raw[: 3 * 33].reshape(3, 33), raw[3 * 33 :]
    for t in range(3):
        own = neighbours.buckets(neighbours.rotated(neighbours.units(x), t, 3, 1))
        for b in range(32):
            assert members[edges[t, b] : edges[t, b + 1]].tolist() == np.flatnonzero(own == b).tolist()


def test_recall_with_log_normal_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64)) * rng.lognormal(0, 1, (4000, 1))
    df = spark.createDataFrame([(i, v.tolist(), "more", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, data string, width int")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 40 and hits / 400 >= 0.9


def test_exact_topk_of_large_components(spark):
    rows = [(0, [1e6, 0.0]), (1, [1e6, 0.0]), (2, [2e6, 0.0]), (3, [3.0, 0.0]), (50, [1e300, -1e300]), (51, [1e300, 0.0]), (52, [-1e300, 0.0]), (53, [1e17, 1e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fits = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    for q in (0, 50):
        w = [[int(math.floor(256 * x)) for x in v] for _, v in rows]
        mine = w[[i for i, _ in rows].index(q)]
        best = sorted((-fits(sum(a * b for a, b in zip(mine, x, strict=True))), i) for x, (i, _) in zip(w, rows, strict=True) if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert {i: s for _, i, s in got[0]}[2] == 131072000000000000 and {i: s for _, i, s in got[0]}[1] == 65536000000000000


def test_queries_are_copied_no_more_than_candidates_outweigh_them(spark, table, monkeypatch):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    whole = sorted(map(tuple, topk.top_k(table, F.col("id") % 50 == 0).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        rows = vectors.usable(table)
        n, asked = table.where("vec_id is not null").count(), table.where("vec_id % 50 = 0").count()
        groups, slices, _ = vectors.grid(table, rows, F.col("id") % 50 == 0, "vec_id")
        assert (groups, slices) == (-(-n // asked), 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    monkeypatch.setattr(vectors, "HELD", 2000)
    assert vectors.grid(table, rows, F.col("id") % 50 == 0, "vec_id")[1] == 2
    assert sorted(map(tuple, topk.top_k(table, F.col("id") % 50 == 0).collect())) == whole


def test_sums_in_32_bits_only_where_they_fit():
    rng = np.random.default_rng(5)
    for most in (3, 200, 60_000, 1 << 33):
        q, w = rng.integers(-most, most, (5, 9)), rng.integers(-most, most, (300, 9))
        w[rng.random(w.shape) < [0.0, 0.02, 0.4, 0.5, 0.6, 0.9, 1.0, 0.0, 0.3]] = 0
        q[:3, 4] = 0
        want = q.astype(object) @ w.T.astype(object)
        assert (topk.accumulate(q, topk.postings(w), len(w)) == np.clip(want, -(2**63) + 1, 2**63 - 1)).all()


def test_screen_keeps_every_pair_within_the_bound():
    rng = np.random.default_rng(6)
    for scale in (1e-200, 1e-8, 1.0, 1e8, 1e200):
        q = rng.normal(size=(30, 20)) * scale
        v = np.concatenate((q[:7], q[:20] + rng.normal(size=(20, 20)) * scale * 1e-6, rng.normal(size=(200, 20)) * scale))
        with np.errstate(over="ignore"):
            away = np.sqrt(((q[:, None] - v) ** 2).sum(2))
        bound = np.sort(away, axis=1)[:, 4]
        got = np.zeros(away.shape, bool)
        got[neighbours.Screen(q, v).near(np.arange(30), np.arange(len(v)), bound)] = True
        assert got[away <= bound[:, None]].all()
        assert scale not in (1e-8, 1.0, 1e8) or got.sum() < 30 * 8


def test_one_product_turns_as_the_transform():
    x = np.random.default_rng(7).normal(size=(5, 24))
    wide = np.hstack((x, np.zeros((5, 8))))
    assert np.allclose(neighbours.rotated(x, 2), neighbours.turned(wide, 2, neighbours.TABLES, neighbours.SEED))
