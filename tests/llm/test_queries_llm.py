"""The query functions against plain versions, over tables with nulls, empty, repeated and long texts."""

import hashlib
import math
import random
import struct
import zlib

import base64
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_texts import base_spans, brute_components, kept_lines, more_spans

from tessera.llm.queries import QUERIES
from tessera.llm.secrets import KINDS
from tessera.llm.word_tokens import WordTokenizer

sha = lambda b: hashlib.sha256(b).hexdigest()
crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) + "\n" * rng.randint(0, 2) + rng.choice(["", "a line that many share", "token=abcdefgh12345678"]) for _ in range(120)]
    texts += [None, "", texts[3], texts[3], "x" * 5000 + " 0123456789abcdef", "\n".join(f"line number {i}" for i in range(5000)), "日本語 É\u0130 😀"]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, score int, ids string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 100)] + [(101, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)]) for i in range(230)] + [(400, None), (500, [math.nan] * 8), (600, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path, {i: t or "" for i, t, _, _ in rows}, dict(vectors)


def rows_of(spark, tables, name):
    return QUERIES[name](spark, tables[0]).collect()


@pytest.mark.parametrize("name, bound", [("op1_quality", 0.3), ("op5_toxicity", 0.5)])
def test_classifiers(spark, tables, name, bound):
    rows = rows_of(spark, tables, name)
    assert sorted(r.doc_id for r in rows) == sorted(tables[1])
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bound)


def test_op2(spark, tables):
    want = brute_components(list(tables[1].items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows_of(spark, tables, "op2_near_duplicates")} == want


def test_op3(spark, tables):
    listed = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    rows = rows_of(spark, tables, "op3_secret_scan")
    assert len(rows) == len(tables[1])
    for r in rows:
        base = base_spans(tables[1][r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r.base_sha256 == sha(listed(base).encode()) and r.spans == listed(more_spans(tables[1][r.doc_id]))


def test_op4_and_op9(spark, tables):
    whole = WordTokenizer(P.path("word_bpe_49k.json")).whole
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in tables[1].items()}
    at = 0
    for r in sorted(rows_of(spark, tables, "op9_token_files"), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        at += r.n_tokens
    assert at == sum(map(len, ids.values()))
    pieces, bins = {}, {}
    for r in rows_of(spark, tables, "op4_harmonic_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    for i, x in ids.items():
        assert [j for p in sorted(pieces[i], key=lambda p: p.start) for j in range(p.start, p.start + p.length)] == list(range(len(x)))
    for some in bins.values():
        assert [j for p in sorted(some, key=lambda p: p.offset) for j in range(p.offset, p.offset + p.length)] == list(range(sum(p.length for p in some)))
        assert sum(p.length for p in some) <= 2048


def test_op6(spark, tables):
    want = dict(kept_lines(list(tables[1].items())))
    for r in rows_of(spark, tables, "op6_line_dedup"):
        n = len(tables[1][r.doc_id].split("\n"))
        assert r.n_lines == n and r.kept_sha256 == sha(want[r.doc_id].encode())
        assert r.n_dropped == n - len(want[r.doc_id].split("\n")) or want[r.doc_id] == ""


def test_op7_and_op10(spark, tables):
    v = {i: np.array(x) for i, x in tables[2].items() if x is not None and np.isfinite(x).all()}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows_of(spark, tables, "op7_exact_topk")}
    w = {i: np.floor(256 * x).astype(int) for i, x in v.items()}
    for q in (i for i in w if i % 50 == 0):
        best = sorted((-int(w[q] @ x), i) for i, x in w.items() if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, -s) for s, i in best]
    assert len(got) == 5 * sum(i % 50 == 0 for i in w)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows_of(spark, tables, "op10_nearest_neighbours")}
    some = {i: x for i, x in v.items() if x.any()}
    assert {q for q, _ in got} == {i for i in some if i % 100 == 0}
    for (q, _), (i, s) in got.items():
        assert math.isclose(s, math.dist(some[q], some[i]), rel_tol=1e-12)


def test_op8(spark, tables):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows_of(spark, tables, "op8_byte_bpe"):
        ids = tik.encode_ordinary(tables[1][r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(struct.pack(f"<{len(ids)}I", *ids)) and r.decoded_sha256 == sha(tables[1][r.doc_id].encode())
