import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe, packing, token_files
from tessera.llm.byte_bpe import ByteBpe
from tessera.llm.packing import Packer, cuts, harmonic_class
from tessera.llm.token_files import Image, image_of
from tessera.llm.word_tokens import WordTokenizer

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "a  ", "\n\na b\n", "it's 'd'll''s don't 've", "'s x's ''s 's", "\t'm a12 3 ½²", "Straße ÉCOLE İx ſ ﬁ", "日本語 テスト", "é x", "<|endoftext|> hi",
    "foo\x85\x1c\x1dz", "ǅ ŉ Ω", "\n \n  x", "'lling 'ver 'rx", "a\n'sb", "!!'s ''ll", "aaaa" * 300, "x" * 5000, "ab " * 3000, "😀😀 x",
]
alphabet = st.text(st.sampled_from([*"aEst lv're1.-'ß日", "\n", "é"]), max_size=30)


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(WORD)


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(BYTE)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=40, deadline=None)
@given(st.lists(alphabet, max_size=20))
def test_word_ids_are_the_librarys(words, texts):
    for some in (texts, ODD):
        assert split(*words.encode(some)) == [words.whole.encode(x, add_special_tokens=False).ids for x in some]


@settings(max_examples=40, deadline=None)
@given(st.lists(alphabet, max_size=20))
def test_byte_ids_are_tiktokens_and_decode(bpe, tik, texts):
    for some in (texts, ODD):
        ids, offsets = bpe.encode(some)
        assert split(ids, offsets) == [tik.encode_ordinary(x) for x in some]
        out, ends = bpe.decode(ids, offsets)
        assert [out[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == some


def test_a_full_cache_starts_anew(tik):
    small = ByteBpe(BYTE, cache=3)
    for x in ("one two three four", "two five six seven eight"):
        assert small.encode([x])[0].tolist() == tik.encode_ordinary(x)


@pytest.mark.parametrize("make", [lambda: ByteBpe(BYTE), lambda: WordTokenizer(WORD)])
def test_pieces_with_one_hash_are_told_apart(make, tik):
    t = make()
    t.codes = np.zeros_like(t.codes)  # so that pieces of one length have one hash
    plain = make()
    for texts in (["one two six", "ten red"], ["two"], ["one two six ten"], ["red"]):
        assert split(*t.encode(texts)) == split(*plain.encode(texts))


def test_byte_bpe_over_rows(spark, docs_of, tik):
    df = docs_of(ODD)
    out = byte_bpe.encode_documents(df)
    rows = out.collect()
    assert out.columns == ["doc_id", "lang", "a", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and len(rows) == len(ODD) + 3
    for r in rows:
        text = ODD[r.doc_id] if r.doc_id is not None and r.doc_id < 1000 else "" if r.doc_id else "a row without an id, of some length"
        ids = tik.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode_documents(out).collect()}
    assert back[7] == ODD[7] and back[1001] == ""
    assert byte_bpe.encode_documents(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20), max_size=1500), st.integers(0, 5))
def test_images_give_every_token(values, shift):
    ids = np.array(values, np.uint32) >> shift
    starts = np.array([0, len(ids) // 3, len(ids) // 3, len(ids)])
    image = Image(image_of(ids, starts))
    assert image.tokens(0, len(ids)).tolist() == ids.tolist()
    for i in range(0, len(ids), 37):
        assert image.token(i) == ids[i]
        assert image.tokens(i, min(i + 50, len(ids))).tolist() == ids[i : i + 50].tolist()
    assert image.document(1).tolist() == [] and image.document(2).tolist() == ids[starts[2] :].tolist()


def test_broken_images_are_refused():
    good = image_of(np.arange(1000, dtype=np.uint32), np.array([0, 1000]))
    for bad in (b"", b"DAC0" + good[4:], good[:-1], good + b"x"):
        with pytest.raises(ValueError):
            Image(bad)
    with pytest.raises(IndexError):
        Image(good).token(1000)


def expected_ids(words, text):
    return [*words.whole.encode(text or "", add_special_tokens=False).ids, 1]


def test_token_files(spark, docs_of, words):
    df = docs_of([*ODD, "dup"]).union(docs_of(["again", "dup"], extra=False))
    segments = token_files.write_tokens(df)
    rows = sorted(token_files.read_tokens(segments, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in df.collect())
    at = 0
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(expected_ids(words, r.text))
    for r in rows:
        assert r.start == at and r.ids in texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0))).count() == 0


@given(st.integers(0, 9000))
def test_cuts_fill_their_slots(n):
    pieces = cuts(n)
    assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)
    assert sum(2048 // harmonic_class(p) - p for p in pieces) <= 90


def test_bins_hold_a_fixed_count_and_little_padding():
    rng = random.Random(3)
    packer, bins = Packer(), []
    for d in range(600):
        bins += packer.put(d, np.full(rng.choice([1, 3, 700, 1025, 1500, 5000, rng.randint(1, 3000)]), d, np.uint32))
    bins += packer.close()
    total = sum(len(p[2]) for b in bins for p in b)
    assert all(sum(len(p[2]) for p in b) <= 2048 for b in bins)
    assert len(bins) * 2048 <= 1.03 * total


def test_packing(spark, docs_of, words):
    df = docs_of([*ODD, "long words " * 3000])
    rows = packing.pack_documents(df).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in df.collect():
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert [x for p in pieces for x in p.ids] == expected_ids(words, r.text)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert all(p.doc_tokens == sum(q.length for q in pieces) for p in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0
