import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries, queries_files
from tessera.functions.text import classify_locale, safe_chunk_offsets, safe_chunks
from tessera.operators import relational as rel
from tessera.operators.kernel import Segmenter
from tessera.sources.resources import CharFlags
from tessera.types import Language

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


QUERIES = queries.QUERIES | queries_files.QUERIES
ORACLES = queries.ORACLES | queries_files.ORACLES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
        assert rows(got) == rows(want)


@pytest.mark.parametrize("flags", [CharFlags(), CharFlags(True, True, 2), CharFlags(False, False, 3), CharFlags(False, True, 0), CharFlags(True, False, 0)])
def test_relational_lattice_is_the_kernels(spark, flags):
    lexicon = queries.lexicon(spark, SF)
    words = [(w, w) for w in ("thethe", "another", "x", "überall", "tionation")]
    a = queries.analyzer(spark, SF, flags={c: flags for c in queries.CharClass})
    nodes = rel.lattice_nodes(spark.createDataFrame(words, "id string, text string"), lexicon, flags)
    got = {}
    for r in nodes.orderBy("id", "node").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.entry_id, r.cost))
    kernel = Segmenter(a.dictionary)
    assert got == {w: [(n.start, n.end, n.entry_id, n.cost) for n in kernel.lattice(w).nodes if n.entry_id is not None] for w, _ in words}


def plain_cuts(text, target):
    """Byte offsets after a line feed before a character that is no white space, once the piece has ``target`` bytes."""
    cuts, last, at = [], 0, 0
    for before, ch in zip(" " + text, text):
        if before == "\n" and at > 0 and ch not in "\t\n\x0b\f\r " and at - last >= max(target, 1):
            cuts.append(at)
            last = at
        at += len(ch.encode())
    return cuts


def test_safe_chunks(spark):
    rng = random.Random(12)
    texts = ["", "word", "\n\n", "one\ntwo\n three\nfour"] + ["".join(rng.choices(["\n", "\n\n", " ", "\t", "\r\n", "ab", "ß", "木", "long line of words"], k=rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(t, n) for t in texts for n in (-2, 1, 6, 30)], "t string, n int")
    for row in df.select("t", "n", safe_chunk_offsets(df.t, df.n).alias("o"), safe_chunks(df.t, df.n).alias("p")).collect():
        assert row.o == plain_cuts(row.t, row.n), (row.t, row.n)
        raw, ends = row.t.encode(), [*row.o, len(row.t.encode())]
        assert [p.encode() for p in row.p] == [raw[a:b] for a, b in zip([0, *row.o], ends, strict=True)]
    assert df.select(safe_chunks(F.lit(None).cast("string"), 3).alias("p")).first().p is None


def test_safe_chunks_of_many_lines(spark):
    n = 100_000
    df = spark.createDataFrame([("\n".join(f"line {i}" for i in range(n)),)], "t string")
    row = df.select(safe_chunk_offsets(df.t, 1).alias("o"), F.size(safe_chunks(df.t, 4096)).alias("k")).first()
    assert len(row.o) == n - 1 and row.k > 100


def test_locales(spark):
    df = spark.createDataFrame([("COLOURless", "ㄅ"), ("color centre", "武汉"), ("color", ""), ("plain", "x")], "en string, zh string")
    got = df.select(classify_locale(df.en, Language.ENGLISH_US).alias("e"), classify_locale(df.zh, Language.CHINESE_CN).alias("z"), classify_locale(df.zh, Language.JAPANESE).alias("j")).collect()
    assert [tuple(r) for r in got] == [("GB", "TW", "NONE"), ("NONE", "NONE", "NONE"), ("US", "NONE", "NONE"), ("NONE", "NONE", "NONE")]
