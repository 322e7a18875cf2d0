import pytest
from pyspark.sql import functions as F

from tessera.plans import evaluate, sqlreg
from tessera.plans.analyzer import Analyzer
from tessera.streaming.segment import tokenize_stream, write_stream
from tessera.types import BoundaryConstraint, Constraints, Language, LoadError, LoadOptions, Locale, Mode, TokenConstraint, TokenizeOptions, UnavailableError, UserEntry

JA = """猫,0,0,5200,名詞,一般,*,*,*,*,猫,ネコ,ネコ
が,0,0,3900,助詞,格助詞,一般,*,*,*,が,ガ,ガ
走る,0,0,6100,動詞,自立,*,*,五段・ラ行,基本形,走る,ハシル,ハシル
猫,0,0,5750,名詞,固有名詞,*,*,*,*,*,ネコ,ネコ
"""
ZH = """台北,0,0,5000,ns,tai2,台北,台北,"Tai, Pei"
龍,0,0,6000,n,long2,龍,龙,dragon
龍,0,0,6500,ns,long2,龍,龙,dragon
明天天氣,0,0,6000,n,ming2,明天天氣,x,news
明天,0,0,6000,n,ming2,明天,x,today
"""
HK = """台北,0,0,5000,ns,,x,x,x
台北,0,0,5000,ns,toi4,x,x,x
台北,0,0,5000,ns,bak1,x,x,x
龍,0,0,6000,n,lung4,x,x,x
沙田,0,0,6000,n,saa1,x,x,x
"""


@pytest.fixture(scope="module")
def ja(spark):
    return Analyzer.load_bytes(spark, Language.JAPANESE, JA.encode())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "猫が走る"), (2, ""), (3, None), (4, "ポポ 猫")], "id long, text string")


def test_columns(ja, docs):
    rows = {r.id: r.morphemes for r in ja.tokenize(docs).collect()}
    assert rows[2] == [] and rows[3] is None
    assert [(m.surface, m.start, m.end, m.entry_id, m.is_unknown) for m in rows[1]] == [("猫", 0, 3, 1, False), ("が", 3, 6, 0, False), ("走る", 6, 12, 3, False)]
    assert rows[1][2].pos == "動詞,自立,五段・ラ行,基本形" and rows[1][0].lemma == "猫" and rows[4][1].char_class == "SPACE"
    assert [r.wakati for r in ja.wakati(docs).orderBy("id").collect()] == ["猫 が 走る", "", None, "ポポ   猫"]
    assert ja.parse(docs).where("id = 1").first().parse.split("\n")[1] == "が\t助詞,格助詞,一般\tが\tガ\t*"
    spans = ja.spans(docs).where("id = 4").first().spans
    assert [(s.start, s.end) for s in spans] == [(0, 6), (6, 7), (7, 10)]
    assert ja.tokens(docs).where("id = 1").count() == 3
    binary = docs.withColumn("text", F.col("text").cast("binary"))
    assert {r.id: r.surfaces for r in ja.wakachi(binary).collect()} == {r.id: r.surfaces for r in ja.wakachi(docs).collect()}


def test_nbest_and_constraints(ja, docs):
    paths = ja.nbest(docs, 2).where("id = 1").first().paths
    assert [p.cost for p in paths] == [43200, 43750] and paths[0].rank == 1
    pinned = ja.tokenize_constrained(docs.where("id = 1"), Constraints((TokenConstraint(0, 3, "名詞,固有名詞"),))).first().morphemes
    assert pinned[0].cost == 5750
    bad = ja.tokenize_constrained(docs.where("id = 1"), Constraints((), (BoundaryConstraint(1),)), on_error="column").first()
    assert bad.morphemes is None and bad.error == "bad constraint 0: Not_Rune_Boundary (start 1, end -1)"
    with pytest.raises(Exception, match="malformed UTF-8 at byte offset 3"):
        raw = docs.sparkSession.createDataFrame([(bytearray("猫".encode() + b"\xff"),)], "text binary")
        ja.tokenize(raw, opts=TokenizeOptions(strict_utf8=True)).collect()


def test_resources_from_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text(JA)
    (tmp_path / "char.def").write_text("KATAKANA 1 0 2\nDEFAULT 0 1 0\n")
    (tmp_path / "unk.def").write_text("KATAKANA,0,0,100,名詞,片,*\n")
    (tmp_path / "matrix.def").write_text("1 1\n0 0 15\n")
    a = Analyzer.load(spark, Language.JAPANESE, str(tmp_path / "d.csv"))
    s = a.stats()
    assert (s.skipped, s.matrix_cells, s.matrix_explicit, s.unk_rules, s.entries, s.terminals) == (["patterns.qpat"], 1, 1, 1, 4, 3)
    assert [t.surface for t in a.tokenize_text("ポポ猫")] == ["ポポ", "猫"] and a.tokenize_text("ポ")[0].pos == "名詞,片"
    with pytest.raises(LoadError, match="file not found"):
        Analyzer.load(spark, Language.JAPANESE, str(tmp_path / "none.csv"))
    (tmp_path / "bad.csv").write_text(JA + "x,0,0\n")
    with pytest.raises(LoadError, match=r"schema mismatch at line 5 \(expected 13 columns, got 3\)"):
        Analyzer.load(spark, Language.JAPANESE, str(tmp_path / "bad.csv"))


def test_readings_lemmas_and_users(spark, ja, tmp_path):
    (tmp_path / "hk.csv").write_text(HK)
    a = Analyzer.load_bytes(spark, Language.CHINESE_TW, ZH.encode(), LoadOptions(jyutping_csv_path=str(tmp_path / "hk.csv"), lemma_locale=Locale.CN, zh_table={"龍": "龙"}))
    got = {(r.surface, r.reading_jyutping, r.lemma) for r in a.lexicon().collect()}
    assert got == {("台北", "toi4", "台北"), ("龍", "lung4", "龙"), ("明天", "*", "明天"), ("明天天氣", "*", "明天天氣")}
    assert a.lexicon().where("surface = '台北'").first().extra == ["Tai, Pei"]
    with pytest.raises(LoadError):
        Analyzer.load_bytes(spark, Language.CHINESE_TW, ZH.encode(), LoadOptions(jyutping_csv_path=str(tmp_path / "none.csv")))
    more = ja.add_user_entries([UserEntry("猫舎", cost=-3000, pos="名詞", reading="ネコシャ"), UserEntry("猫", cost=1)])
    assert [t.reading for t in more.tokenize_text("猫舎")] == ["ネコシャ"] and len(ja.tokenize_text("猫舎")) == 2
    assert more.entry_info(3)["cost"] == 1 and more.entry_info(99) is None and more.stats().entries_hash != ja.stats().entries_hash
    with pytest.raises(LoadError):
        ja.add_user_entries([UserEntry("")])
    with pytest.raises(ValueError):
        UserEntry("x", cost=40000)


def test_snapshots(spark, ja, tmp_path):
    again = Analyzer.restore(spark, ja.snapshot())
    assert again.stats() == ja.stats() and again.snapshot() == ja.snapshot()
    ja.save(f"file://{tmp_path}/s")
    assert Analyzer.load_snapshot(spark, f"file://{tmp_path}/s").snapshot() == ja.snapshot()
    for bad in (b"", b"QDCT", ja.snapshot()[:-200]):
        with pytest.raises(LoadError):
            Analyzer.restore(spark, bad)
    with pytest.raises(LoadError):
        Analyzer.load_snapshot(spark, f"file://{tmp_path}/none")
    with again:
        pass
    with pytest.raises(UnavailableError):
        again.stats()


def test_sql_and_streams(spark, ja, docs, tmp_path):
    sqlreg.register(ja, "ja_")
    docs.createOrReplaceTempView("texts")
    assert spark.sql("SELECT ja_wakachi(text) AS w FROM texts WHERE id = 1").first().w == ["猫", "が", "走る"]
    assert spark.sql("SELECT size(ja_nbest(text, 2)) AS n FROM texts WHERE id = 1").first().n == 2
    assert spark.sql("SELECT count(*) AS n FROM texts, LATERAL ja_tokens(text) WHERE id IN (1, 4)").first().n == 6
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    write_stream(tokenize_stream(ja, stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r.id: len(r.morphemes or []) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: 3, 2: 0, 3: 0, 4: 3}


def test_evaluation(spark, ja, docs):
    df = spark.createDataFrame([("abcd", ["ab", "cd"], ["a", "b", "cd"]), ("x", ["x"], ["x"])], "t string, g array<string>, p array<string>")
    r = evaluate.boundary_scores(df, "g", "p").first()
    assert (r.n_gold, r.n_predicted, r.n_shared, r.precision, r.recall) == (1, 2, 1, 0.5, 1.0) and abs(r.f1 - 2 / 3) < 1e-12
    gold = ja.wakachi(docs.where("id = 1"), out="gold")
    out = {r.k: r.f1 for r in evaluate.oracle_at_k(ja.nbest(gold, 2), "id", "gold", "paths", [1, 2]).collect()}
    assert out == {1: 1.0, 2: 1.0}


def test_greedy_mode_ignores_an_open_lattice(spark):
    a = Analyzer.load_bytes(spark, Language.JAPANESE, JA.encode(), LoadOptions(mode=Mode.LONGEST_MATCH))
    assert [t.surface for t in a.tokenize_text("猫が走る")] == ["猫", "が", "走る"]
    assert [t.entry_id for t in a.tokenize_text("猫")] == [1]


def test_morphemes_are_a_lazy_sequence(spark):
    a = Analyzer.load_bytes(spark, Language.JAPANESE, JA.encode())
    view = a.morphemes_text("猫が走る")
    a.close()
    assert len(view) == 3 and [m["surface"] for m in view] == ["猫", "が", "走る"]
    assert (view[-1]["start"], view[-1]["end"], view[1]["pos"]) == (6, 12, "助詞,格助詞,一般")
    assert view[1:] == [view[1], view[2]] and view[::2][1] == view[2] and list(view[3:]) == []
    with pytest.raises(IndexError):
        view[3]


def test_tokens_written_over_a_table(spark, ja, docs, tmp_path):
    for _ in range(2):
        out = ja.tokenize_into(docs, f"{tmp_path}/out")
    assert out.count() == 4 and out.where("id = 1").first().morphemes[0].surface == "猫"


def test_median_and_grid(spark, ja, docs):
    df = spark.createDataFrame([(5.0,), (1.0,), (2.0,), (9.0,)], "x double")
    assert df.agg(evaluate.median("x")).first()[0] == 3.5 and df.limit(0).agg(evaluate.median("x")).first()[0] == 0.0
    gold = ja.wakachi(docs.where("id = 1"), out="gold")
    points = evaluate.grid_sweep(ja, gold, "text", "gold", [0, 100], [0]).collect()
    assert [(p.bias, p.per_rune, p.f1) for p in points] == [(0, 0, 1.0), (100, 0, 1.0)]
