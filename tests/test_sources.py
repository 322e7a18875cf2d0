import numpy as np
import pytest

from tessera.functions.charclass import ClassTable, default_ranges, overlay, valid, without
from tessera.functions.lemma import SPELLINGS, read_zh_table
from tessera.sources import resources as rs
from tessera.sources.csv_format import decimal, join_pos, records, short, split_fields
from tessera.sources.lexicon import detect_schema, parse_text
from tessera.types import CharClass, Language, LoadError, Schema, SchemaMismatchError


@pytest.mark.parametrize(
    ("line", "fields"),
    [('a,"b,c",d', ["a", "b,c", "d"]), ('x,"""q""",y', ["x", '"q"', "y"]), ('a"b,c', ['a"b', "c"]), ('さくら,0,"quoted"', ["さくら", "0", "quoted"]), ("a,,c", ["a", "", "c"]), ("a,,", ["a", "", ""]), ("", [""]), ('a,"b,c"', ["a", "b,c"])],
)
def test_split_fields(line, fields):
    assert split_fields(line) == fields


@pytest.mark.parametrize("line", ['a,"bc', '"a"b,c', 'a,"b"c'])
def test_bad_quotes(line):
    with pytest.raises(LoadError):
        split_fields(line)


def test_numbers_and_lines():
    assert [short(x) for x in ("99999", "-99999", "+5", "5x", "", " 5")] == [32767, -32768, 5, None, None, None]
    assert decimal("9" * 30) == 2**63 - 1
    assert list(records("﻿a\r\n\n  \nb")) == [(1, "a"), (4, "b")]
    assert join_pos(["a", "*", "", "b"]) == "a,b" and join_pos(["*"]) == "*"


def test_schemas():
    row = lambda n: ",".join(["w", "0", "0", "0", *"x" * (n - 4)])
    got = [detect_schema(lang, row(n))[0] for lang, n in ((Language.CHINESE_CN, 9), (Language.CHINESE_HK, 9), (Language.JAPANESE, 13), (Language.ENGLISH_US, 13), (Language.GERMAN, 13), (Language.JAPANESE, 21))]
    assert got == [Schema.MECAB_JIEBA, Schema.MECAB_JIEBA_HK, Schema.IPADIC, Schema.ENGLISH_EXT, Schema.IPADIC, Schema.UNIDIC]
    for text in ("", "a,b", row(10)):
        with pytest.raises(LoadError):
            parse_text(Language.JAPANESE, text)
    with pytest.raises(SchemaMismatchError, match=r"schema mismatch at line 3 \(expected 13 columns, got 9\)"):
        parse_text(Language.JAPANESE, row(13) + "\n\n" + row(9))


def test_resources():
    assert rs.unk_rules("KATAKANA,1,1,4000,名詞,一般,*\n")[0] == rs.UnkRule(CharClass.KATAKANA, 1, 1, 4000, "名詞,一般")
    assert rs.unk_rules("DEFAULT,1,1,5\nSYMBOL,0,0,1,x")[1].char_class is CharClass.PUNCT
    for bad in ("KATAKANA,1,1", "NOPE,1,1,1", "KATAKANA,名詞,1,1,4000"):
        with pytest.raises(LoadError):
            rs.unk_rules(bad)
    assert rs.unk_patterns("") == []
    for bad in ("prefix,,1,1,1", "infix,a,1,1,1", "charset,NOPE,1,1,1", "prefix,a,1,1"):
        with pytest.raises(LoadError):
            rs.unk_patterns(bad)
    m = rs.matrix("2 2\n0 0 99999\n0 1 5 extra\n0 1 6\n")
    assert (m.costs.tolist(), m.explicit, m.cost(5, 0)) == ([[32767, 6], [7000, 7000]], 2, 7000)
    assert rs.matrix("0 0\n").costs.size == 0
    for bad in ("", "2", "a b", "2 0", "2 2\n2 0 1", "2 2\n0 0 x", "2 2\n0 0", "40000 1"):
        with pytest.raises(LoadError):
            rs.matrix(bad)


def test_character_definitions():
    ranges, flags = rs.char_definitions("# c\nDEFAULT 0 1 0\nKANJI 0 0 2 # x\nNOPE 1 1 1\nSPACE\n0x3041..0x3096 HIRAGANA\n0x3050 KANJI\n0x4E00 0x4E10 KANJI\n61 SYMBOL\n")
    assert flags == {CharClass.UNKNOWN: rs.CharFlags(False, True, 0), CharClass.KANJI: rs.CharFlags(False, False, 2)}
    table = ClassTable(overlay(default_ranges(Language.JAPANESE), ranges))
    assert [table.of(c).name for c in "かぐ一丑=a"] == ["HIRAGANA", "KANJI", "KANJI", "HANZI", "PUNCT", "ASCII_LETTER", "UNKNOWN"]
    assert table.of(chr(0x3050)) is CharClass.KANJI
    for bad in ("0x41..0x40 KANJI", "A..Z KANJI", "x y"):
        with pytest.raises(LoadError):
            rs.char_definitions(bad)
    with pytest.raises(LoadError):
        ClassTable([(0, 5, CharClass.DIGIT), (3, 9, CharClass.DIGIT)])
    assert without([(0, 10, CharClass.DIGIT)], 3, 5) == [(0, 3, CharClass.DIGIT), (5, 10, CharClass.DIGIT)] and valid([])


def test_class_pattern_and_tables():
    import re

    table = ClassTable(default_ranges(Language.GERMAN))
    text = "Größe 12,5 \n日本ーかなé😀\x00x"
    runs = re.findall(table.pattern(), text)
    assert "".join(runs) == text and all(len({table.of(c) for c in r}) == 1 for r in runs)
    assert len(SPELLINGS) == 71 and read_zh_table("# x\n認\t认\n后\t后 後\nab\tc\n") == {"認": "认", "后": "后"}
    assert np.array(default_ranges(Language.CHINESE_TW), dtype=object).shape[0] == len(default_ranges(Language.CHINESE_CN)) + 2


def test_gold_corpus_lines(spark):
    from tessera.sources import corpora

    text = "# id\n* 0\nalpha x\r\nbeta\ty\n+ 1\nEOS\n\ngamma\nEOS\nEOS\nlast"
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text.split("\n"))] + [("g", 0, "EOS")], "file string, line_no int, value string")
    got = {(r.file, r.sentence): r.surfaces for r in corpora.gold_sentences(lines).collect()}
    assert got == {("f", 0): ["alpha", "beta"], ("f", 1): ["gamma"], ("f", 2): [], ("g", 0): []}
    assert corpora.listing(" a/b.knp \n\nc.knp\r\n") == ["a/b.knp", "c.knp"]
    df = spark.createDataFrame([(["a b", "c"],), (["ab"],)], "s array<string>")
    assert [r[0] for r in df.select(corpora.has_blank(df.s)).collect()] == [True, False]


def test_matrix_lines_in_either_form():
    import pytest

    from tessera.sources.resources import matrix
    from tessera.types import LoadError

    plain, odd = matrix("2 2\n0 1 5\n1 1 -40000\n0 1 6\n\n"), matrix("2 2\n0 1 5 more\n1 1 -40000\n0 1 6\n")
    for m in (plain, odd):
        assert (m.costs.tolist(), m.explicit) == ([[7000, 6], [7000, -32768]], 2)
    for bad in ("2 2\n0 2 5\n", "2 2\n0 1\n", "2 2\nx 1 1\n"):
        with pytest.raises(LoadError):
            matrix(bad)
