import pytest
from helpers import segmenter, surfaces
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.kernel import byte_offsets, first_malformed, scan_text
from tessera.sources.resources import CharFlags, UnkPattern, UnkRule
from tessera.types import BoundaryConstraint, CancelledError, CancelToken, CharClass, ConstraintError, ConstraintReason, Constraints, Language, MalformedInputError, Mode, PatternKind, TokenConstraint, TokenizeOptions, UnsatisfiableError

WORDS = [("猫", 0, 0, 5200, "名詞,一般"), ("が", 0, 0, 4000, "助詞,格助詞,一般"), ("走る", 0, 0, 6000, "動詞,自立"), ("大阪", 0, 0, 3000, "名詞"), ("の", 0, 0, 3000, "助詞")]


def nbest(s, text, k, cons=Constraints()):
    return [(cost, surfaces(tokens)) for cost, tokens in s.nbest(text, k, cons=cons)]


def test_words_offsets_and_fallbacks():
    s = segmenter(WORDS)
    assert surfaces(s.segment("猫が走る")) == ["猫", "が", "走る"]
    assert byte_offsets("猫が走る") == [0, 3, 6, 9, 12]
    greedy = segmenter(WORDS, mode=Mode.LONGEST_MATCH)
    assert surfaces(greedy.segment("大阪の猫")) == ["大阪", "の", "猫"]
    unknown = greedy.segment("ポポ猫")[0]
    assert (unknown.surface, unknown.pos, unknown.entry_id, unknown.char_class, unknown.lemma) == ("ポポ", "名詞,普通名詞", -1, CharClass.KATAKANA, "ポポ")
    assert [t.char_class for t in greedy.segment("椿谷椿")] == [CharClass.HANZI]


def test_spaces_are_unknown_morphemes_and_lemmas_fall_back():
    s = segmenter([("defence", 0, 0, 100, "NOUN", "*", "*", "*", []), ("travels", 0, 0, 100, "VERB", "travel", "*", "*", [])], Language.ENGLISH_GB)
    tokens = s.segment("defence travels")
    assert [(t.surface, t.lemma, t.entry_id < 0) for t in tokens] == [("defence", "defence", False), (" ", " ", True), ("travels", "travel", False)]


def test_malformed_bytes_are_one_byte_each():
    text = "猫".encode() + b"\xff\xfe" + "が".encode()
    text = text.decode("utf-8", "surrogateescape")
    s = segmenter(WORDS, mode=Mode.LONGEST_MATCH)
    assert [len(t.surface.encode("utf-8", "surrogateescape")) for t in s.segment(text)] == [3, 2, 3]
    assert first_malformed(text) == 1
    with pytest.raises(MalformedInputError, match="malformed UTF-8 at byte offset 3"):
        scan_text(text, TokenizeOptions(strict_utf8=True))


def test_lattice_of_homographs():
    s = segmenter([("もみじ", 0, 0, 5350, "a"), ("もみじ", 0, 0, 5450, "b")])
    assert len(s.lattice("もみじ").nodes) == 7
    s = segmenter([("もみじ", 0, 0, 5350, "a"), ("もみじ", 0, 0, 5350, "b"), ("も", 0, 0, 1, "c")])
    assert s.matches("もみじ", 0) == [0, 2, 1]
    assert [t.entry_id for t in s.segment("もみじ")] == [2]
    assert [t.entry_id for t in segmenter([("もみじ", 0, 0, 5350, "a"), ("もみじ", 0, 0, 5350, "b")], mode=Mode.LONGEST_MATCH).segment("もみじ")] == [0]


def test_connection_costs():
    rows = [("ミト", 1, 1, 100, "x")]
    assert surfaces(segmenter(rows, matrix=[[0, -9000], [-9000, 6500]]).segment("ミミトミ")) == ["ミ", "ミト", "ミ"]
    assert surfaces(segmenter(rows, mode=Mode.LONGEST_MATCH).segment("ミミトミ")) == ["ミミトミ"]
    assert nbest(segmenter([("猫", 0, 0, 4700, "x")], matrix=[[31]]), "猫", 1) == [(4762, ["猫"])]
    assert nbest(segmenter([("猫", 0, 0, 4700, "x")], matrix=[[-215]]), "猫", 1) == [(4270, ["猫"])]
    assert nbest(segmenter([("猫", 8, 8, 4700, "x")], matrix=[[31]]), "猫", 1) == [(18700, ["猫"])]
    empty = segmenter([], matrix=[[-215]])
    assert empty.segment("") == [] and empty.nbest("", 3) == [(-215, [])] and len(empty.lattice("").nodes) == 2


def test_nbest():
    rows = [("K", 0, 0, 0, "x"), ("M", 0, 0, 0, "x")]
    s = segmenter([*rows, ("KM", 0, 0, 25, "x")], Language.ENGLISH_US)
    assert nbest(s, "KM", 2) == [(14025, ["KM"]), (21000, ["K", "M"])]
    assert len(nbest(s, "KM", 0)) == 1 and len(nbest(s, "KM", 99)) == 2
    assert [c for c, _ in nbest(segmenter([*rows, ("KM", 0, 0, 7000, "x")], Language.ENGLISH_US), "KM", 9)] == [21000, 21000]


def test_search_only_costs():
    rows = [(c, 0, 0, 15000, "x") for c in "らりる"]
    s = segmenter(rows, flags={CharClass.HIRAGANA: CharFlags(True, True, 0)})
    assert surfaces(s.segment("らりる")) == ["らりる"]
    tokens = s.segment("らりる", TokenizeOptions(unk_cost_bias=60000))
    assert surfaces(tokens) == ["ら", "り", "る"] and tokens[0].cost == 15000
    s = segmenter([("Dorf", 0, 0, 900, "NOUN")], Language.GERMAN, flags={CharClass.ASCII_LETTER: CharFlags(True, True, 0)})
    assert surfaces(s.segment("Dorfbrunnen")) == ["Dorfbrunnen"]
    tokens = s.segment("Dorfbrunnen", TokenizeOptions(unk_cost_per_rune=2500))
    assert surfaces(tokens) == ["Dorf", "brunnen"] and tokens[1].cost == 0


@pytest.mark.parametrize(("flags", "ends"), [(CharFlags(False, False, 2), [1, 2]), (CharFlags(False, True, 0), [4]), (CharFlags(False, False, 0), [1]), (CharFlags(False, True, 9), [4, 1, 2, 3])])
def test_unknown_candidates(flags, ends):
    nodes = segmenter([], flags={CharClass.KATAKANA: flags}).lattice("ポポポポ").nodes
    assert [n.end for n in nodes if n.start == 0 and n.entry_id == -1] == ends


def test_unknown_ladder():
    patterns = [UnkPattern(PatternKind.PREFIX, "第", 0, 0, 4550, "p"), UnkPattern(PatternKind.SUFFIX, "的", 0, 0, 4400, "s"), UnkPattern(PatternKind.CHARSET, CharClass.KATAKANA, 0, 0, 4700, "k")]
    d = segmenter([], patterns=patterns, rules=[UnkRule(CharClass.HIRAGANA, 0, 0, 3900, "h")]).d
    got = [d.resolve(c, t)[:2] for t, c in (("本格的", CharClass.KANJI), ("第五的", CharClass.KANJI), ("ヌヌ", CharClass.KATAKANA), ("あいう", CharClass.HIRAGANA), ("あ", CharClass.DIGIT))]
    assert got == [("s", 4400), ("p", 4550), ("k", 4700), ("h", 3900), ("名詞,普通名詞", 0)]


def test_constraints():
    pin = lambda a, b, pos="": Constraints((TokenConstraint(a, b, pos),))
    s = segmenter([("もみじ", 0, 0, 5350, "名詞,一般"), ("もみじ", 0, 0, 6150, "名詞,固有名詞,人名")])
    assert s.segment("もみじが", cons=pin(0, 9, "名詞,固有名詞"))[0].cost == 6150
    s = segmenter([("が", 0, 0, 4000, "助詞")])
    assert surfaces(s.segment("ぬべが", cons=pin(0, 9))) == ["ぬべが"]
    assert surfaces(s.segment("ぬべが", cons=pin(3, 6))) == ["ぬ", "べ", "が"]
    with pytest.raises(UnsatisfiableError, match="byte offset 6"):
        s.segment("ぬべが", cons=pin(3, 6, "動詞"))
    s = segmenter([("な", 0, 0, 4900, "x"), ("に", 0, 0, 4900, "x"), ("なに", 0, 0, 9100, "x")])
    at = lambda must: Constraints((), (BoundaryConstraint(3, must),))
    assert surfaces(s.segment("なに", cons=at(False))) == ["なに"] and surfaces(s.segment("なに", cons=at(True))) == ["な", "に"]
    assert nbest(s, "なに", 3, at(True)) == [(30800, ["な", "に"])]
    with pytest.raises(UnsatisfiableError, match="byte offset 3"):
        segmenter([("なに", 0, 0, 0, "x")], flags={CharClass.HIRAGANA: CharFlags(False, True, 0)}).segment("なに", cons=at(True))


@pytest.mark.parametrize(
    ("tokens", "bounds", "reason", "index"),
    [
        ([(0, 99, "")], [], ConstraintReason.OUT_OF_BOUNDS, 0),
        ([(9, 9, "")], [], ConstraintReason.EMPTY_SPAN, 0),
        ([(1, 9, "")], [], ConstraintReason.NOT_RUNE_BOUNDARY, 0),
        ([(0, 9, ",名詞")], [], ConstraintReason.BAD_POS_PATTERN, 0),
        ([(0, 9, ""), (3, 9, "")], [], ConstraintReason.TOKEN_OVERLAP, 1),
        ([], [(0, True)], ConstraintReason.OUT_OF_BOUNDS, 0),
        ([], [(1, True)], ConstraintReason.NOT_RUNE_BOUNDARY, 0),
        ([(0, 9, "")], [(3, True)], ConstraintReason.BOUNDARY_INSIDE_TOKEN, 0),
        ([(0, 9, "")], [(9, False)], ConstraintReason.BOUNDARY_AT_TOKEN_EDGE, 0),
        ([], [(3, True), (3, False)], ConstraintReason.CONFLICTING_BOUNDARIES, -1),
    ],
)
def test_bad_constraints(tokens, bounds, reason, index):
    cons = Constraints(tuple(TokenConstraint(*t) for t in tokens), tuple(BoundaryConstraint(*b) for b in bounds))
    with pytest.raises(ConstraintError) as e:
        scan_text("もみじが", TokenizeOptions(), cons)
    assert (e.value.reason, e.value.index) == (reason, index)


def test_composition():
    text = "か゚゙"[0] + "゙"
    assert scan_text(text, TokenizeOptions(normalize_nfc=True)) == "が"
    with pytest.raises(ConstraintError, match="Normalization_Rescaled"):
        scan_text(text, TokenizeOptions(normalize_nfc=True), Constraints((), (BoundaryConstraint(3),)))


def test_cancelled():
    spent = CancelToken()
    spent.cancel()
    opts = TokenizeOptions(cancel_token=spent)
    s = segmenter(WORDS)
    assert s.segment("", opts) == []
    for call in (lambda: s.segment("猫", opts), lambda: s.nbest("", 1, opts)):
        with pytest.raises(CancelledError, match="byte offset 0"):
            call()


lexicons = st.lists(st.tuples(st.text("ab1", min_size=1, max_size=3), st.integers(0, 1), st.integers(0, 1), st.integers(-3000, 9000), st.sampled_from(["x", "y,z"])), max_size=6)


@settings(max_examples=150, deadline=None)
@given(lexicons, st.text("ab1 ", max_size=7), st.booleans(), st.integers(-9000, 9000), st.booleans())
def test_best_path_is_the_cheapest_and_runs_are_independent(entries, text, linked, bias, invoke):
    flags = {CharClass.ASCII_LETTER: CharFlags(invoke, True, 1)}
    s = segmenter(entries, Language.ENGLISH_US, [[0, 500], [-700, 7000]] if linked else None, flags=flags)
    opts = TokenizeOptions(unk_cost_bias=bias)
    lattice = s.lattice(text, opts=opts)
    cost, path = s.best_path(lattice, opts)
    every = list(s.paths(lattice, opts))
    assert cost == min(c for c, _ in every) and [c for c, _ in every] == sorted(c for c, _ in every)
    assert "".join(text[n.start : n.end] for n in path) == text
    if s.separable(opts):
        from tessera.operators.batches import BatchSegmenter

        of = BatchSegmenter(s.d)
        assert [list(of.table.number)[i] for i in of.numbers(text, opts)] == s.segment(text, opts)


def test_lone_continuation_bytes_are_no_boundaries():
    text = (b"ab" + b"\x80\xc3" + b"c").decode("utf-8", "surrogateescape")
    at = lambda b: Constraints((), (BoundaryConstraint(b, True),))
    with pytest.raises(ConstraintError, match="Not_Rune_Boundary"):
        scan_text(text, TokenizeOptions(), at(2))
    assert scan_text(text, TokenizeOptions(), at(3)) == text and scan_text(text, TokenizeOptions(), at(1)) == text


def test_long_runs_with_patterns():
    import time

    patterns = [UnkPattern(PatternKind.CHARSET, CharClass.ASCII_LETTER, 0, 0, 50, "w")]
    s = segmenter([], Language.ENGLISH_US, patterns=patterns, flags={CharClass.ASCII_LETTER: CharFlags(True, True, 2)})
    start = time.time()
    assert s.segment("q" * 40_000)[0].pos == "w" and time.time() - start < 10
