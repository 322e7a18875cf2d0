"""Op 3, secret scans, in DataFrame functions only: key patterns, and sliding-window entropy over candidate strings.

The base kinds are the matches of three patterns. The entropy kinds add, for every candidate string (a maximal run of
token characters with a digit in it), the stretch covered by windows whose Shannon entropy reaches the bound of the
candidate's character class. The window slides by incremental counts: one symbol enters, one leaves, and the sum of
``c * log2(c)`` changes by their two terms. Candidates on the allow list, and those that meet a base span, add nothing.

Nulls and edge cases: a null text is an empty one; offsets are code points, ends exclusive. ``find_secrets`` replaces
columns named like the two that it adds; ``redact`` leaves columns of whatever name alone. Matches of one pattern never
overlap, and spans of equal start are in the order of their kinds. Positions in a long text are sums over the square
root of its matches, so time grows little faster than the text. There is no shuffle: every row is handled alone, so
repeated rows get equal results, and an empty table an empty one.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, with pattern and least length (of group 2 for the first).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: (kind, class of candidates, least entropy of a window in bits), tried in order.
ENTROPY_KINDS = [
    ("entropy_hex", "^[0-9A-Fa-f]+$", 3.0),
    ("entropy_alnum", "^[A-Za-z0-9]+$", 3.75),
    ("entropy_base64", "^[A-Za-z0-9+/_=-]+$", 3.85),
]
#: What a candidate with high entropy may be without being a secret.
ALLOWED = [
    "(?i)example|sample|placeholder|changeme|your[_-]?(key|token)|xxxx|test[_-]key|dummy",
    "(?i)0123456789|abcdefgh|qwerty|deadbeef",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9_/=+-]+$",
    "^(?:[A-Za-z]+|[0-9]+)(?:[/_=+-]+(?:[A-Za-z]+|[0-9]+))*$",
]
KINDS = ["assign", "access", "hex", *(k for k, _, _ in ENTROPY_KINDS)]
MARK = "[SECRET]"
STRETCH = 4096


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def places(text: Column, pattern: str, matches: Column) -> Column:
    """(s, m) for each match m of ``pattern``: it starts after the matches and the stretches between them that come before.

    Lengths are added up in blocks of the square root of their number, and blocks by the sums of those before.
    """
    empty = F.array().cast("array<struct<s:int,m:string>>")

    def located(sizes: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(sizes))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, block), lambda i: F.slice(sizes, i + 1, block))
        return let(F.transform(blocks, in_block), lambda b: let(before(b), lambda at: F.flatten(F.transform(b, lambda x, i: F.transform(x["found"], lambda y: F.struct((y["s"] + F.get(at, i)).alias("s"), y["m"].alias("m")))))))

    def in_block(sizes: Column) -> Column:
        start = F.struct(empty.alias("found"), F.lit(0).alias("at"))

        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.char_length(x["gap"])
            return F.struct(F.concat(acc["found"], F.array(F.struct(at.alias("s"), x["m"].alias("m")))).alias("found"), (at + F.char_length(x["m"])).alias("at"))

        return F.aggregate(sizes, start, add)

    def before(blocks: Column) -> Column:
        return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))

    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    return F.when(F.size(matches) > 0, let(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), located)).otherwise(empty)


def spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), (x["s"] + F.char_length(x["m"])).alias("e")))


def x_log2_x(x: Column) -> Column:
    return F.when(x > 1, x * F.log2(x.cast("double"))).otherwise(F.lit(0.0))


def hot_stretch(word: Column, bound: Column, window: int = WINDOW) -> Column:
    """(first, last): start of the first and end of the last window of ``word`` whose entropy reaches ``bound``; last is 0 if none.

    The state holds the counts of the window's symbols and the sum of c * log2(c); each step is O(distinct symbols).
    """
    symbols = F.split(word, "")
    alphabet = F.array_distinct(symbols)
    codes = F.transform(symbols, lambda c: F.array_position(alphabet, c).cast("int"))
    most = math.log2(window)

    def slide(acc: Column, i: Column) -> Column:
        codes, counts = acc["codes"], acc["counts"]
        new, old = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0))
        n_new, n_old = F.get(counts, new - 1), F.when(old > 0, F.get(counts, old - 1)).otherwise(F.lit(0))
        total = acc["total"] + F.when(new == old, F.lit(0.0)).otherwise(x_log2_x(n_new + 1) - x_log2_x(n_new) + x_log2_x(n_old - 1) - x_log2_x(n_old))
        hot = (i >= window - 1) & (F.lit(most) - total / window >= bound - 1e-9)
        return F.struct(
            codes.alias("codes"),
            F.transform(counts, lambda c, k: c + F.when(k + 1 == new, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0)).alias("counts"),
            total.alias("total"),
            F.when(hot & (acc["last"] == 0), i - window + 1).otherwise(acc["first"]).alias("first"),
            F.when(hot, i + 1).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(codes.alias("codes"), F.transform(alphabet, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.char_length(word) - 1), start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def in_blocks(some: Column) -> Column:
    """Ascending disjoint spans in blocks (s, e, spans) of the square root of their number."""
    step = F.greatest(F.ceil(F.sqrt(F.size(some))).cast("int"), F.lit(1))
    block = lambda b: F.struct(F.get(b, 0)["s"].alias("s"), F.element_at(b, -1)["e"].alias("e"), b.alias("spans"))
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(some), step), lambda i: i < F.size(some)), lambda i: let(F.slice(some, i + 1, step), block))


def entropy_spans(found: Column, base: Column, allowed: list[str]) -> Column:
    """Spans of the entropy kinds among the candidates ``found`` (s, m) that hold no access or hex key (a key of these
    two kinds lies within one candidate) and meet no span of ``base``, which has the other ones ``in_blocks``."""
    meets = lambda b, x: (b["s"] < x["s"] + F.char_length(x["m"])) & (x["s"] < b["e"])
    suspect = F.filter(
        found,
        lambda x: x["m"].rlike("[0-9]")
        & ~F.rlike(x["m"], F.lit("|".join(f"(?:{p})" for p in [ACCESS, HEX])))
        & ~(F.rlike(x["m"], F.lit("|".join(f"(?:{p})" for p in allowed))) if allowed else F.lit(False))
        & ~F.exists(base, lambda b: meets(b, x) & F.exists(b["spans"], lambda one: meets(one, x))),
    )
    kind, bound = F.lit(None).cast("int"), F.lit(None).cast("double")

    def judged(x: Column) -> Column:
        k, b = kind, bound
        for i, (_, pattern, least) in reversed([*enumerate(ENTROPY_KINDS)]):
            k, b = F.when(x["m"].rlike(pattern), i + 3).otherwise(k), F.when(x["m"].rlike(pattern), least).otherwise(b)
        return F.struct(x["s"].alias("s"), k.alias("k"), hot_stretch(x["m"], b).alias("hot"))

    hot = F.filter(F.transform(suspect, judged), lambda x: x["hot"]["last"] > 0)
    return F.transform(hot, lambda x: F.struct((x["s"] + x["hot"]["first"]).alias("s"), x["k"].alias("k"), (x["s"] + x["hot"]["last"]).alias("e")))


def listed(found: Column) -> Column:
    """kind:start:end of all spans, comma-joined; an empty list gives an empty string."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str, allowed: list[str], base: str, every: str) -> DataFrame:
    """``docs`` with the arrays of spans under the names ``base`` and ``every``, which are free."""
    names = [f"`{c}`" for c in docs.columns]
    body, words = F.coalesce(F.col(text), F.lit("")), f"{every}-words"
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "word": CANDIDATE}
    out = docs.withColumn(words, F.struct(*[F.regexp_extract_all(body, F.lit(p), F.lit(0)).alias(n) for n, p in patterns.items()]))
    found = {n: F.col(f"`{words}`")[n] for n in patterns}
    some = F.size(found["assign"]) + F.size(found["access"]) + F.size(found["hex"]) > 0
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    assign = spans(F.filter(places(body, ASSIGN, found["assign"]), lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST), 0)
    keys = F.concat(assign, spans(places(body, ACCESS, found["access"]), 1), spans(places(body, HEX, found["hex"]), 2))
    out = out.withColumn(base, F.when(some, F.array_sort(keys)).otherwise(none))
    secret = lambda: F.filter(F.col(f"`{base}`"), lambda x: x["k"] == 0)
    more = let(let(secret(), in_blocks), lambda b: entropy_spans(places(body, CANDIDATE, found["word"]), b, allowed))
    out = out.withColumn(every, F.when(F.exists(found["word"], lambda w: w.rlike("[0-9]")), more).otherwise(none))
    both = F.when(F.size(F.col(f"`{every}`")) > 0, F.array_sort(F.concat(F.col(f"`{base}`"), F.col(f"`{every}`")))).otherwise(F.col(f"`{base}`"))
    return out.withColumn(every, both).select(*names, f"`{base}`", f"`{every}`")


def find_secrets(docs: DataFrame, text: str = "text", allowed: list[str] | None = None) -> DataFrame:
    """Adds ``base_spans`` and ``all_spans``, arrays of (s, k, e) by start then kind, where k counts in KINDS."""
    return with_spans(docs.drop("base_spans", "all_spans"), text, ALLOWED if allowed is None else allowed, "base_spans", "all_spans")


def redacted(text: Column, found: Column, mark: str = MARK) -> Column:
    """The text with every stretch covered by spans (sorted by start) replaced by one mark.

    The fold cuts from a stretch of the text and adds to a string of about ``STRETCH`` characters, so that a step costs
    no more in a long text; finished strings are joined at the end.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("base"), F.lit("").alias("part"))

    def cut(acc: Column, x: Column) -> Column:
        over = x["s"] - acc["base"] > F.char_length(acc["part"])
        here = F.struct(F.when(over, acc["at"]).otherwise(acc["base"]).alias("base"), F.when(over, F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(STRETCH)))).otherwise(acc["part"]).alias("part"))

        def fresh(h: Column) -> Column:
            added = F.concat(F.substring(h["part"], acc["at"] - h["base"] + 1, x["s"] - acc["at"]), F.lit(mark))
            return F.struct(
                F.when(over, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"]).alias("done"),
                F.when(over, added).otherwise(F.concat(acc["out"], added)).alias("out"),
                x["e"].alias("at"),
                h["base"].alias("base"),
                h["part"].alias("part"),
            )

        longer = F.struct(acc["done"], acc["out"], F.greatest(acc["at"], x["e"]).alias("at"), acc["base"], acc["part"])
        return F.when(x["s"] >= acc["at"], let(here, fresh)).otherwise(longer)

    folded = F.aggregate(found, start, cut, lambda acc: F.concat(F.array_join(acc["done"], ""), acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(found) > 0, folded).otherwise(text)


def redact(docs: DataFrame, text: str = "text", allowed: list[str] | None = None) -> DataFrame:
    """``docs`` with the secrets in its texts masked, and nothing else changed; a null text becomes empty."""
    base, every = (f"{k}-{uuid.uuid4().hex}" for k in ("base", "every"))
    out = with_spans(docs, text, ALLOWED if allowed is None else allowed, base, every)
    clean = redacted(F.coalesce(F.col(text), F.lit("")), F.col(f"`{every}`"))
    return out.select(*[(clean.alias(text) if c == text else F.col(f"`{c}`")) for c in docs.columns])
