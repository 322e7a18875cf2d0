"""Op 6, line dedup: explode normalised lines, hash, count documents per hash, drop, and reassemble by position.

The hashes of all lines are computed once and stored, with their positions. Documents are counted for each hash and salt
of doc_id first, so a line that a third of the rows hold is counted, and later met, in ``SALTS`` places. A hash over
the threshold names its smallest document; every other row that holds it collects the positions that it must lose, and
keeps what lies between them. Only hashes and ids are shuffled for that; a text moves once, to meet its positions.

Nulls and edge cases: a null or empty text is one empty line. A row without a ``doc_id`` takes no part and keeps all
its lines. Rows that share a ``doc_id`` are one document: they count once, and lose the same lines. Long texts take time
in proportion to their lines. Without rows there are none. Columns of whatever name stay, but for n_lines and n_dropped,
which are replaced where the counts are asked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: What is stripped from the ends of a line.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS = 10
MIN_DOCS = 2
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped, with A-Z lower-cased. ``lower`` is faster and the same where every character is one byte."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def key_hash(key: Column) -> Column:
    """128 bits, as two words."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row (doc_id, t, at, a, b, salt) for each line whose key is long enough; t is a hash of the text, at the position.

    Rows of one doc_id with different texts are told apart by t.
    """
    key = F.col("key")
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("t"), lines_of(F.col("text")).alias("lines"))  # below the explode: once a text
        .select("doc_id", "t", F.posexplode("lines").alias("at", "line"))
        .select("doc_id", "t", "at", line_key(F.col("line")).alias("key"))
        .where(F.char_length(key) >= min_chars)
        .select("doc_id", "t", "at", key_hash(key).alias("h"))
        .select("doc_id", "t", "at", "h.a", "h.b", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    )


def repeated(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, salt, first_doc): the hashes that ``min_docs`` documents hold, the salts of these, and the smallest of them."""
    parts = hashes.groupBy("a", "b", "salt").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("least"))
    whole = parts.groupBy("a", "b").agg(F.sum("n").alias("n_docs"), F.min("least").alias("first_doc"), F.collect_list("salt").alias("salts"))
    return whole.where(F.col("n_docs") >= min_docs).select("a", "b", F.explode("salts").alias("salt"), "first_doc")


def without(lines: Column, lost: Column) -> Column:
    """``lines`` but for the positions ``lost`` (ascending, from 0): what lies between one lost position and the next."""
    ends = F.concat(lost, F.array(F.size(lines)))
    gaps = F.filter(F.zip_with(F.concat(F.array(F.lit(-1)), lost), ends, lambda x, y: F.struct((x + 1).alias("first"), (y - 1).alias("last"))), lambda g: g["first"] <= g["last"])
    return F.get(F.transform(F.array(lines), lambda all: F.flatten(F.transform(gaps, lambda g: F.transform(F.sequence(g["first"], g["last"]), lambda i: F.get(all, i))))), 0)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` reduced to the kept lines, and with ``counts`` n_lines and n_dropped added."""
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    hashes = stored(line_hashes(docs.select("doc_id", "text"), min_chars), "line-hashes")
    lost, own, t = (f"{k}-{uuid.uuid4().hex}" for k in ("lost", "doc", "t"))
    losing = (
        hashes.join(repeated(hashes, min_docs), ["a", "b", "salt"])
        .where(F.col("doc_id") != F.col("first_doc"))
        .groupBy(F.col("doc_id").alias(own), F.col("t").alias(t))
        .agg(F.array_sort(F.collect_set("at")).alias(lost))
    )
    lines, gone = lines_of(F.col("text")), F.col(f"`{lost}`")
    out = docs.join(losing, (F.col("doc_id") == F.col(f"`{own}`")) & (F.xxhash64("text") == F.col(f"`{t}`")), "left")
    names = {c: F.col(f"`{c}`") for c in docs.columns}
    if counts:
        names |= {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    names["text"] = F.when(gone.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(without(lines, gone), "\n"))
    return out.select(*[c.alias(k) for k, c in names.items()])
