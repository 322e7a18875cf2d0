"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates go but for one, secrets are masked, and
what is left is packed into sequences.

Every stage takes all that the one before kept and, but for the last, returns the columns of ``documents``, whatever
else they are called; ``n_chars`` follows the text. A document all of whose words stand in lines that go is dropped with
them, as other documents hold all that it said; one that was blank before stays. Nulls and edge cases are those of the
operators in ``tessera.llm``: a null text counts as empty, rows without a doc_id take part in no comparison and stay,
and of rows that share a doc_id each is judged by its own text. Of rows that are equal the near-duplicate stage keeps
one. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lines, neardup, packing, secrets, toxicity
from tessera.llm.common import forget, stored, table


def _with_text_of(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, and n_chars of its own texts."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return changed.select(*[f"`{c}`" for c in docs.columns])


def _blank() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).rlike(r"^\s*$")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn_machine(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = f"blank-{uuid.uuid4().hex}"
    changed = lines.dedup_lines(docs.withColumn(before, _blank()), counts=False)
    return _with_text_of(docs, changed.where(F.col(f"`{before}`") | ~_blank()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text_of(docs, secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Neither the learned model nor the tokens can be had in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written:
            forget(before)
        written = True
    return docs
