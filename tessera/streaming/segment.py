"""Segmentation of streams. It is a map over rows without state, so the batch plan runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.analyzer import Analyzer
from tessera.types import TokenizeOptions


def tokenize_stream(analyzer: Analyzer, stream: DataFrame, text: str = "text", opts: TokenizeOptions | None = None) -> DataFrame:
    """The stream with its morphemes; a faulty text gives a null result and its fault, and the stream goes on."""
    return analyzer.tokenize(stream, text, opts=opts, on_error="column")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet files exactly once, as far as there is input."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
