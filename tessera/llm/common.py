"""What the training-data operators share: tables, the shared scratch folder and Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.cluster import ship

#: Rows and bytes of an Arrow batch handed to Python.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_own_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch for this session (never raises a smaller bound of rows)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only in local mode without it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
    return f"file://{_own_scratch[app]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and a lost executor costs nothing.

    The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        where.getFileSystem(hadoop).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hand freed memory to the system: a Python worker stays, and its next task may need it less than the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    arrow_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(work, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def spans_of_bytes(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``texts`` with about ``limit`` characters each, one text at least."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
