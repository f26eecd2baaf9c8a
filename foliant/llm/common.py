"""What the training-data operators share: tables, durable intermediate results, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoints go to a folder which all executors see.

    The folder the cluster names in ``spark.checkpoint.dir`` is used as it is. Where it is unset, a
    local session (as in tests) takes a temporary folder. A cluster has to name one: a folder of one machine
    would lose what the others wrote.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="foliant-")
    context.setCheckpointDir(named)


def durable(df: DataFrame) -> DataFrame:
    """Computes ``df`` once, into the shared folder; later reads survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a compressed table in the shared folder (in folders ``by`` columns), and a function that deletes it once nothing reads it any more.

    For large intermediate results, which ``durable`` would write uncompressed.
    """
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)

    def drop() -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), drop


def small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df`` as a local table, which Spark then knows the size of and broadcasts, if it has up to ``limit`` rows; else as it is."""
    rows = df.limit(limit + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= limit else df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more, as after ``durable``, and executors give back heap.

    A heap that a sort or a shuffle has filled stays with its executor, beside the Python workers of what comes next; a full collection
    shrinks it. A task for each core asks for one, which reaches most executors and changes no result where it doesn't.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def trim() -> None:
    """Gives the memory that a finished task held back to the system: Python workers outlive their tasks, and wait beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bounds the rows and the bytes that go to a Python worker at once, so that long texts don't pile up there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null reads as the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z and leaves every other code point alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def rows_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
