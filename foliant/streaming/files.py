"""Folders that documents arrive in, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators import retrieval


def documents(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 64) -> DataFrame:
    """A stream of the Parquet files that come into ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def paragraphs(stream: DataFrame) -> DataFrame:
    """Paragraphs of each document as it comes; no state is kept."""
    return retrieval.paragraphs(stream)


def rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events a second by kind and window of event time; rows later than ``late`` are dropped, and so is the state of closed windows."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n", (F.col("n") / seconds).alias("per_second"))


def once_each(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
