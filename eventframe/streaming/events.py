"""Streams: windowed aggregates with watermarks, sessions, deduplication, and histograms that grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.hist import Axis


def read_events(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def timed(df: DataFrame, time: str = "ts") -> DataFrame:
    """Times without a zone are UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Count (and sum) in windows; works alike on tables and streams."""
    sums = [F.sum(value).alias("total")] if value else []
    return df.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), *sums)


def sliding(df: DataFrame, time: str, width: str, slide: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n"))


def session_windows(df: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def growing_histogram(df: DataFrame, axis, value: Column) -> DataFrame:
    """Bin contents so far, of a table or a stream (complete mode)."""
    return df.groupBy(Axis.of(axis).bin(value).alias("bx")).agg(F.count("*").alias("n"), F.sum(value).alias("wx"))


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and return the result table, stored below ``folder``.

    Each batch has a folder of its own, written whole, so a batch that is run
    again after a failure replaces itself. In complete mode the last one counts.
    """
    spark, done = stream.sparkSession, []

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        done.append(f"{folder}/{number}")

    query = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(done[-1:] if mode == "complete" else done))
