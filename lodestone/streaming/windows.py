"""Streams: tumbling windows, and the learner of co-occurring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(df: DataFrame, time: str, width: str = "1 hour", keys=(), late: str | None = None, aggregates=None) -> DataFrame:
    """Counts by window and keys, of a table or a stream; late: how long a stream waits for late records."""
    if late and df.isStreaming:
        df = df.withWatermark(time, late)
    got = df.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (aggregates or {}).items()])
    return got.select(F.col("window.start").alias("start"), *keys, "n", *(aggregates or {}))


def sessions(df: DataFrame, time: str, gap: str, keys) -> DataFrame:
    """Counts by session, which ends when nothing comes for the gap."""
    got = df.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def learn(stream: DataFrame, session: str, order: str, item: str, path: str, checkpoint: str):
    """Adds each batch's co-occurrences to the table under path, a folder for each batch, so a batch that is run again replaces its own."""
    from ..operators.index import learn_pairs

    def add(batch: DataFrame, number: int) -> None:
        learn_pairs(batch, session, order, item).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("item", "next").agg(F.sum("n").alias("n"))
