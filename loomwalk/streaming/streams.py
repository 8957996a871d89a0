"""Structured Streaming: an extension; the batch forms of windows and buffers are in the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def jsonl_stream(spark: SparkSession, path: str, schema: T.StructType | str, *, files_per_batch: int = 100) -> DataFrame:
    """JSON lines as they arrive in a folder; a batch takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def dedup_stream(stream: DataFrame, *, time_col: str, text_col: str = "text", delay: str = "1 hour") -> DataFrame:
    """``stream`` without texts that came before within the watermark; state is a hash for each text and expires with it."""
    key = F.md5(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\s+", ""))
    return stream.withColumn("content_hash", key).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def on_time(stream: DataFrame, *, expected_col: str, arrived_col: str, delta: str) -> DataFrame:
    """Rows that arrived no later than ten deltas after they were expected; later ones are skipped."""
    return stream.where(F.col(arrived_col) <= F.col(expected_col) + F.expr(f"10 * INTERVAL {delta}"))


def windowed_counts(stream: DataFrame, *, time_col: str, key_col: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(window start, key, n) over event time with a watermark."""
    n = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window), F.col(key_col).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("window.start").alias("start"), "key", "n")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on each micro-batch of what is there, and ends."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def buffer_shuffle(rows: DataFrame, size: int, *, pos_col: str = "pos", id_col: str = "doc_id", seed: str = "0") -> DataFrame:
    """``rows`` with (buffer, place): runs of ``size`` rows, each in the order of a seeded hash."""
    from pyspark.sql import Window as W

    b = rows.withColumn("buffer", F.floor(F.col(pos_col) / size).cast("long"))
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))
    return b.withColumn("place", F.row_number().over(W.partitionBy("buffer").orderBy(key, id_col)).cast("long") - 1)
