"""The shared folder, lineage cuts and global row numbers."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a folder of our own only where that is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (where or "file:///tmp/checkpoints/loomwalk").rstrip("/")


def cleanup() -> None:
    """Deletes every table that this driver has written to the shared folder."""
    while _made:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit
            return


def fresh_path(spark: SparkSession, name: str) -> str:
    if not _made:
        atexit.register(cleanup)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that its lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that rows of many vectors cannot fill a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ranges(df: DataFrame, *order: str, name: str = "ranges") -> DataFrame:
    """``df`` dealt out by ranges of ``order``, with the range's number in ``__range``; written out, so that the ranges stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), name)


def running_sum(df: DataFrame, value: Column, *order: str, out: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come before in ``order``, which must be unique.

    No window spans the table: sums run inside ranges, and the totals of the ranges, one row each, are added to them.
    """
    placed = ranges(df.withColumn("__value", value.cast("long")), *order)
    totals = placed.groupBy("__range").agg(F.sum("__value").alias("t"))
    before = totals.select("__range", F.coalesce(F.sum("t").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum("__value").over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each range: as many as there are partitions.
    return placed.withColumn(out, inside).join(F.broadcast(before), "__range").withColumn(out, F.col(out) + F.col("__base")).drop("__range", "__base", "__value")


def numbered(df: DataFrame, *order: str, out: str = "pos") -> DataFrame:
    """``df`` with the 0-based number of each row in ``order``, which must be unique."""
    return running_sum(df, F.lit(1), *order, out=out)
