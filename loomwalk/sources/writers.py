"""Writers of ordered shards, logs and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import slices


def ordered_shards(docs: DataFrame, path: str, parts: int = 32, *, pos_col: str = "out_pos") -> None:
    """JSON lines in ``slice=NN`` folders, one file each, in the order of ``pos_col``; there may be one folder more than ``parts``."""
    cut = slices(docs, parts, pos_col=pos_col)
    dealt = cut.repartition(parts + 1, "slice").sortWithinPartitions("slice", pos_col)
    dealt.write.partitionBy("slice").mode("overwrite").json(path)


def json_batches(docs: DataFrame, path: str, *, rows: int = 100_000, compression: str = "gzip") -> None:
    """Compressed JSON files of at most ``rows`` rows."""
    docs.write.option("maxRecordsPerFile", rows).option("compression", compression).mode("overwrite").json(path)


def rolling_log(rows: DataFrame, path: str, *, size: int = 4096) -> None:
    """Log files that roll over after ``size`` records."""
    json_batches(rows, path, rows=size, compression="none")


def record_shards(rows: DataFrame, path: str, size: int, *, pos_col: str = "pos") -> None:
    """Parquet in ``shard=N`` folders of ``size`` consecutive records."""
    rows.withColumn("shard", F.floor(F.col(pos_col) / size).cast("long")).repartition("shard").sortWithinPartitions("shard", pos_col).write.partitionBy("shard").mode("overwrite").parquet(path)


def statistics(row: DataFrame, path: str) -> None:
    """One row as a JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def capacity(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, or an error if there are more than ``most``."""
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows exceed the capacity of {most}")
    return rows
