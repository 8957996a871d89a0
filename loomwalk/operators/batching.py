"""Batches and orders for training."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import numbered


def hash_order(rows: DataFrame, *, id_col: str, seed: str = "0", out: str = "pos") -> DataFrame:
    """``rows`` with their place in a seeded shuffle: the order of a hash, ties by id."""
    return numbered(rows.withColumn("__key", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))), "__key", id_col, out=out).drop("__key")


def shuffle_take(rows: DataFrame, n: int, *, id_col: str, seed: str = "0") -> DataFrame:
    """The first ``n`` of a seeded shuffle, with their places: a top-n by hash, no full sort."""
    key = rows.withColumn("__key", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed))))
    top = key.orderBy("__key", id_col).limit(n)
    return top.withColumn("pos", F.row_number().over(W.orderBy("__key", id_col)).cast("long") - 1).drop("__key")


def sortish(rows: DataFrame, *, id_col: str, length_col: str, batch: int, seed: str = "0", pool: int = 50) -> DataFrame:
    """(id, bucket, batch, place): a seeded shuffle cut into pools of ``pool`` batches, sorted by falling length in each pool and cut into batches."""
    placed = hash_order(rows.select(id_col, length_col), id_col=id_col, seed=seed)
    bucket = placed.withColumn("bucket", F.floor(F.col("pos") / (pool * batch)).cast("long"))
    r = F.row_number().over(W.partitionBy("bucket").orderBy(F.col(length_col).desc(), id_col)) - 1
    return bucket.select(id_col, "bucket", F.floor(r / batch).cast("long").alias("batch"), (r % batch).cast("long").alias("place"))


def length_bin(length: Column, bins: list[int]) -> Column:
    """How many bins are no larger than the length."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bins]), lambda b: b <= length)).cast("long")


def grouped_batches(rows: DataFrame, *, id_col: str, group_col: str, batch: int) -> DataFrame:
    """(id, group, batch, place): full batches inside each group in the order of ids; what is left over forms batches in the order of groups.

    ``batch`` numbers the batches of a group; leftovers have group -1.  Places inside a group are running numbers, not a window over it."""
    placed = numbered(rows.select(F.col(id_col).alias("id"), F.col(group_col).cast("long").alias("group")), "group", "id", out="p")
    sizes = placed.groupBy("group").agg(F.min("p").alias("base"), F.count(F.lit(1)).alias("n"))
    inside = placed.join(sizes, "group").withColumn("r", F.col("p") - F.col("base"))
    full = F.floor(F.col("n") / batch) * batch
    whole = inside.where(F.col("r") < full).select("id", "group", F.floor(F.col("r") / batch).cast("long").alias("batch"), (F.col("r") % batch).cast("long").alias("place"))
    rest = numbered(inside.where(F.col("r") >= full).select("id", F.col("group").alias("g")), "g", "id", out="q")
    left = rest.select("id", F.lit(-1).cast("long").alias("group"), F.floor(F.col("q") / batch).cast("long").alias("batch"), (F.col("q") % batch).cast("long").alias("place"))
    return whole.unionByName(left)


def wraparound_shards(rows: DataFrame, shards: int, *, id_col: str) -> DataFrame:
    """(id, shard, place): the rows in turn, with the first ones again at the end so that all shards are equally long."""
    placed = numbered(rows.select(F.col(id_col).alias("id")), "id")
    n = placed.count()
    total = -(-n // shards) * shards
    again = placed.where(F.col("pos") < total - n).withColumn("pos", F.col("pos") + n)
    every = placed.unionByName(again)
    return every.select("id", (F.col("pos") % shards).alias("shard"), F.floor(F.col("pos") / shards).cast("long").alias("place"))


def full_batches(rows: DataFrame, batch: int, *, id_col: str) -> DataFrame:
    """(id, batch, place) of the batches that are full; a rest is dropped."""
    placed = numbered(rows.select(F.col(id_col).alias("id")), "id")
    n = placed.count()
    return placed.where(F.col("pos") < n - n % batch).select("id", F.floor(F.col("pos") / batch).cast("long").alias("batch"), (F.col("pos") % batch).alias("place"))


def contiguous_shards(rows: DataFrame, shards: int, *, id_col: str) -> DataFrame:
    """(id, shard): ``shards`` contiguous runs of nearly equal size, by id."""
    placed = numbered(rows.select(F.col(id_col).alias("id")), "id")
    n = max(1, placed.count())
    return placed.select("id", F.floor(F.col("pos") * shards / n).cast("long").alias("shard"))


def token_budget_batches(rows: DataFrame, *, id_col: str, length_col: str, budget: int, group_col: str) -> DataFrame:
    """(id, group, batch): by falling length, as many as keep ``longest * count`` within the budget; one group (a shard) at a time, in one sorted run."""
    dealt = rows.select(F.col(id_col).alias("id"), F.col(group_col).cast("long").alias("group"), F.col(length_col).cast("long").alias("n"))
    dealt = dealt.repartition("group").sortWithinPartitions("group", F.col("n").desc(), "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, most, held = None, 0, 0, 0
        for b in batches:
            out = []
            for g, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if g != now:
                    now, k, most, held = g, 0, n, 0
                elif held and max(most, n) * (held + 1) > budget:
                    k, most, held = k + 1, n, 0
                most, held = max(most, n), held + 1
                out.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["id", "group", "batch"])

    return dealt.mapInArrow(fold, "id long, group long, batch long")


def stop_flags(rows: DataFrame, *, max_length: int, max_new: int, max_time: float) -> DataFrame:
    """``rows`` (length, prompt_length, seconds) with (at_length, at_new, at_time, stop)."""
    out = rows.withColumns({"at_length": F.col("length") >= max_length, "at_new": F.col("length") - F.col("prompt_length") >= max_new, "at_time": F.col("seconds") > max_time})
    return out.withColumn("stop", F.col("at_length") | F.col("at_new") | F.col("at_time"))
