"""Lookups of documents and neighbour lists, joins by range and by place, and retrieval for new queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import numbered
from .knn import exact_knn

#: Neighbour lists of so many queries share a folder.
SHARD_ROWS = 50_000_000


def by_id(rows: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among ``wanted``: an equi-join, whose smaller side the optimizer broadcasts where its size allows."""
    return rows.join(wanted.select(id_col).dropDuplicates(), id_col, "left_semi")


def write_knn(knn: DataFrame, path: str, *, rows_per_shard: int = SHARD_ROWS) -> None:
    """(q, rank, n, ...) as Parquet in ``shard=N`` folders of consecutive queries."""
    shard = F.floor(F.col("q") / rows_per_shard).cast("long")
    knn.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "q", "rank").write.partitionBy("shard").mode("overwrite").parquet(path)


def lookup_knn(spark: SparkSession, path: str, wanted: DataFrame, *, rows_per_shard: int = SHARD_ROWS) -> DataFrame:
    """The neighbour lists of the queries ``wanted`` (q).  Only their shards are read: the shard is part of the join, and partitions are pruned by it."""
    asked = wanted.select("q").dropDuplicates().withColumn("shard", F.floor(F.col("q") / rows_per_shard).cast("long"))
    return spark.read.parquet(path).join(asked, ["shard", "q"], "left_semi").drop("shard")


def in_ranges(rows: DataFrame, ranges: DataFrame, *, value_col: str, width: int) -> DataFrame:
    """``rows`` with the columns of the range [low, high) that holds ``value_col``, if any.  Ranges don't overlap; ``width`` is about the size of one.

    Values and ranges meet in cells of ``width``, so that the join is by equality; a range of any length is in the cells that it touches."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    last = F.floor((F.col("high") - 1) / width).cast("long")
    dealt = ranges.where("high > low").withColumn("__cell", F.explode(F.sequence(cell("low"), last)))
    return rows.withColumn("__cell", cell(value_col)).join(dealt, "__cell").where((F.col(value_col) >= F.col("low")) & (F.col(value_col) < F.col("high"))).drop("__cell")


def zip_rows(left: DataFrame, right: DataFrame, *, left_order: str, right_order: str) -> DataFrame:
    """The columns of both tables side by side, row by row in their orders; as many rows as the shorter one has, and ``pos`` from 0."""
    return numbered(left, left_order).join(numbered(right, right_order), "pos")


def retrieve(queries: DataFrame, index: DataFrame, docs: DataFrame, k: int, *, id_col: str = "doc_id", **how) -> DataFrame:
    """(q, rank, score, and the columns of ``docs``) of the ``k`` nearest documents of new queries (vec_id, embedding)."""
    found = exact_knn(queries, index, k, same_id=False, **how)
    return found.join(docs.withColumnRenamed(id_col, "n"), "n").withColumnRenamed("n", id_col)


def map_flattened(rows: DataFrame, work: Callable[[pd.Series], pd.Series], kind: str, *, id_col: str, items_col: str, out_col: str = "results") -> DataFrame:
    """(id, results): the items of each row go one by one, in batches that run across rows, through ``work``; results come back in the order of the items.

    Rows without items have none.  ``work`` gets and returns a series; ``kind`` is the type of a result."""
    flat = rows.select(id_col, F.posexplode(items_col).alias("__pos", "__item"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, __pos int, __result {kind}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[[id_col, "__pos"]].copy()
            out["__result"] = work(f["__item"])
            yield out

    done = flat.mapInPandas(run, schema).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__pos", "__result"))).alias("__x"))
    empty = F.array().cast(f"array<{kind}>")
    return rows.select(id_col).join(done.select(id_col, F.col("__x.__result").alias(out_col)), id_col, "left").withColumn(out_col, F.coalesce(out_col, empty))


def prune(rows: DataFrame, signature: list[str]) -> DataFrame:
    """The columns that ``signature`` names, in the order of the table."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c in set(signature)])


def narrow_ids(rows: DataFrame, *, vocabulary: int, tokens_col: str = "tokens") -> DataFrame:
    """``rows`` with token ids as 16-bit numbers where the vocabulary allows; ids from 32768 on are stored less 65536."""
    if vocabulary > 1 << 16:
        return rows
    return rows.withColumn(tokens_col, F.transform(tokens_col, lambda x: F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x).cast("smallint")))


def span_pairs(rows: DataFrame, *, threshold: float, id_col: str = "id") -> DataFrame:
    """(id, start, end, score) of (id, start_score, end_score: arrays): places start < end whose product is at least ``threshold``."""
    s = rows.select(id_col, "end_score", F.posexplode("start_score").alias("start", "s"))
    p = s.select(id_col, "start", "s", F.posexplode("end_score").alias("end", "e")).where("start < end")
    return p.select(id_col, "start", "end", F.round(F.col("s").cast("double") * F.col("e").cast("double"), 6).alias("score")).where(F.col("score") >= threshold)
