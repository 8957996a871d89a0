"""Counts, quantiles and accounting checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import numbered, running_sum


def shard_offsets(docs: DataFrame, *, shard_col: str) -> DataFrame:
    """(shard, n, first): rows of each shard and the number of rows in the shards before it."""
    n = docs.groupBy(F.col(shard_col).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(n, F.col("n"), "shard", out="first")


def doc_lists(docs: DataFrame, *, shard_col: str, id_col: str = "doc_id") -> DataFrame:
    """(shard, ids): the sorted ids of each shard."""
    return docs.groupBy(F.col(shard_col).alias("shard")).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def exclusive_quantiles(values: DataFrame, cuts: list[int], *, n: int = 100, value_col: str = "n", key_col: str = "cluster_id") -> DataFrame:
    """(cut, value): the cut points of ``n`` equal parts by the exclusive method: position ``i * (count + 1) / n``, kept inside the data, with interpolation.

    Ranks are running numbers of the sorted values; only the ranks next to a cut are kept."""
    placed = numbered(values.select(F.col(value_col).cast("double").alias("v"), F.col(key_col).alias("k")), "v", "k", out="r")
    total = placed.agg(F.count(F.lit(1)).alias("m"))
    want = values.sparkSession.createDataFrame([(c,) for c in cuts], "cut int").crossJoin(F.broadcast(total))  # one row for each cut
    j = F.least(F.greatest(F.floor(F.col("cut") * (F.col("m") + 1) / n), F.lit(1)), F.col("m") - 1)
    want = want.withColumn("j", j).withColumn("delta", F.col("cut") * (F.col("m") + 1) - F.col("j") * n)
    low, high = placed.select(F.col("r").alias("rl"), F.col("v").alias("vl")), placed.select(F.col("r").alias("rh"), F.col("v").alias("vh"))
    out = want.join(low, F.col("rl") == F.col("j") - 1).join(high, F.col("rh") == F.col("j"))
    return out.select("cut", F.round((F.col("vl") * (n - F.col("delta")) + F.col("vh") * F.col("delta")) / n, 6).alias("value"))


def cluster_totals(sizes: DataFrame, *, cap: int) -> DataFrame:
    return sizes.agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") >= cap).alias("n_full"), F.round(F.avg("n"), 6).alias("mean_size"))


def accounting(workers: DataFrame, *, expected_col: str = "num_chunks", done_col: str = "processed") -> DataFrame:
    """One row (workers, expected, processed, ok): whether all workers expect the same total and together have done it."""
    out = workers.agg(F.count(F.lit(1)).alias("workers"), F.min(expected_col).alias("expected"), F.max(expected_col).alias("__most"), F.sum(done_col).alias("processed"))
    return out.select("workers", "expected", "processed", ((F.col("expected") == F.col("__most")) & (F.col("processed") == F.col("expected"))).alias("ok"))


def perplexity(losses: DataFrame, *, loss_col: str = "loss") -> DataFrame:
    return losses.agg(F.round(F.avg(loss_col), 6).alias("mean_loss"), F.round(F.exp(F.avg(loss_col)), 6).alias("perplexity"))


def index_check(index: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
    """One row (n, low, high, distinct, dense): whether the ids are 0..n-1, each once."""
    out = index.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("high"), F.countDistinct(id_col).alias("distinct"))
    return out.withColumn("dense", (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct") == F.col("n")))
