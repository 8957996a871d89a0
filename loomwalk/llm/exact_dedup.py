"""Exact deduplication by a 128-bit content hash with byte comparison inside groups; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BITS, cut, maybe_in


def _normal(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def content_hash(normal: Column) -> Column:
    return F.unhex(F.md5(normal.cast("binary")))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = content_hash, bitmap_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256, n_code_points).

    Texts are equal when they have the same bytes once ASCII white space is deleted.  Of equal texts the row
    with the most code points in the original stays, then the smallest id.  Null texts count as empty; empty
    texts are equal to each other.  A null id sorts before all others.  Rows that repeat an id and a text
    are flagged alike (their copies count in ``group_size``).  Other columns are ignored; an empty table
    gives no rows.

    Plan: (1) a scan leaves (id, hash, digest, length) per row; (2) hashes that occur more than once become
    a bitmap of bounded size; (3) only rows whose hash is in it bring their text to the byte comparison, which is
    a hash aggregate on (hash, normalised text) and so collapses copies before the shuffle; (4) groups join back
    on the hash.  Where two texts share a hash, rows are told apart by the text itself.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("id", F.length("t").alias("len"), _normal(F.col("t")).alias("n"))
    hashed = base.select("id", "len", "n", hash_fn(F.col("n")).alias("h"))
    rows = cut(hashed.select("id", "len", "h", F.sha2(F.col("n").cast("binary"), 256).alias("sha")), "exact-rows")
    multi = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "exact-multi")
    near = maybe_in(hashed, F.col("h"), multi, F.col("h"), most_bits=bitmap_bits)
    texts = near.groupBy("h", "n").agg(F.count(F.lit(1)).alias("c"))
    clash = cut(texts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "exact-clash")
    if clash.isEmpty():
        rows = rows.withColumn("sub", F.lit(None).cast("string"))
    else:  # different texts under one hash: the text is the key of those rows
        apart = hashed.join(clash, "h", "left_semi").select("id", "len", "h", F.sha2(F.col("n").cast("binary"), 256).alias("sha"), F.col("n").alias("sub"))
        rows = rows.join(clash, "h", "left_anti").select("id", "len", "h", "sha", F.lit(None).cast("string").alias("sub")).unionByName(apart)
    groups = (
        rows.join(multi, "h", "left_semi")
        .groupBy("h", "sub")
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("len")).alias("l"), F.col("id"))).alias("best"))
        .select(F.col("h").alias("gh"), F.col("sub").alias("gsub"), "size", F.col("best.id").alias("best"), F.lit(True).alias("many"))
    )
    out = rows.join(groups, (F.col("h") == F.col("gh")) & F.col("sub").eqNullSafe(F.col("gsub")), "left")
    keep = F.when(F.col("many"), F.col("best")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("len").cast("long").alias("n_code_points"),
    )
