"""Chat formatting with collapse of cumulative snapshots; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, maybe_in


def collapse_and_render(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: (conv_id, n_turns, n_copies, rendered).

    Each conversation gets, for every prefix of its turns, a rolling 128-bit hash: the xor of position-salted turn
    hashes.  A conversation whose full hash is a proper prefix hash of another one is a snapshot and goes; of
    conversations with the same turns the smallest id stays and ``n_copies`` counts them.  What stays is
    rendered as ``<|role|>\\ntext<|end|>\\n`` per turn.

    Turns are ordered by (turn, role, text), nulls first; a null role or text renders as empty, but
    is not equal to an empty one.  Rows that repeat a turn exactly count once.  Rows with a null conversation id form one
    conversation.  Other columns are ignored; an empty table gives no rows.

    The hashing stage shuffles 16-byte digests, never text; text moves once, for maximal conversations only.  A common
    first turn or conversation is a common hash, which partial aggregation collapses before the shuffle.
    """
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    digest = base.select("conv", "turn", F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.hex(F.encode("role", "UTF-8")), F.lit("-")), F.coalesce(F.col("text"), F.lit("-")), F.col("text").isNull().cast("string")))).alias("d"), "role", "text")
    order = W.partitionBy("conv").orderBy(F.col("turn"), F.col("role"), F.col("d"))
    small = digest.select("conv", "turn", "role", "d").dropDuplicates()
    placed = small.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("conv")))
    run = order.rowsBetween(W.unboundedPreceding, 0)
    rolling = placed.select("conv", "n", "pos", F.bit_xor(F.xxhash64("pos", "d")).over(run).alias("p1"), F.bit_xor(F.xxhash64(F.lit(7), "d", "pos")).over(run).alias("p2"))
    rolling = cut(rolling, "chat-prefixes")
    full = rolling.where("pos = n").groupBy("n", "p1", "p2").agg(F.min("conv").alias("keep"), F.count(F.lit(1)).alias("copies"))
    prefixes = rolling.where("pos < n").groupBy("pos", "p1", "p2").agg(F.lit(1).alias("one")).select(F.col("pos").alias("n"), "p1", "p2")
    # A struct is never null, so that equal keys meet in one place, those of the null conversation among them.
    maximal = cut(full.join(prefixes, ["n", "p1", "p2"], "left_anti").select(F.struct(F.col("keep").alias("conv")).alias("key"), "n", "copies"), "chat-maximal")
    turn = F.struct(F.col("turn"), F.col("role"), F.col("d"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = digest.withColumn("key", F.struct("conv"))
    kept = maybe_in(keyed, F.xxhash64("conv"), maximal, F.xxhash64("key.conv")).join(maximal, "key")
    body = kept.groupBy("key").agg(F.first("n").alias("n"), F.first("copies").alias("copies"), F.array_sort(F.collect_set(turn)).alias("ts"))
    line = lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), x["text"], F.lit("<|end|>\n"))
    return body.select(F.col("key.conv").alias("conv_id"), F.col("n").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("n_copies"), F.array_join(F.transform("ts", line), "").alias("rendered"))
