"""Training examples: chunks joined with their neighbours and the neighbours' continuations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A


def last_flags(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, is_last): whether a chunk is the last one of its document."""
    following = F.lead("chunk_id").over(W.partitionBy("doc_id").orderBy("chunk_id"))
    return chunks.select("chunk_id", "doc_id", following.isNull().alias("is_last"))


def with_continuation(chunks: DataFrame, *, chunk: int) -> DataFrame:
    """(chunk_id, doc_id, tokens, continuation): the next chunk of the same document, or pads."""
    following = F.lead("tokens").over(W.partitionBy("doc_id").orderBy("chunk_id"))
    return chunks.select("chunk_id", "doc_id", "tokens", F.coalesce(following, A.repeat(A.PAD, F.lit(chunk))).alias("continuation"))


def keep_foreign(knn: DataFrame, chunks: DataFrame, k: int, *, mask: bool = True) -> DataFrame:
    """(q, rank, n): of (q, rank, n), the first ``k`` whose document is another one; fewer are allowed.  Without ``mask`` (a reference index) the first ``k``."""
    of = chunks.select("chunk_id", "doc_id")
    rows = knn.join(of.select(F.col("chunk_id").alias("n"), F.col("doc_id").alias("dn")), "n")
    if mask:
        rows = rows.join(of.select(F.col("chunk_id").alias("q"), F.col("doc_id").alias("dq")), "q").where("dq <> dn")
    order = F.row_number().over(W.partitionBy("q").orderBy("rank"))
    return rows.withColumn("slot", order).where(F.col("slot") <= k).select("q", F.col("slot").alias("rank"), "n")


def neighbour_tokens(knn: DataFrame, chunks: DataFrame, *, chunk: int) -> DataFrame:
    """(chunk_id, rank, neighbour_id, neighbour, continuation) of neighbour lists (q, rank, n)."""
    rich = with_continuation(chunks, chunk=chunk).select(F.col("chunk_id").alias("n"), F.col("tokens").alias("neighbour"), "continuation")
    return knn.join(rich, "n").select(F.col("q").alias("chunk_id"), "rank", F.col("n").alias("neighbour_id"), "neighbour", "continuation")


def retrieved_blocks(knn: DataFrame, chunks: DataFrame, k: int, *, chunk: int) -> DataFrame:
    """(chunk_id, retrieved): for every chunk, ``k`` rows of neighbour and continuation in the order of ranks; missing ones are pads."""
    rows = neighbour_tokens(knn, chunks, chunk=chunk).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("neighbour", "continuation").alias("t")))).alias("x"))
    full = chunks.select("chunk_id").join(rows, "chunk_id", "left").withColumn("r", F.coalesce("x.t", F.array().cast("array<array<int>>")))
    pads = F.array_repeat(A.repeat(A.PAD, F.lit(2 * chunk)), F.lit(k) - F.size("r"))
    return full.select("chunk_id", F.concat("r", pads).alias("retrieved"))


def masked_blocks(knn: DataFrame, chunks: DataFrame, k: int, *, chunk: int, eos: int) -> DataFrame:
    """(chunk_id, retrieved): as ``retrieved_blocks``, but the continuation is chunk ``n + 1`` whatever its document (the last chunk itself at the end), and
    what comes after an ``eos`` is masked."""
    last = chunks.agg(F.max("chunk_id").alias("last"))
    pairs = knn.join(F.broadcast(last)).withColumn("m", F.least(F.col("n") + 1, F.col("last")))
    toks = chunks.select("chunk_id", "tokens")
    rows = pairs.join(toks.select(F.col("chunk_id").alias("n"), F.col("tokens").alias("a")), "n").join(toks.select(F.col("chunk_id").alias("m"), F.col("tokens").alias("b")), "m")
    masked = rows.select(F.col("q").alias("chunk_id"), "rank", A.mask_after(F.concat("a", "b"), eos).alias("t"))
    got = masked.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("x"))
    full = chunks.select("chunk_id").join(got, "chunk_id", "left").withColumn("r", F.coalesce("x.t", F.array().cast("array<array<int>>")))
    return full.select("chunk_id", F.concat("r", F.array_repeat(A.repeat(A.PAD, F.lit(2 * chunk)), F.lit(k) - F.size("r"))).alias("retrieved"))


def sequences(starts: DataFrame, chunks: DataFrame, *, per_sequence: int, chunk: int, eos: int) -> DataFrame:
    """(begin_chunk, tokens): the tokens of ``per_sequence`` chunks from each start, the id after the last one, and nothing after an ``eos``.

    Chunks past the end are pads.  An equi-join: each start names its chunks.
    """
    want = starts.select("begin_chunk", F.posexplode(F.sequence(F.col("begin_chunk"), F.col("begin_chunk") + per_sequence - 1)).alias("slot", "chunk_id"))
    have = want.join(chunks.select("chunk_id", "tokens", "next_token"), "chunk_id", "left")
    pads = A.repeat(A.PAD, F.lit(chunk))
    rows = have.select("begin_chunk", F.struct("slot", F.coalesce("tokens", pads).alias("t"), F.coalesce("next_token", F.lit(A.PAD)).alias("nx")).alias("s"))
    seqs = rows.groupBy("begin_chunk").agg(F.array_sort(F.collect_list("s")).alias("x"))
    whole = F.concat(F.flatten("x.t"), F.array(F.element_at("x", -1)["nx"]))
    return seqs.select("begin_chunk", A.mask_after(whole, eos).alias("tokens"))


def examples(starts: DataFrame, chunks: DataFrame, knn: DataFrame, k: int, *, per_sequence: int, chunk: int, eos: int) -> DataFrame:
    """(begin_chunk, tokens, retrieved): sequences with the retrieved blocks of their chunks."""
    seq = sequences(starts, chunks, per_sequence=per_sequence, chunk=chunk, eos=eos)
    blocks = masked_blocks(knn, chunks, k, chunk=chunk, eos=eos)
    want = starts.select("begin_chunk", F.posexplode(F.sequence(F.col("begin_chunk"), F.col("begin_chunk") + per_sequence - 1)).alias("slot", "chunk_id"))
    none = F.array_repeat(A.repeat(A.PAD, F.lit(2 * chunk)), F.lit(k))
    rows = want.join(blocks, "chunk_id", "left").select("begin_chunk", F.struct("slot", F.coalesce("retrieved", none).alias("r")).alias("s"))
    per = rows.groupBy("begin_chunk").agg(F.array_sort(F.collect_list("s")).alias("x")).select("begin_chunk", F.col("x.r").alias("retrieved"))
    return seq.join(per, "begin_chunk")


def split_sequences(starts: DataFrame, *, valid: float = 0.2, seed: str = "0") -> DataFrame:
    """(begin_chunk, split): the last ``int(valid * n)`` in the order of a seeded hash are for validation."""
    from ..storage import numbered

    n = starts.count()
    placed = numbered(starts.select("begin_chunk", F.md5(F.concat(F.col("begin_chunk").cast("string"), F.lit(seed))).alias("key")), "key", "begin_chunk", out="r")
    return placed.select("begin_chunk", F.when(F.col("r") >= n - int(valid * n), "valid").otherwise("train").alias("split"))


def lookup(starts: DataFrame, chunks: DataFrame, docs: DataFrame, knn: DataFrame) -> DataFrame:
    """(begin_chunk, doc_id, source, line, rank, neighbour_doc): where a sequence and its first chunk's neighbours come from.

    ``line`` is the 0-based number of the document in its source."""
    line = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    where = docs.select("doc_id", "source", line.cast("long").alias("line"))
    of = chunks.select("chunk_id", "doc_id")
    a = starts.select("begin_chunk").join(of.withColumnRenamed("chunk_id", "begin_chunk"), "begin_chunk").join(where, "doc_id")
    b = knn.join(of.select(F.col("chunk_id").alias("n"), F.col("doc_id").alias("neighbour_doc")), "n").select(F.col("q").alias("begin_chunk"), "rank", "neighbour_doc")
    return a.join(b, "begin_chunk").select("begin_chunk", "doc_id", "source", "line", "rank", "neighbour_doc")
