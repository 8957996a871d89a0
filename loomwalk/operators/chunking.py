"""Documents to fixed-width chunks, sequences, packs, passages and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..storage import running_sum

CHUNK, SEQUENCE = 64, 256


def n_chunks(tokens: Column, chunk: int) -> Column:
    """``floor((L - 1) / chunk) + 1``; a document without tokens has no chunks."""
    return F.when(F.size(tokens) > 0, F.floor((F.size(tokens) - 1) / chunk) + 1).otherwise(F.lit(0)).cast("int")


def doc_chunks(docs: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, chunk_ix, tokens, next_token) of (doc_id, tokens): chunks of ``chunk`` ids, padded, and the first id of the next chunk or the pad."""
    at = docs.where(F.size("tokens") > 0).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n_chunks(F.col("tokens"), chunk) - 1)).alias("chunk_ix"))
    piece = A.pad_right(F.slice("tokens", F.col("chunk_ix") * chunk + 1, F.lit(chunk)), chunk)
    return at.select("doc_id", "chunk_ix", piece.alias("tokens"), F.coalesce(F.get("tokens", (F.col("chunk_ix") + 1) * chunk), F.lit(A.PAD)).alias("next_token"))


def chunk_bases(docs: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chunks, chunk_base): the number of chunks of all documents before, by id."""
    n = docs.select("doc_id", n_chunks(F.col("tokens"), chunk).alias("n_chunks"))
    return running_sum(n, F.col("n_chunks"), "doc_id", out="chunk_base")


def corpus_chunks(docs: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(chunk_id, doc_id, chunk_ix, tokens, next_token) with ids that run over the corpus."""
    base = chunk_bases(docs, chunk=chunk).select("doc_id", "chunk_base")
    rows = doc_chunks(docs, chunk=chunk).join(base, "doc_id")
    return rows.select((F.col("chunk_base") + F.col("chunk_ix")).alias("chunk_id"), "doc_id", "chunk_ix", "tokens", "next_token")


def sequence_starts(docs: DataFrame, *, chunk: int = CHUNK, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, begin_chunk): the chunk at which each training sequence begins."""
    if sequence % chunk:
        raise ValueError("the sequence length must be a multiple of the chunk length")
    base = chunk_bases(docs, chunk=chunk).where("n_chunks > 0")
    step = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1, F.lit(sequence // chunk)))
    return base.select("doc_id", "chunk_base", step.alias("x")).select("doc_id", (F.col("chunk_base") + F.col("x")).alias("begin_chunk"))


def ranges_of(n: Column, size: int) -> Column:
    """Half-open ranges [begin, end) of ``size`` that cover 0..n; the last may be short."""
    k = F.ceil(n / size).cast("int")
    cover = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.struct((i * size).cast("long").alias("begin"), F.least((i + 1) * size, n).cast("long").alias("end")))
    return F.when(k > 0, cover).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))


def pack_constant(docs: DataFrame, *, length: int, separator: int, group_col: str | None = None) -> DataFrame:
    """(group, pack, tokens): documents one after the other in the order of ids, each followed by ``separator``, cut to packs of ``length``; a rest is dropped.

    With ``group_col`` groups are packed apart.  Tokens are cut where they are: a document sends each pack its piece, never single tokens.
    """
    g = F.col(group_col) if group_col else F.lit(0)
    stream = docs.select(g.cast("long").alias("group"), "doc_id", F.concat("tokens", F.array(F.lit(separator))).alias("tokens"))
    placed = running_sum(stream.select("group", "doc_id", F.size("tokens").alias("n")), F.col("n"), "group", "doc_id", out="start")
    totals = placed.groupBy("group").agg(F.min("start").alias("base"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("total"))
    rows = stream.join(placed.select("group", "doc_id", "start"), ["group", "doc_id"]).join(totals, "group").withColumn("start", F.col("start") - F.col("base"))
    last = F.floor((F.col("start") + F.size("tokens") - 1) / length)
    pieces = rows.withColumn("pack", F.explode(F.sequence(F.floor(F.col("start") / length), last))).where((F.col("pack") + 1) * length <= F.col("total"))
    begin = F.greatest(F.col("pack") * length - F.col("start"), F.lit(0))
    end = F.least((F.col("pack") + 1) * length - F.col("start"), F.size("tokens"))
    cut = pieces.select("group", "pack", "start", F.slice("tokens", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    packed = cut.groupBy("group", "pack").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("x"))
    return packed.select("group", "pack", F.flatten("x.piece").alias("tokens"))


def passages(docs: DataFrame, *, words: int = 100, text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(doc_id, passage_ix, title, passage): ``words`` words each, split at single spaces; null texts are skipped, a null title is empty."""
    title = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    w = docs.where(F.col(text_col).isNotNull()).select("doc_id", title.alias("title"), F.split(text_col, " ").alias("w"))
    at = w.select("doc_id", "title", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int"))).alias("passage_ix"))
    body = F.trim(F.array_join(F.slice("w", F.col("passage_ix") * words + 1, F.lit(words)), " "))
    return at.select("doc_id", "passage_ix", "title", body.alias("passage"))


def strided_windows(rows: DataFrame, *, most: int, stride: int) -> DataFrame:
    """(doc_id, window_ix, begin, tokens, start, end) of (doc_id, question, tokens, answer_start, answer_end): windows of the question and a
    slice of the document, ``most`` ids in all, which overlap by ``stride``.

    Answer places are counted in the window, after the question.  Once an answer lies outside a window, its places are -100 there and in all later windows.
    """
    room = F.lit(most) - F.size("question")
    hop = room - stride
    n = F.size("tokens")
    count = F.when(n <= room, F.lit(1)).otherwise(F.ceil((n - room) / hop) + 1).cast("int")
    at = rows.where(hop > 0).withColumn("window_ix", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("begin", F.col("window_ix") * hop)
    within = lambda b: (F.col("answer_start") >= b) & (F.col("answer_end") < b + room)
    # Later windows begin further right, so an answer that has been outside stays so when all windows up to here held it.
    ok = within(F.col("begin")) & within(F.lit(0))
    place = lambda c: F.when(ok, F.col(c) - F.col("begin") + F.size("question")).otherwise(F.lit(-100))
    return at.select("doc_id", "window_ix", "begin", F.concat("question", F.slice("tokens", F.col("begin") + 1, room)).alias("tokens"), place("answer_start").alias("start"), place("answer_end").alias("end"))


def remove_marked(rows: DataFrame) -> DataFrame:
    """(doc_id, tokens, start, end) of (doc_id, tokens, marked, answer_start, answer_end): without marked tokens, answer places moved left by those before them."""
    kept = F.filter(F.arrays_zip("tokens", "marked"), lambda x: ~x["marked"])
    before = lambda c: F.size(F.filter(F.slice("marked", F.lit(1), F.greatest(F.col(c), F.lit(0))), lambda m: m))
    shift = lambda c: F.col(c) - before(c)
    return rows.select("doc_id", F.transform(kept, lambda x: x["tokens"]).alias("tokens"), shift("answer_start").alias("start"), shift("answer_end").alias("end"))


def overlapping_chunks(rows: DataFrame, *, length: int, left: int, right: int) -> DataFrame:
    """(doc_id, begin, size, left, right) of (doc_id, n): windows of ``length`` with strides; the first has no left stride, the last no right one, and a rest
    counts only if it is longer than the left stride."""
    hop = length - left - right
    if hop <= 0:
        raise ValueError("the strides leave no room")
    at = rows.where("n > 0").withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(hop).cast("long"))))
    size = F.least(F.lit(length).cast("long"), F.col("n") - F.col("begin"))
    first = F.col("begin") == 0
    # A window is the last one when it reaches the end: those that begin later hold only what it has.
    at = at.where(first | (F.col("begin") - hop + length < F.col("n"))).where(first | (size > left))
    last = F.col("begin") + length >= F.col("n")
    return at.select("doc_id", "begin", size.alias("size"), F.when(first, 0).otherwise(left).cast("long").alias("left"), F.when(last, 0).otherwise(right).cast("long").alias("right"))


def split_long(rows: DataFrame, *, most: int, start: int, end: int) -> DataFrame:
    """(doc_id, piece_ix, tokens): sequences longer than ``most`` in pieces of ``most - 2``, each with the start and end id."""
    room = most - 2
    k = F.when(F.size("tokens") <= most, F.lit(1)).otherwise(F.ceil(F.size("tokens") / room)).cast("int")
    at = rows.where(F.size("tokens") > 0).withColumn("piece_ix", F.explode(F.sequence(F.lit(0), k - 1)))
    piece = F.slice("tokens", F.col("piece_ix") * room + 1, F.lit(room))
    opened = F.when(piece[0] == start, piece).otherwise(F.concat(F.array(F.lit(start)), piece))
    closed = F.when(F.element_at(opened, -1) == end, opened).otherwise(F.concat(opened, F.array(F.lit(end))))
    return at.select("doc_id", "piece_ix", F.when(F.size("tokens") <= most, F.col("tokens")).otherwise(closed).alias("tokens"))


def pack_pairs(rows: DataFrame, *, most: int, group_col: str = "group") -> DataFrame:
    """(group, pack, source, target) of (group, pos, source, target, n_source, n_target): neighbours are joined by a space while both sides keep within ``most`` tokens.

    Greedy and in order, one group (a shard) at a time; the task holds one pack."""
    dealt = rows.select(F.col(group_col).cast("long").alias("group"), "pos", "source", "target", F.col("n_source").cast("long"), F.col("n_target").cast("long"))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "pos")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = [0, 0]
        now, pack = None, 0

        def close() -> tuple:
            return now, pack, " ".join(x for x, _ in held), " ".join(y for _, y in held)

        for b in batches:
            out = []
            for g, _, s, t, ns, nt in zip(*(c.to_pylist() for c in b.columns)):
                if held and (g != now or size[0] + ns > most or size[1] + nt > most):
                    out.append(close())
                    pack, held, size = (pack + 1 if g == now else 0), [], [0, 0]
                now = g
                held.append((s, t))
                size = [size[0] + ns, size[1] + nt]
            yield _packs(out)
        if held:
            yield _packs([close()])

    return dealt.mapInArrow(fold, "group long, pack long, source string, target string")


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["group", "pack", "source", "target"])


def split_records(lines: DataFrame, *, most: int, group_col: str = "group") -> DataFrame:
    """(group, pos, record) of (group, pos, line, n_tokens): blank lines end a record, and so does a line with which it would hold more than ``most`` tokens.

    A line's own tokens are dropped where ``n_tokens`` is 0.  One group at a time, in order; the task holds two numbers."""
    dealt = lines.select(F.col(group_col).cast("long").alias("group"), "pos", "line", F.col("n_tokens").cast("long")).repartition("group").sortWithinPartitions("group", "pos")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, record, size = None, 0, 0
        for b in batches:
            rows = []
            for g, p, line, n in zip(*(c.to_pylist() for c in b.columns)):
                if g != now:
                    now, record, size = g, 0, 0
                if not (line or "").strip():
                    record, size = record + (size > 0), 0
                elif n:
                    if size and size + n > most:
                        record, size = record + 1, 0
                    rows.append((g, p, record))
                    size += n
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["group", "pos", "record"])

    return dealt.mapInArrow(fold, "group long, pos long, record long")
