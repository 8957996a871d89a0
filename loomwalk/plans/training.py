"""Queries that make training data: chunks, sequences, neighbours, packs and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import chunking as C
from ..operators import neighbors as N
from ..operators import quality as G
from ..storage import cut
from ..streaming.streams import buffer_shuffle
from .registry import query, table

CHUNK, PER, KNN, KEEP, EOS = 64, 4, 6, 2, 1017

_TOKENS = r"t as materialized (select doc_id, source, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: ('0x' || substr(md5(w), 1, 7))::bigint % 29000 + 1000) as tokens from documents)"
_COUNTS = f"n as (select doc_id, tokens, case when len(tokens) > 0 then (len(tokens) - 1) // {CHUNK} + 1 else 0 end as nc from t), b as materialized (select *, coalesce(sum(nc) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as base from n)"
_CHUNKS = f"c as materialized (select base + ix as chunk_id, doc_id, ix::int as chunk_ix, list_resize(tokens[ix * {CHUNK} + 1:(ix + 1) * {CHUNK}], {CHUNK}, 0) as tokens, coalesce(tokens[(ix + 1) * {CHUNK} + 1], 0)::int as next_token from (select *, unnest(range(nc)) as ix from b))"
_ALL = f"with {_TOKENS}, {_COUNTS}, {_CHUNKS}"
_STARTS = f"s as (select doc_id, base + x as begin_chunk from (select *, unnest(range(0, nc, {PER})) as x from b))"
#: Neighbour lists by a rule, in place of those of a trained encoder: any table (q, rank, n) will do.
_KNN = f"k as (select chunk_id as q, r::int as rank, (chunk_id * 7919 + r * 104729) % (select count(*) from c) as n from c, unnest(range(1, {KNN + 1})) u(r))"
_MASKED = f"m as (select q, slot as rank, n from (select k.q, k.n, row_number() over (partition by k.q order by k.rank) as slot from k join c a on a.chunk_id = k.q join c b on b.chunk_id = k.n where a.doc_id <> b.doc_id) where slot <= {KEEP})"
_CONT = f"e as (select chunk_id, doc_id, tokens, coalesce(lead(tokens) over (partition by doc_id order by chunk_id), list_resize([]::bigint[], {CHUNK}, 0)) as continuation from c)"
_MASK = lambda x: f"(case when list_position({x}, {EOS}) > 0 then list_resize({x}[1:list_position({x}, {EOS})], len({x}), 0) else {x} end)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", X.hash_tokens(F.col("text")).alias("tokens"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(C.corpus_chunks(_tokens(spark, sf_dir), chunk=CHUNK), "chunks")


def _knn(chunks: DataFrame) -> DataFrame:
    n = chunks.count()
    rank = F.explode(F.sequence(F.lit(1), F.lit(KNN))).alias("rank")
    return chunks.select(F.col("chunk_id").alias("q"), rank).select("q", "rank", ((F.col("q") * 7919 + F.col("rank") * 104729) % n).alias("n"))


def _text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


@query(f"{_ALL} select chunk_id, doc_id, chunk_ix, array_to_string(tokens, ' ') as tokens from c")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_chunks(_tokens(spark, sf_dir), chunk=CHUNK).select("chunk_id", "doc_id", "chunk_ix", _text(F.col("tokens")).alias("tokens"))


@query(f"{_ALL} select chunk_id, next_token from c")
def chunk_next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_chunks(_tokens(spark, sf_dir), chunk=CHUNK).select("chunk_id", "next_token")


@query(f"with {_TOKENS}, {_COUNTS} select doc_id, nc::int as n_chunks, base as chunk_base from b")
def chunk_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_bases(_tokens(spark, sf_dir), chunk=CHUNK).select("doc_id", "n_chunks", "chunk_base")


@query(f"with {_TOKENS}, {_COUNTS}, {_STARTS} select count(*) as docs, sum(nc)::bigint as chunks, (select count(*) from s) as seqs from b")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.n_chunks(F.col("tokens"), CHUNK)
    return _tokens(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("chunks"), F.sum(F.ceil(n / PER)).alias("seqs"))


@query(f"{_ALL} select chunk_id, doc_id, lead(chunk_id) over (partition by doc_id order by chunk_id) is null as is_last from c")
def last_chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.last_flags(_chunks(spark, sf_dir))


@query(f"with {_TOKENS}, {_COUNTS}, {_STARTS} select doc_id, begin_chunk from s")
def sequence_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sequence_starts(_tokens(spark, sf_dir), chunk=CHUNK, sequence=CHUNK * PER)


@query(f"with {_TOKENS}, {_COUNTS}, {_STARTS} select begin_chunk, case when r >= n - floor(0.2::double * n)::bigint then 'valid' else 'train' end as split from (select begin_chunk, row_number() over (order by md5(begin_chunk::varchar || '0'), begin_chunk) - 1 as r, count(*) over () as n from s)")
def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.split_sequences(cut(C.sequence_starts(_tokens(spark, sf_dir), chunk=CHUNK, sequence=CHUNK * PER), "starts"))


@query(f"{_ALL} select chunk_id, array_to_string({_MASK('tokens')}, ' ') as tokens from c")
def mask_after_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", _text(A.mask_after(F.col("tokens"), EOS)).alias("tokens"))


@query(f"{_ALL} select chunk_id, array_to_string(case when list_position(x, 0) > 0 then list_concat(x[1:list_position(x, 0) - 1], [102::bigint], x[list_position(x, 0) + 1:]) else x end, ' ') as tokens from (select chunk_id, list_concat([101::bigint], tokens[1:{CHUNK - 1}]) as x from c)")
def roll_cls_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", _text(A.roll_cls_sep(F.col("tokens"))).alias("tokens"))


@query(f"{_ALL} select chunk_id, coalesce(list_max(list_transform(range(1, {CHUNK + 1}), lambda i: case when tokens[i] <> 0 then i else 0 end)), 0)::int as used, array_to_string(list_concat([0::bigint], tokens[1:{CHUNK - 1}]), ' ') as shifted from c")
def shift_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", A.used_length(F.col("tokens")).alias("used"), _text(A.shift_right(F.col("tokens"))).alias("shifted"))


@query(f"{_ALL}, {_KNN}, {_MASKED} select q, rank::int as rank, n from m")
def foreign_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    return N.keep_foreign(_knn(c), c, KEEP)


@query(f"{_ALL}, {_KNN}, {_MASKED}, {_CONT} select q as chunk_id, rank::int as rank, n as neighbour_id, array_to_string(tokens, ' ') as neighbour from m join e on e.chunk_id = n")
def neighbor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    out = N.neighbour_tokens(N.keep_foreign(_knn(c), c, KEEP), c, chunk=CHUNK)
    return out.select("chunk_id", "rank", "neighbour_id", _text(F.col("neighbour")).alias("neighbour"))


@query(f"{_ALL}, {_KNN}, {_MASKED}, {_CONT} select q as chunk_id, rank::int as rank, n as neighbour_id, array_to_string(continuation, ' ') as continuation from m join e on e.chunk_id = n")
def neighbor_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    out = N.neighbour_tokens(N.keep_foreign(_knn(c), c, KEEP), c, chunk=CHUNK)
    return out.select("chunk_id", "rank", "neighbour_id", _text(F.col("continuation")).alias("continuation"))


@query(f"""{_ALL}, {_KNN}, {_MASKED}, {_CONT}, g as (select q, list(list_concat(tokens, continuation) order by rank) as r from m join e on e.chunk_id = n group by q)
select c.chunk_id, md5(array_to_string(list_resize(flatten(coalesce(r, [])), {KEEP * 2 * CHUNK}, 0), ' ')) as digest from c left join g on g.q = c.chunk_id""")
def retrieved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    out = N.retrieved_blocks(N.keep_foreign(_knn(c), c, KEEP), c, KEEP, chunk=CHUNK)
    return out.select("chunk_id", F.md5(_text(F.flatten("retrieved"))).alias("digest"))


_BLOCKS = f"""p as (select k.q, k.rank, list_concat(a.tokens, b.tokens) as x from k join c a on a.chunk_id = k.n join c b on b.chunk_id = least(k.n + 1, (select max(chunk_id) from c)) where k.rank <= {KEEP}),
g as materialized (select q, flatten(list({_MASK('x')} order by rank)) as r from p group by q)"""


@query(f"{_ALL}, {_KNN}, {_BLOCKS} select q as chunk_id, md5(array_to_string(r, ' ')) as digest from g")
def retrieved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    out = N.masked_blocks(_knn(c).where(F.col("rank") <= KEEP), c, KEEP, chunk=CHUNK, eos=EOS)
    return out.select("chunk_id", F.md5(_text(F.flatten("retrieved"))).alias("digest"))


@query(f"""{_ALL}, {_STARTS}, {_KNN}, {_BLOCKS}, w as (select s.begin_chunk, j, c.tokens, c.next_token, g.r from s, unnest(range({PER})) u(j) left join c on c.chunk_id = s.begin_chunk + j left join g on g.q = s.begin_chunk + j),
z as (select begin_chunk, list_concat(flatten(list(coalesce(tokens, list_resize([]::bigint[], {CHUNK}, 0)) order by j)), [coalesce(arg_max(coalesce(next_token, 0), j), 0)::bigint]) as x, flatten(list(coalesce(r, list_resize([]::bigint[], {KEEP * 2 * CHUNK}, 0)) order by j)) as r from w group by begin_chunk)
select begin_chunk, md5(array_to_string({_MASK('x')}, ' ')) as tokens, md5(array_to_string(r, ' ')) as retrieved from z""")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    starts = C.sequence_starts(_tokens(spark, sf_dir), chunk=CHUNK, sequence=CHUNK * PER)
    out = N.examples(starts, c, _knn(c).where(F.col("rank") <= KEEP), KEEP, per_sequence=PER, chunk=CHUNK, eos=EOS)
    return out.select("begin_chunk", F.md5(_text(F.col("tokens"))).alias("tokens"), F.md5(_text(F.flatten(F.flatten("retrieved")))).alias("retrieved"))


@query(f"""{_ALL}, {_STARTS}, {_KNN}, d as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as line from documents)
select s.begin_chunk, s.doc_id, source, line, rank, c.doc_id as neighbour_doc from s join d using (doc_id) join k on k.q = s.begin_chunk join c on c.chunk_id = k.n""")
def viewer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    starts = C.sequence_starts(_tokens(spark, sf_dir), chunk=CHUNK, sequence=CHUNK * PER).select("begin_chunk")
    return N.lookup(starts, c, table(spark, sf_dir, "documents"), _knn(c))


# --- packs, passages, windows ----------------------------------------------------------------------------------
def _pack_sql(length: int, group: str) -> str:
    return f"""with {_TOKENS}, f as (select {group} as grp, flatten(list(list_concat(tokens, [{EOS}::bigint]) order by doc_id)) as s from t group by 1)
select grp::bigint as "group", p as pack, md5(array_to_string(s[p * {length} + 1:(p + 1) * {length}], ' ')) as digest from (select *, unnest(range(len(s) // {length})) as p from f)"""


@query(_pack_sql(1024, "0"))
def constant_length_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.pack_constant(_tokens(spark, sf_dir), length=1024, separator=EOS)
    return out.select("group", "pack", F.md5(_text(F.col("tokens"))).alias("digest"))


@query(_pack_sql(512, "doc_id // 1000"))
def group_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 1000))
    return C.pack_constant(t, length=512, separator=EOS, group_col="batch").select("group", "pack", F.md5(_text(F.col("tokens"))).alias("digest"))


@query("with w as (select doc_id, string_split(text, ' ') as w from documents where text is not null) select doc_id, ix::int as passage_ix, md5(trim(array_to_string(w[ix * 100 + 1:(ix + 1) * 100], ' '), ' ')) as digest from (select *, unnest(range((len(w) - 1) // 100 + 1)) as ix from w)")
def passages_100w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.passages(table(spark, sf_dir, "documents")).select("doc_id", "passage_ix", F.md5("passage").alias("digest"))


@query(f"""with {_TOKENS}, a as (select doc_id, tokens, tokens[1:8] as question, (len(tokens) // 3)::int as s, (least(len(tokens) // 3 + 2, greatest(len(tokens) - 1, 0)))::int as e, 256 - least(len(tokens), 8) as room from t),
w as (select *, unnest(range(case when len(tokens) <= room then 1 else ceil((len(tokens) - room) / (room - 64))::int + 1 end)) as ix from a)
select doc_id, ix::int as window_ix, (ix * (room - 64))::int as begin, md5(array_to_string(list_concat(question, tokens[ix * (room - 64) + 1:ix * (room - 64) + room]), ' ')) as digest,
  case when s >= ix * (room - 64) and e < room then s - ix * (room - 64) + len(question) else -100 end::int as "start", case when s >= ix * (room - 64) and e < room then e - ix * (room - 64) + len(question) else -100 end::int as "end" from w""")
def strided_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tokens stand for a question, a place a third of the way for its answer."""
    n = F.size("tokens")
    at = F.floor(n / 3).cast("int")
    rows = _tokens(spark, sf_dir).select("doc_id", "tokens", F.slice("tokens", 1, 8).alias("question"), at.alias("answer_start"), F.least(at + 2, F.greatest(n - 1, F.lit(0))).alias("answer_end"))
    out = C.strided_windows(rows, most=256, stride=64)
    return out.select("doc_id", "window_ix", F.col("begin").cast("int").alias("begin"), F.md5(_text(F.col("tokens"))).alias("digest"), "start", "end")


@query(f"with {_TOKENS} select doc_id, len(k)::int as n, md5(array_to_string(k, ' ')) as digest, (s - len(list_filter(tokens[1:s], lambda x: x % 5 = 0)))::int as \"start\" from (select doc_id, tokens, (len(tokens) // 2)::int as s, list_filter(tokens, lambda x: x % 5 <> 0) as k from t)")
def marked_token_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by five stand for mark-up."""
    s = F.floor(F.size("tokens") / 2).cast("int")
    rows = _tokens(spark, sf_dir).select("doc_id", "tokens", F.transform("tokens", lambda x: x % 5 == 0).alias("marked"), s.alias("answer_start"), s.alias("answer_end"))
    out = C.remove_marked(rows)
    return out.select("doc_id", F.size("tokens").alias("n"), F.md5(_text(F.col("tokens"))).alias("digest"), "start")


@query("""with w as (select doc_id, n_chars as n, b from documents, lateral (select unnest(range(0, n_chars, 700)) as b))
select doc_id, b as begin, least(1000, n - b) as size, case when b = 0 then 0 else 200 end::bigint as "left", case when b + 1000 >= n then 0 else 100 end::bigint as "right" from w where b = 0 or (b - 700 + 1000 < n and least(1000, n - b) > 200)""")
def stride_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    return C.overlapping_chunks(rows, length=1000, left=200, right=100)


@query("select doc_id, buffer, row_number() over (partition by buffer order by md5(doc_id::varchar || '0'), doc_id) - 1 as place from (select doc_id, doc_id // 256 as buffer from documents)")
def buffer_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"))
    return buffer_shuffle(d, 256).select("doc_id", "buffer", "place")


@query(f"with {_TOKENS} select doc_id, md5(array_to_string(list_resize(tokens, (ceil(len(tokens) / 8) * 8)::bigint, 0), ' ')) as digest, (ceil(len(tokens) / 8) * 8)::int as n, array_to_string(list_concat(list_resize([]::bigint[], greatest(0, 16 - len(tokens)), 0), tokens[greatest(1, len(tokens) - 15):]), ' ') as tail from t")
def pad_to_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.up_to_multiple(F.size("tokens"), 8)
    return _tokens(spark, sf_dir).select("doc_id", F.md5(_text(A.pad_right(F.col("tokens"), n))).alias("digest"), n.alias("n"), _text(A.pad_left(F.col("tokens"), 16)).alias("tail"))


@query(f"""with {_TOKENS}, p as (select doc_id, ix, len(tokens) <= 512 as whole, tokens, tokens[ix * 510 + 1:(ix + 1) * 510] as x from (select *, unnest(range(case when len(tokens) <= 512 then 1 else ceil(len(tokens) / 510)::int end)) as ix from t where len(tokens) > 0))
select doc_id, ix::int as piece_ix, md5(array_to_string(case when whole then tokens else list_concat([101::bigint], x, [102::bigint]) end, ' ')) as digest from p""")
def split_long_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.split_long(_tokens(spark, sf_dir), most=512, start=A.CLS, end=A.SEP)
    return out.select("doc_id", "piece_ix", F.md5(_text(F.col("tokens"))).alias("digest"))


@query(f"with {_TOKENS} select doc_id, len(tokens)::int as n from t where len(tokens) > 11 and len(list_filter(tokens, lambda x: x = {EOS}))::double / len(tokens) < 0.5")
def short_unknown_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.known_share(_tokens(spark, sf_dir), unknown=EOS).select("doc_id", F.size("tokens").alias("n"))


@query(f"with {_TOKENS} select doc_id, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = tokens[1] and tokens[i + 1] = tokens[2]))::int as n from t")
def sublist_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a document's first two tokens occur in it, one after the other."""
    return _tokens(spark, sf_dir).select("doc_id", F.when(F.size("tokens") > 1, F.size(A.find_runs(F.col("tokens"), F.slice("tokens", 1, 2)))).otherwise(F.lit(0)).alias("n"))


@query("select l_orderkey as row, array_to_string(list(l_linenumber order by l_linenumber), ' ') as numbers from lineitem group by l_orderkey")
def multiple_choice_unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one question gathered again, in their order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    return lines.select("row", _text(F.col("x")).alias("numbers"))


@query(f"with {_TOKENS} select doc_id, array_to_string(list_transform(unnest, lambda x: x), ',') as ranges from (select doc_id, list_transform(range(0, len(tokens), 500), lambda i: i::varchar || '-' || least(i + 500, len(tokens))::varchar) as unnest from t)")
def batched_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.transform(C.ranges_of(F.size("tokens"), 500), lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string")))
    return _tokens(spark, sf_dir).select("doc_id", F.array_join(r, ",").alias("ranges"))
