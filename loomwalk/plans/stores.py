"""Queries over what is written and read back, lookups, retrieval, and operators beside the main path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import vectors as V
from ..operators import chunking as C
from ..operators import dedup as D
from ..operators import embed as E
from ..operators import knn as K
from ..operators import lookups as L
from ..operators import order as O
from ..operators import qa as Q
from ..operators import quality as G
from ..operators import tokens as T
from ..sources import readers as R
from ..sources import writers as W
from ..storage import cut, fresh_path
from .registry import query, table
from .vectors import _CLUSTERS, _IP, _clusters, _top


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# --- written and read back -------------------------------------------------------------------------------------
@query("select doc_id, md5(text) as digest from documents where text is not null")
def jsonl_sink_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed JSON lines in bounded files, read with a schema."""
    path = fresh_path(spark, "jsonl")
    W.json_batches(_docs(spark, sf_dir).select("doc_id", "text"), path, rows=100)
    return R.jsonl(spark, path, schema="doc_id long, text string").where("text is not null").select("doc_id", F.md5("text").alias("digest"))


@query("select doc_id, md5(text) as digest from documents where text is not null")
def lz4_sink_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "lz4")
    W.json_batches(_docs(spark, sf_dir).select("doc_id", "text"), path, rows=100, compression="lz4")
    return R.jsonl(spark, path, schema="doc_id long, text string").where("text is not null").select("doc_id", F.md5("text").alias("digest"))


@query(_CLUSTERS + " select out_pos // greatest(1, (select count(*) from cl) // 8) as slice, out_pos, f.doc_id, n_chars from (select row_number() over (order by cluster_id, pos) - 1 as out_pos, doc_id from cl) f join documents d on d.doc_id = f.doc_id")
def ordered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order joined with the documents, written in slices and read back."""
    flat = O.flatten(_clusters(spark, sf_dir).select("doc_id", "cluster_id", "pos"))
    cut_up = cut(O.slices(cut(flat, "flat"), 8).select("slice", "out_pos", "doc_id"), "slices")
    rows = cut_up.join(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    path = fresh_path(spark, "ordered")
    rows.repartition("slice").sortWithinPartitions("slice", "out_pos").write.partitionBy("slice").parquet(path)
    return spark.read.parquet(path).select(F.col("slice").cast("long").alias("slice"), "out_pos", "doc_id", "n_chars")


@query("select doc_id, doc_id // 64 as shard from (select row_number() over (order by doc_id) - 1 as doc_id from documents)")
def record_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records")
    n = _docs(spark, sf_dir).count()
    W.record_shards(spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("pos")), path, 64)
    return spark.read.parquet(path).select("doc_id", F.col("shard").cast("long").alias("shard"))


@query("select count(*) as n, sum(n_chars)::bigint as chars, max(n_chars) as longest from documents")
def statistics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "statistics")
    W.statistics(_docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest")), path)
    return spark.read.schema("n long, chars long, longest long").json(path)


@query("select count(*) as n from documents")
def capacity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.capacity(_docs(spark, sf_dir), 1 << 40).agg(F.count(F.lit(1)).alias("n"))


# --- lookups and joins -----------------------------------------------------------------------------------------
@query("select doc_id, source, md5(coalesce(text, '')) as digest from documents where doc_id in (select doc_id from labels)")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_id(_docs(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query(f"select q, n, score, rank from ({_top(_IP, 'desc', 5)}) where q in (select vec_id from embeddings where label = 0)")
def knn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour lists in shards of consecutive queries; some queries are looked up."""
    v, path = _vectors(spark, sf_dir), fresh_path(spark, "knn")
    L.write_knn(K.exact_knn(v, v, 5), path, rows_per_shard=50)
    return L.lookup_knn(spark, path, v.where("label = 0").select(F.col("vec_id").alias("q")), rows_per_shard=50)


@query(f"select q, n, n // 70 as shard from ({_top(_IP, 'desc', 3)})")
def shard_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the range of ids that a shard holds."""
    v = _vectors(spark, sf_dir)
    ranges = v.groupBy(F.floor(F.col("vec_id") / 70).cast("long").alias("shard")).agg(F.min("vec_id").alias("low"), (F.max("vec_id") + 1).alias("high"))
    return L.in_ranges(K.exact_knn(v, v, 3).select("q", "n"), ranges, value_col="n", width=100).select("q", "n", "shard")


@query("select pos, doc_id, page_id from (select row_number() over (order by doc_id) - 1 as pos, doc_id from documents) join (select row_number() over (order by page_id) - 1 as pos, page_id from pages) using (pos)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.zip_rows(_docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "pages").select("page_id"), left_order="doc_id", right_order="page_id")


@query(f"select q, rank, score, d.doc_id, d.n_chars from ({_top(_IP, 'desc', 4, 'true', '(select * from embeddings where label = 1)')}) t join documents d on d.doc_id = t.n")
def retrieved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return L.retrieve(v.where("label = 1"), v, _docs(spark, sf_dir).select("doc_id", "n_chars"), 4)


@query()
def ivf_pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the stored index of cells and codes, for the queries whose id is divisible by 100 against all vectors."""
    v = _vectors(spark, sf_dir)
    asked = v.where("vec_id % 100 = 0")
    path = fresh_path(spark, "ivf-pq")
    K.build_index(v, path)
    return K.recall(K.search_index(asked, path, 10, vectors=v), K.exact_knn(asked, v, 10))


# --- sets, hashes, embeddings ----------------------------------------------------------------------------------
@query("""with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') as a from documents), u as (select doc_id, unnest(list_distinct(a)) as w from t where len(a) >= 10)
select doc_id, array_to_string(list(m order by j), ',') as signature from (select doc_id, j, min(('0x' || substr(md5(j::varchar || ':' || w), 1, 8))::bigint) as m from u, unnest(range(8)) s(j) group by doc_id, j) group by doc_id""")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.minhash_signatures(_docs(spark, sf_dir), permutations=8)
    return out.select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query("select vec_id, round(sum(a * b), 6) as own from (select vec_id, unnest(embedding)::double as a, unnest(embedding)::double as b from embeddings) group by vec_id")
def self_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of vectors with themselves."""
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("own"))


_POOL = """with w as (select doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) as token, unnest(range(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))) as i from documents)"""


@query(_POOL + " select doc_id, round(sum(token) / (count(*) + 1e-8), 4) as mean_length from w where i > 0 group by doc_id")
def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pooling without the first place, with the length of a word as its vector."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    tokens = _docs(spark, sf_dir).select("doc_id", F.transform(words, lambda w: F.length(w)).alias("tokens"))
    vectors = tokens.select(F.explode("tokens").alias("token")).dropDuplicates().select("token", F.array(F.col("token").cast("double")).alias("v"))
    return E.mean_pool(tokens, vectors).select("doc_id", F.round(F.col("embedding")[0], 4).alias("mean_length"))


@query(_POOL + " select doc_id, token::double as first_length from w where i = 0")
def first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    tokens = _docs(spark, sf_dir).select("doc_id", F.transform(words, lambda w: F.length(w)).alias("tokens")).where(F.size("tokens") > 0)
    vectors = tokens.select(F.explode("tokens").alias("token")).dropDuplicates().select("token", F.array(F.col("token").cast("double")).alias("v"))
    return E.first_place(tokens, vectors).select("doc_id", F.col("embedding")[0].alias("first_length"))


# --- token tables ----------------------------------------------------------------------------------------------
_PIECES = "with p as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))


@query(_PIECES + " select doc_id, array_to_string(list_transform(w, lambda x: case when length(x) between 1 and 12 then length(x) - 1 else 99 end), ' ') as ids from p where len(w) > 0")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by their ids in a vocabulary, here by their length; what it lacks is unknown."""
    rows = _words(spark, sf_dir).select("doc_id", F.transform("w", lambda x: F.length(x).cast("string")).alias("pieces"))
    vocabulary = spark.range(12).select((F.col("id") + 1).cast("string").alias("token"), F.col("id").cast("int").alias("id"))
    return T.to_ids(rows, vocabulary, key="doc_id", unknown=99).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(_PIECES + " select doc_id, trim(replace(array_to_string(list_transform(w, lambda x: case when length(x) > 6 then x[1:3] || ' ##' || x[4:] else x end), ' '), ' ##', '')) as text from p")
def pieces_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.flatten(F.transform("w", lambda x: F.when(F.length(x) > 6, F.array(F.substring(x, 1, 3), F.concat(F.lit("##"), F.substr(x, F.lit(4))))).otherwise(F.array(x))))
    return _words(spark, sf_dir).select("doc_id", T.to_text(pieces).alias("text"))


@query(f"""{_PIECES} select doc_id, array_to_string(list_concat([{A.CLS}], a, [{A.SEP}], b, [{A.SEP}]), ' ') as ids, array_to_string(list_concat(list_transform(range(len(a) + 2), lambda x: 0), list_transform(range(len(b) + 1), lambda x: 1)), ' ') as kinds
from (select doc_id, list_transform(w[1:5], lambda x: length(x)) as a, list_transform(w[6:9], lambda x: length(x)) as b from p)""")
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.transform(c, lambda x: F.length(x))
    ids, kinds, _ = T.with_specials(size(F.slice("w", 1, 5)), size(F.slice("w", 6, 4)))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return _words(spark, sf_dir).select("doc_id", text(ids).alias("ids"), text(kinds).alias("kinds"))


@query(f"""{_PIECES}, f as (select doc_id, list_transform(w, lambda x: length(x)) as n from p), g as (select doc_id, flatten(list_transform(n, lambda k: list_transform(range(k), lambda i: k))) as t, flatten(list_transform(n, lambda k: list_transform(range(k), lambda i: case when i = 0 then k % 3 else -100 end))) as y from f)
select doc_id, array_to_string(list_concat([{A.CLS}], t[1:30], [{A.SEP}]), ' ') as ids, array_to_string(list_concat([-100], y[1:30], [-100]), ' ') as labels from g""")
def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("doc_id", F.transform("w", lambda x: A.repeat(F.length(x), F.length(x))).alias("pieces"), F.transform("w", lambda x: F.length(x) % 3).alias("labels"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    out = T.word_labels(rows, most=32)
    return out.select("doc_id", text("ids").alias("ids"), text("labels").alias("labels"))


@query("select id, start, end_ as \"end\", score, (row_number() over (partition by id order by score desc, start, end_))::int as rank from (select vec_id as id, i as start, i + j - 1 as end_, round(embedding[i + 1]::double + embedding[4 + i * 3 + j + 1]::double, 6) as score from embeddings, unnest(range(4)) a(i), unnest(range(3)) b(j)) where end_ >= start")
def beam_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))
    beams = v.select("id", F.slice("e", 1, 4).alias("start_score"), F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")).alias("start_index"), F.slice("e", 5, 12).alias("end_score"), F.transform(places, lambda p: F.floor(p / 3).cast("long") + p % 3 - 1).alias("end_index"))
    return Q.beam_answers(beams, start_n=4, end_n=3).select("id", "start", "end", "score", F.col("rank").cast("int").alias("rank"))


@query("select vec_id as id, i::int as start, j::int as \"end\", round(embedding[i + 1]::double * embedding[j + 33]::double, 6) as score from embeddings, unnest(range(32)) a(i), unnest(range(32)) b(j) where i < j and round(embedding[i + 1]::double * embedding[j + 33]::double, 6) >= 0.05")
def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("start_score"), F.slice("embedding", 33, 32).alias("end_score"))
    return L.span_pairs(v, threshold=0.05)


@query("select doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x0A]+'), lambda x: length(x)), ' ') as lengths from documents")
def flattened_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines go through a function in batches that run across documents, and come back by document."""
    rows = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x0A]+"), F.lit(0)).alias("lines"))
    out = L.map_flattened(rows, lambda s: s.str.len(), "bigint", id_col="doc_id", items_col="lines")
    return out.select("doc_id", F.array_join(F.transform("results", lambda x: x.cast("string")), " ").alias("lengths"))


@query("select doc_id, lang from documents where n_chars <= 2000")
def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to a length, with the columns that a signature names."""
    return L.prune(_docs(spark, sf_dir).where("n_chars <= 2000"), ["lang", "doc_id", "no such column"])


@query(_PIECES + " select doc_id, array_to_string(list_transform(w, lambda x: case when length(x) * 9000 % 65536 >= 32768 then length(x) * 9000 % 65536 - 65536 else length(x) * 9000 % 65536 end), ' ') as ids from p")
def narrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("doc_id", F.transform("w", lambda x: F.length(x) * 9000 % 65536).alias("tokens"))
    return L.narrow_ids(rows, vocabulary=1 << 16).select("doc_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("ids"))


@query("select source, count(*) as n from (select coalesce(source, '') as source from documents) group by source")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check that stops the query where it fails."""
    docs = _docs(spark, sf_dir).where(G.require(F.col("doc_id").isNotNull(), "a document needs an id"))
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, n_chars, n_chars > 1000 as long from documents union all select doc_id, n_chars, n_chars > 1000 from documents where doc_id in (select doc_id from labels where toxic = 1)")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table after the other, by names."""
    docs = _docs(spark, sf_dir).select("doc_id", "n_chars", (F.col("n_chars") > 1000).alias("long"))
    return docs.unionByName(L.by_id(docs, table(spark, sf_dir, "labels").where("toxic = 1")).select("long", "doc_id", "n_chars"))


@query("select n, case when n < 1000000 then floor(8 * sqrt(n))::bigint else 0 end as cells from (select count(*) as n from embeddings)")
def index_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of cells that an index over the vectors has."""
    n = _vectors(spark, sf_dir).count()
    return spark.createDataFrame([(n, K.cell_count(n))], "n long, cells long")
