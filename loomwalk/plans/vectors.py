"""Queries over vectors: nearest neighbours, the order they give, and score functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn as K
from ..operators import order as O
from ..operators import qa as Q
from ..operators import stats as S
from ..storage import cut
from .registry import query, table

_IP = "round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6)"
_L2 = "round(list_distance(a.embedding::double[], b.embedding::double[]) ** 2, 6)"


def _top(score: str, order: str, k: int, where: str = "a.vec_id <> b.vec_id", left: str = "embeddings", right: str = "embeddings") -> str:
    return f"""select * from (select a.vec_id as q, b.vec_id as n, {score} as score,
      row_number() over (partition by a.vec_id order by {score} {order}, b.vec_id)::int as rank
      from {left} a, {right} b where {where}) where rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _neighbours(spark: SparkSession, sf_dir: str, k: int = O.NEIGHBOURS) -> DataFrame:
    v = _vectors(spark, sf_dir)
    found = K.compact(K.exact_knn(v, v, k))
    return cut(v.select(F.col("vec_id").alias("q")).join(found, "q", "left").withColumn("nn", F.coalesce("nn", F.array().cast("array<long>"))), "neighbours")


_GRAPH = f"with recursive k as materialized (select q, list(n order by rank) nn from ({_top(_IP, 'desc', 9)}) group by q)"
_WALK = """,
w(step, cur, cluster, len, unseen) as (
  select 0, 0::bigint, 0, 0, list_filter(range(0, (select count(*) from k)), lambda x: x <> 0)
  union all
  select step + 1, case when f is null or len >= 21 then unseen[1] else f end,
    case when f is null or len >= 21 then cluster + 1 else cluster end, case when f is null or len >= 21 then 1 else len + 1 end,
    list_filter(unseen, lambda x: x <> (case when f is null or len >= 21 then unseen[1] else f end))
  from (select w.*, list_filter(k.nn, lambda x: list_contains(w.unseen, x))[1] f from w join k on k.q = w.cur) z where len(unseen) > 0),
cl as (select step, cur as doc_id, cluster as cluster_id, (row_number() over (partition by cluster order by step) - 1)::int as pos from w)"""
_CLUSTERS = _GRAPH + _WALK


@query(_CLUSTERS + " select step, doc_id, cluster_id from cl")
def ordered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.greedy_cover(_neighbours(spark, sf_dir)).select("step", "doc_id", "cluster_id")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.greedy_cover(_neighbours(spark, sf_dir))


@query(_CLUSTERS + " select cluster_id, count(*) as n from cl group by cluster_id")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cluster_sizes(_clusters(spark, sf_dir))



@query(_CLUSTERS + " select i::int as cut, round((s[j] * (100 - (i * (len(s) + 1) - j * 100)) + s[j + 1] * (i * (len(s) + 1) - j * 100)) / 100.0, 6)::double as value from (select i, least(greatest(i * (m + 1) // 100, 1), m - 1) as j, s from (select count(*) as m, list(n order by n) as s from (select count(*) as n from cl group by cluster_id)), unnest([26, 51, 76]) u(i))")
def cluster_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exclusive_quantiles(cut(S.cluster_sizes(_clusters(spark, sf_dir)), "sizes"), [26, 51, 76])


@query(_CLUSTERS + " select sum(n)::bigint as n_docs, count(*) as n_clusters, count_if(n >= 21)::bigint as n_full, round(avg(n), 6) as mean_size from (select count(*) as n from cl group by cluster_id)")
def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cluster_totals(S.cluster_sizes(_clusters(spark, sf_dir)), cap=O.CAP)


@query(_CLUSTERS + " select doc_id, cluster_id, pos from cl")
def cluster_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select("doc_id", "cluster_id", "pos")


@query()
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    knn = _neighbours(spark, sf_dir)
    return O.merge_short(O.greedy_cover(knn), knn)


@query(_CLUSTERS + " select row_number() over (order by cluster_id, pos) - 1 as out_pos, doc_id, cluster_id, pos from cl")
def flattened_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.flatten(_clusters(spark, sf_dir).select("doc_id", "cluster_id", "pos"))


@query(_CLUSTERS + " select row_number() over (order by md5(cluster_id::varchar), cluster_id, pos) - 1 as out_pos, doc_id from cl")
def context_diverse_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.diverse_order(_clusters(spark, sf_dir).select("doc_id", "cluster_id", "pos"))


@query(_CLUSTERS + " select doc_id, out_pos, out_pos // greatest(1, (select count(*) from cl) // 32) as slice from (select row_number() over (order by cluster_id, pos) - 1 as out_pos, doc_id from cl)")
def output_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = cut(O.flatten(_clusters(spark, sf_dir).select("doc_id", "cluster_id", "pos")), "flat")
    return O.slices(flat, 32).select("doc_id", "out_pos", "slice")


@query(_top(_IP, "desc", 10))
def knn_ip_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return K.exact_knn(v, v, 10)


@query(_top(_L2, "asc", 10))
def knn_l2_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return K.exact_knn(v, v, 10, metric="l2")


@query(_top(_IP, "desc", 10, "a.label <> b.label"))
def knn_masked_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return K.exact_knn(v, v, 10, group_col="label")


@query(_top(_IP, "desc", 10, "true", "(select * from embeddings where label = 0)", "(select * from embeddings where label <> 0)"))
def knn_reference_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return K.exact_knn(v.where("label = 0"), v.where("label <> 0"), 10, same_id=False)


@query(f"select q, n, rank::int as rank, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as l2 from ({_top(_IP, 'desc', 5)}) t join embeddings a on a.vec_id = q join embeddings b on b.vec_id = n")
def cosine_l2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    pairs = K.exact_knn(v, v, 5).select("q", "n", "rank")
    a, b = v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("a")), v.select(F.col("vec_id").alias("n"), F.col("embedding").alias("b"))
    return pairs.join(a, "q").join(b, "n").select("q", "n", "rank", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(V.l2(F.col("a"), F.col("b")), 6).alias("l2"))


@query(f"select q, round(count_if(a.label = b.label) / 10, 6)::double as precision from ({_top(_IP, 'desc', 10)}) t join embeddings a on a.vec_id = q join embeddings b on b.vec_id = n group by q")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    of = v.select("vec_id", "label")
    hits = K.exact_knn(v, v, 10).join(of.select(F.col("vec_id").alias("q"), F.col("label").alias("lq")), "q").join(of.select(F.col("vec_id").alias("n"), F.col("label").alias("ln")), "n")
    return hits.groupBy("q").agg(F.round(F.count_if(F.col("lq") == F.col("ln")) / 10, 6).alias("precision"))


@query()
def ivf_knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the inverted file, for the queries whose id is divisible by 100 against all vectors."""
    v = _vectors(spark, sf_dir)
    asked = v.where("vec_id % 100 = 0")
    return K.recall(K.ivf_knn(asked, v, 10), K.exact_knn(asked, v, 10))


@query("select count(*) as n, min(vec_id) as low, max(vec_id) as high, count(distinct vec_id) as distinct, min(vec_id) = 0 and max(vec_id) = count(*) - 1 and count(distinct vec_id) = count(*) as dense from embeddings")
def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_check(_vectors(spark, sf_dir))


@query("select vec_id, list_sum(list_transform(embedding, lambda x: (x <> 0)::int)) = 0 as is_zero from embeddings")
def zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", V.is_zero(F.col("embedding")).alias("is_zero"))


@query("""with e as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings), s as (select vec_id, i, exp(x) / sum(exp(x)) over (partition by vec_id) as p from e)
select vec_id, i::int as i, round(p, 6) as p, r::int as r from (select *, row_number() over (partition by vec_id order by round(p, 6) desc, i) as r from s) where r <= 5""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform(V.softmax(F.col("embedding")), lambda x, i: F.struct((-F.round(x, 6)).alias("m"), i.alias("i")))
    top = _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.slice(F.array_sort(p), 1, 5)).alias("k", "x"))
    return top.select("vec_id", F.col("x.i").alias("i"), (-F.col("x.m")).alias("p"), (F.col("k") + 1).alias("r"))


@query("""with e as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings), s as (select *, exp(x) / sum(exp(x)) over (partition by vec_id) as p, row_number() over (partition by vec_id order by x desc, i) as r, count(*) over (partition by vec_id) as v from e),
c as (select *, sum(p) over (partition by vec_id order by r) - p as before from s)
select vec_id, count_if(r <= greatest(floor(0.1 * v), 1))::bigint as top_k, count_if(r = 1 or before <= 0.9)::bigint as top_p from c group by vec_id""")
def topk_topp_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many logits stay: of the tenth that is largest, and of a nucleus of 0.9 (the first always stays)."""
    from pyspark.sql import Window as W

    v = _vectors(spark, sf_dir)
    p = v.select("vec_id", F.size("embedding").alias("v"), F.posexplode(F.arrays_zip(F.col("embedding").alias("x"), V.softmax(F.col("embedding")).alias("p"))).alias("i", "z"))
    w = W.partitionBy("vec_id").orderBy(F.col("z.x").desc(), "i")
    ranked = p.select("vec_id", "v", F.row_number().over(w).alias("r"), (F.sum("z.p").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("z.p")).alias("before"))
    top_k = F.col("r") <= F.greatest(F.floor(F.lit(0.1) * F.col("v")), F.lit(1))
    return ranked.groupBy("vec_id").agg(F.count_if(top_k).alias("top_k"), F.count_if((F.col("r") == 1) | (F.col("before") <= 0.9)).alias("top_p"))


_LOGITS = "l as (select vec_id // 4 as id, (vec_id % 4)::int as feature, embedding::double[] as starts, list_reverse(embedding)::double[] as ends from embeddings)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand in for a span model's logits: four features to an example, the vector for starts and its reverse for ends."""
    e = F.col("embedding").cast("array<double>")
    return _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).cast("long").alias("id"), (F.col("vec_id") % 4).cast("int").alias("feature"), e.alias("starts"), F.reverse(e).alias("ends"))


_SPANS = f"""with {_LOGITS}, a as (select id, feature, unnest(starts) as x, unnest(range(len(starts)))::int as i from l), b as (select id, feature, unnest(ends) as x, unnest(range(len(ends)))::int as i from l),
sa as (select * from (select *, row_number() over (partition by id, feature order by x desc, i) as r from a) where r <= 20), sb as (select * from (select *, row_number() over (partition by id, feature order by x desc, i) as r from b) where r <= 20),
sp as (select * from (select *, row_number() over (partition by id order by score desc, feature, "start", "end")::int as rank from (select id, feature, sa.i as "start", sb.i as "end", round(sa.x + sb.x, 6) as score from sa join sb using (id, feature) where sa.i > 0 and sb.i >= sa.i and sb.i - sa.i + 1 <= 30)) where rank <= 20)"""


@query(_SPANS + ' select id, feature, "start", "end", score, rank from sp')
def span_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.best_spans(_logits(spark, sf_dir))


@query(_SPANS + """, n as (select id, round(min(starts[1] + ends[1]), 6) as s0 from l group by id), g as (select id, max(score) as m, list(score) as al, arg_min(sp."start", rank) as s, arg_min(sp."end", rank) as e, arg_min(score, rank) as sc from sp group by id)
select id, case when coalesce(s0 - sc > 0, true) then -1 else s end as "start", case when coalesce(s0 - sc > 0, true) then -1 else e end as "end",
  round(exp(sc - greatest(m, s0)) / (list_sum(list_transform(al, lambda x: exp(x - greatest(m, s0)))) + exp(s0 - greatest(m, s0))), 6) as probability, round(s0 - sc, 6) as null_odds from n left join g using (id)""")
def span_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.answers(_logits(spark, sf_dir))


@query("select vec_id, round((x + sqrt(x * x + 4)) / 2, 6) as squareplus, round(x * 2 + 1, 6) as mean, round(x * x * 4, 6) as variance, round(sqrt(x * x * 4), 6) as stddev, round(1 / (1 + exp(-x)), 6) as sigmoid, round(1 / (1 + exp(x - y)), 6) as entailment from (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)")
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    x = F.col("x")
    mean, variance, stddev = V.affine(x, x * x, F.lit(1.0), F.lit(2.0))
    named = {"squareplus": V.squareplus(x), "mean": mean, "variance": variance, "stddev": stddev, "sigmoid": V.sigmoid(x), "entailment": V.entailment(x, F.col("y"))}
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in named.items()])
