"""Queries over texts: identity, duplicates, quality, tokens, answers and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batching as B
from ..operators import dedup as D
from ..operators import qa as Q
from ..operators import quality as G
from ..operators import stats as S
from ..operators import tokens as TK
from ..operators.order import slices
from ..sources import readers as R
from ..storage import cut, numbered
from .registry import query, table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- identity --------------------------------------------------------------------------------------------------
@query("select shard, n, (coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0))::bigint as first from (select source as shard, count(*) as n from documents group by source)")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shard_offsets(_docs(spark, sf_dir), shard_col="source")


@query("select doc_id, source, row_number() over (order by source, doc_id) - 1 as pos from documents")
def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id")


@query("select source as shard, array_to_string(list(doc_id order by doc_id), ',') as ids from documents group by source")
def file_doc_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.doc_lists(_docs(spark, sf_dir), shard_col="source").select("shard", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("select doc_id, source || '_' || lang as name, case when (doc_id % 100) < 10 then '0' || (doc_id % 100) else (doc_id % 100)::varchar end as shard, doc_id // 1000 as file_id, doc_id % 1000 as rel from documents")
def doc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names and places that documents have in shards: plain names, two-digit numbers, file and row by division."""
    n = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", X.plain_name(F.concat("source", F.lit("/"), "lang")).alias("name"), X.two_digits(n % 100).alias("shard"), F.floor(n / 1000).alias("file_id"), (n % 1000).alias("rel"))


@query("select doc_id, coalesce(case when doc_id % 2 = 0 then 'd' || doc_id end, source) as doc_name from documents")
def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), "doc_id")).alias("id"), F.struct(F.col("source").alias("filename")).alias("meta"))
    return G.metadata_id(d).select("doc_id", "doc_name")


@query("select doc_id, lang, n_chars from documents order by doc_id limit 100")
def corpus_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preview(_docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), 100)


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by source order by doc_id) as r from documents) where r <= 5")
def head_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.head_per_group(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), 5, group_col="source", order_col="doc_id")


@query("select doc_id, json_extract_string(j, '$.source') as source, json_extract(j, '$.n_chars')::bigint as n_chars from (select doc_id, to_json({'source': source, 'n_chars': n_chars}) as j from documents)")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.from_json(F.to_json(F.struct("source", "n_chars")), "source string, n_chars bigint")
    return _docs(spark, sf_dir).select("doc_id", j.alias("j")).select("doc_id", "j.source", "j.n_chars")


# --- duplicates ------------------------------------------------------------------------------------------------
_GRAMS = "case when length(p) >= 3 then list_distinct(list_transform(range(1, length(p) - 1), lambda k: substring(p, k::int, 3))) else []::varchar[] end"


@query(f"""with g as (select row_number() over (order by text, doc_id) as i, doc_id, {_GRAMS} as s from (select doc_id, text, substring(text, 1, 100) as p from documents where text is not null))
select b.doc_id as a, a.doc_id as b, round(len(list_intersect(a.s, b.s))::double / nullif(len(list_distinct(list_concat(a.s, b.s))), 0), 6) as jaccard from g a join g b on a.i = b.i + 1""")
def char_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of each document with the next one in the order of texts."""
    d = _docs(spark, sf_dir).where("text is not null")
    placed = numbered(d.select("text", "doc_id"), "text", "doc_id").select("doc_id", "pos")
    pairs = placed.select(F.col("doc_id").alias("a"), "pos").join(placed.select(F.col("doc_id").alias("b"), (F.col("pos") - 1).alias("pos")), "pos")
    return D.ngram_pairs(d, pairs.select("a", "b"))


@query(f"""with recursive r as materialized (select row_number() over (order by text, doc_id) - 1 as i, doc_id, substring(text, 1, 100) as p from documents where text is not null),
g as materialized (select i, doc_id, i // greatest(1, (select count(*) from r) // 32) as slice, {_GRAMS} as s from r),
w(i, doc_id, slice, keep, s) as (select i, doc_id, slice, true, s from g where i = 0
  union all
  select g.i, g.doc_id, g.slice, g.slice <> w.slice or coalesce(j <= 0.85, false), case when g.slice <> w.slice or coalesce(j <= 0.85, false) then g.s else w.s end
  from w join g on g.i = w.i + 1, lateral (select len(list_intersect(w.s, g.s))::double / nullif(len(list_distinct(list_concat(w.s, g.s))), 0) as j))
select doc_id, slice, i as pos, keep from w""")
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text is not null")
    placed = numbered(d.select("text", "doc_id"), "text", "doc_id", out="out_pos")
    return D.adjacent_dedup(slices(placed, 32))


@query(r"select doc_id, h as content_hash, min(doc_id) over (partition by h) as first_id, doc_id = min(doc_id) over (partition by h) as keep from (select doc_id, md5(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h from documents)")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_dedup(_docs(spark, sf_dir))


@query(r"select count(distinct h) as n_distinct, count(*) as n_docs, round(1 - count(distinct h) / count(*), 6) as duplicate_fraction from (select md5(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h from documents)")
def duplicate_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicate_fraction(D.exact_dedup(_docs(spark, sf_dir)))


_SETS = """with s0 as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') as al from documents), s1 as materialized (select doc_id, list_sort(list_distinct(al)) as toks from s0 where len(al) >= 10),
rep as materialized (select min(doc_id) as rep, toks from s1 group by toks), tok as materialized (select rep, len(toks) as n, unnest(toks) as tok from rep),
pr as (select a.rep as a, b.rep as b, count(*) as both, any_value(a.n) as na, any_value(b.n) as nb from tok a join tok b on a.tok = b.tok and a.rep < b.rep and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2)"""


@query(_SETS + ' select a, b, "both", na + nb - "both" as either from pr where 100 * "both" >= 85 * (na + nb - "both")')
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of token sets that are similar; a set is named by the smallest id that has it."""
    return D.similar_pairs(D.token_sets(_docs(spark, sf_dir))[0])


@query("""with s0 as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') as al from documents), s1 as (select doc_id, list_sort(list_distinct(al)) as toks from s0 where len(al) >= 10)
select doc_id, min(doc_id) over (partition by toks) as rep from s1""")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.token_sets(_docs(spark, sf_dir))[1]


@query()
def near_dup_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.extremes(_docs(spark, sf_dir))


# --- quality ---------------------------------------------------------------------------------------------------
def _any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _times(word: str) -> str:
    return f"((length(low) - length(replace(low, '{word}', ''))) / {len(word)})"


_HEAD = "lower(array_to_string(string_split(t, chr(10))[1:5], chr(10)))"
_FEATURES = rf"""with d as (select doc_id, coalesce(text, '') as t, lower(coalesce(text, '')) as low, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) as ls, {_WORDS} as w from documents),
f as (select doc_id, round(list_sum(ls)::double / len(ls), 6) as line_mean, list_max(ls) as line_max,
  round(coalesce(length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g'))::double / nullif(length(t), 0), 0), 6) as alnum_fraction, round(coalesce(length(t)::double / nullif(len(w), 0), 0), 6) as ratio,
  {_any(_HEAD, G.AUTOGENERATED)} as autogenerated, {_any(_HEAD, G.TESTS)} or {_times('config')} > floor(len(ls) * 0.05) or {_times('test')} > floor(len(ls) * 0.05) as config_or_test,
  not {_any('low', G.CODE)} as has_no_keywords, length(t) - length(replace(t, '=', '')) <= 4 as has_few_assignments from d)"""
_COLUMNS = "doc_id, line_mean, line_max, alnum_fraction, ratio, autogenerated, config_or_test, has_no_keywords, has_few_assignments"


@query(f"{_FEATURES} select doc_id, line_mean, line_max, alnum_fraction, ratio from f")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.features(_docs(spark, sf_dir)).select("doc_id", "line_mean", "line_max", "alnum_fraction", "ratio")


@query(f"{_FEATURES} select doc_id, autogenerated, config_or_test, has_no_keywords, has_few_assignments from f")
def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.features(_docs(spark, sf_dir)).select("doc_id", "autogenerated", "config_or_test", "has_no_keywords", "has_few_assignments")


@query(f"{_FEATURES} select {_COLUMNS} from f where line_max <= 1000 and line_mean <= 100 and alnum_fraction >= 0.25 and ratio >= 1.5 and not autogenerated and (not (config_or_test or has_no_keywords or has_few_assignments) or ('0x' || substr(md5(doc_id::varchar), 1, 7))::bigint % 1000 < 300)")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quality_filter(G.features(_docs(spark, sf_dir)))


@query("select doc_id from documents where ('0x' || substr(md5(doc_id::varchar || 'keep'), 1, 7))::bigint % 1000 < 300")
def hash_sample_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: three in ten documents, by hash."""
    return _docs(spark, sf_dir).where(G.chance(F.col("doc_id"), "keep") < 300).select("doc_id")


@query("select doc_id, score, r as rank from (select *, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from (select doc_id, (quality + toxic * 0.5)::double as score from labels) where score > 0.25) where r <= floor(n * 0.5)")
def pseudo_label_top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic") * 0.5).alias("score"))
    return G.confident_top(scored, score_col="score", least=0.25, share=0.5).select("doc_id", "score", "rank")


@query("select doc_id, case when quality = 1 then 'good' else 'bad' end as label, row_number() over (order by md5(doc_id::varchar || '7'), doc_id) - 1 as pos from labels")
def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hash_order(table(spark, sf_dir, "labels"), id_col="doc_id", seed="7").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), "pos")


@query("select event_id, value from events where case when event_id // 100 < 10 then value >= 1.0 else value >= -1.0 end")
def gain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("event_id") / 100))
    return G.gain_filter(e, step_col="step", gain_col="value").select("event_id", "value")


@query("select d.doc_id from documents d left join (select doc_id from labels where toxic = 1) l on l.doc_id = d.doc_id where length(coalesce(text, '')) < 16384 and lang <> 'null' and l.doc_id is null")
def length_and_index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = G.length_filter(_docs(spark, sf_dir), columns=["text"], below=16384, category_col="lang")
    return G.drop_indices(kept, table(spark, sf_dir, "labels").where("toxic = 1")).select("doc_id")


@query("select round(avg(l_tax), 6) as mean_loss, round(exp(avg(l_tax)), 6) as perplexity from lineitem")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.perplexity(table(spark, sf_dir, "lineitem"), loss_col="l_tax")


@query("select count(*) as workers, min(e) as expected, sum(n)::bigint as processed, min(e) = max(e) and sum(n) = min(e) as ok from (select l_linenumber, count(*) as n, (select count(*) from lineitem) as e from lineitem group by l_linenumber)")
def worker_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers stand for workers."""
    lines = table(spark, sf_dir, "lineitem")
    total = lines.agg(F.count(F.lit(1)).alias("num_chunks"))
    return S.accounting(lines.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("processed")).join(F.broadcast(total)))


# --- tokens ----------------------------------------------------------------------------------------------------
_BASIC = r"""array_to_string(list_filter(string_split_regex(regexp_replace(strip_accents(lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\t\n\r\p{Zs}]', ' ', 'g'), '[\x00\x{FFFD}\p{Cc}\p{Cf}]', '', 'g'), ' +', ' ', 'g')))), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}]', ' \0 ', 'g'), ' +'), lambda w: w <> ''), ' ')"""


@query(f"select doc_id, length(b) - length(replace(b, ' ', '')) + (b <> '')::int as n_tokens, md5(b) as digest from (select doc_id, {_BASIC} as b from documents)")
def basic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.basic_tokens(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", b.alias("b")).select("doc_id", F.size("b").cast("long").alias("n_tokens"), F.md5(F.array_join("b", " ")).alias("digest"))


def _vocabulary() -> list[str]:
    """Letters and pairs of letters, alone and as continuations: made by a rule, not learned."""
    letters = [chr(c) for c in range(97, 123)]
    return ["[UNK]", *(p + x for p in ("", "##") for x in [*letters, *(a + b for a in letters for b in letters)])]


@query()
def wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TK.wordpiece(F.col("b"), _vocabulary(), spark)
    out = _docs(spark, sf_dir).select("doc_id", X.basic_tokens(F.coalesce("text", F.lit(""))).alias("b")).select("doc_id", F.size("b").alias("n_words"), p.alias("p"))
    return out.select("doc_id", "n_words", F.size("p").alias("n_pieces"), F.size(F.filter("p", lambda x: x == "[UNK]")).alias("n_unknown"), F.md5(TK.to_text(F.col("p"))).alias("digest"))


@query(f"with t as (select unnest(list_transform({_WORDS}, lambda w: ('0x' || substr(md5(w), 1, 7))::bigint % 29000 + 1000)) as token from documents) select r.token, coalesce(n, 0)::bigint as n from (select unnest(range(30000)) as token) r left join (select token, count(*) as n from t group by token) using (token)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TK.token_counts(_docs(spark, sf_dir).select(X.hash_tokens(F.col("text")).alias("tokens")), X.FIRST_ID + X.IDS)


@query(f"select label, count(*) as n from (select unnest([lang, source]) as label from documents) group by label")
def label_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TK.label_frequencies(_docs(spark, sf_dir).select(F.array("lang", "source").alias("labels")), labels_col="labels")


@query("select doc_id, array_to_string(list_transform(['en', 'fr', 'de', 'es'], lambda v: (v = lang)::int), '') as hot from documents")
def multi_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = TK.multi_hot(F.array("lang"), ["en", "fr", "de", "es"])
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(hot, lambda x: x.cast("string")), "").alias("hot"))


@query(r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
b as (select *, (trim(line, ' ') = '' or starts_with(line, '-DOCSTART-'))::int as brk from l), r as (select *, sum(brk) over (partition by doc_id order by pos) as rec from b)
select doc_id, row_number() over (partition by doc_id order by rec) - 1 as record, n, first from (select doc_id, rec, count(*) as n, min(pos)::int as first from r where brk = 0 group by doc_id, rec)""")
def record_delimiter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return TK.delimited_records(lines, group_col="doc_id", order_col="pos")


@query(f"select doc_id, round(length(coalesce(text, ''))::double / nullif(len({_WORDS}), 0), 6) as ratio from documents")
def char_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", F.round(F.try_divide(F.length(t), F.size(X.words(t))), 6).alias("ratio"))


# --- answers ---------------------------------------------------------------------------------------------------
_NORMAL = r"list_filter(string_split_regex(regexp_replace(lower(text), '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the'))"


def _answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as the prediction for the next one."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("p")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("r")), "item_id")


@query(f"""with n as (select item_id, {_NORMAL} as w from benchmark), u as (select item_id, unnest(w) as x from n), c as (select item_id, x, count(*) as k from u group by 1, 2),
m as (select a.item_id, sum(least(a.k, b.k)) as hit from c a join c b on b.item_id = a.item_id + 1 and a.x = b.x group by a.item_id)
select a.item_id, round(coalesce(2.0 * hit / (len(a.w) + len(b.w)), 0), 6)::double as f1, (a.w = b.w)::int as em from n a join n b on b.item_id = a.item_id + 1 left join m on m.item_id = a.item_id""")
def normalize_answer_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = F.col("p"), F.col("r")
    return _answer_pairs(spark, sf_dir).select("item_id", F.round(Q.token_f1(p, r), 6).alias("f1"), Q.exact_match(p, r).alias("em"))


@query(rf"""with w as (select item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from benchmark), u as (select item_id, unnest(w) as g from w), c as (select item_id, g, count(*) as k from u group by 1, 2),
m as (select a.item_id, sum(least(a.k, b.k)) as hit from c a join c b on b.item_id = a.item_id + 1 and a.g = b.g group by a.item_id)
select a.item_id as id, round(coalesce(hit, 0)::double / len(a.w), 6) as precision, round(coalesce(hit, 0)::double / len(b.w), 6) as recall, round(2.0::double * coalesce(hit, 0) / (len(a.w) + len(b.w)), 6) as f1 from w a join w b on b.item_id = a.item_id + 1 left join m on m.item_id = a.item_id""")
def rouge_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _answer_pairs(spark, sf_dir).select(F.col("item_id").alias("id"), X.words(F.lower("p")).alias("prediction"), X.words(F.lower("r")).alias("reference"))
    return Q.rouge_n(pairs, 1)


@query("select item_id // 4 as question, round(max(length(text)) * 100.0, 6)::double as best from benchmark group by 1")
def best_over_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("question"), F.length("text").alias("m"))
    return Q.best_over_references(b, F.col("m"), id_col="question").select("question", F.round(F.col("best") * F.lit(100.0), 6).alias("best"))


@query(r"select c_custkey, round(c_acctbal, 2) as number from customer")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written with thousands separators, read back."""
    return table(spark, sf_dir, "customer").select("c_custkey", X.to_number(F.format_number("c_acctbal", 2)).alias("number"))


@query("""select n_name as value, 'equal' as kind from nation where n_regionkey = 1
union all select (max(c_acctbal))::varchar, 'max' from customer where c_mktsegment = 'BUILDING' and c_acctbal < 5000
union all select count(c_custkey)::varchar, 'count' from customer where c_nationkey > 10 and c_acctbal > 0""")
def table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    named = lambda df, kind: df.select(F.col("value").cast("string").alias("value"), F.lit(kind).alias("kind"))
    a = named(Q.table_query(nation, select="n_name", conditions=[("n_regionkey", "=", 1)]), "equal")
    b = named(Q.table_query(customer, select="c_acctbal", conditions=[("c_mktsegment", "=", "building"), ("c_acctbal", "<", 5000)], aggregate="max"), "max")
    c = named(Q.table_query(customer, select="c_custkey", conditions=[("c_nationkey", ">", 10), ("c_acctbal", ">", 0)], aggregate="count"), "count")
    return a.unionByName(b).unionByName(c)


@query("select n_nationkey as id, case when n_regionkey = 0 then n_name else 'COUNT > ' || n_name end as answer from nation")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    cells = nation.select(F.col("n_nationkey").alias("row"), F.lit(0).alias("col"), F.col("n_name").alias("value"))
    picks = nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, "NONE").otherwise("COUNT").alias("aggregator"), F.col("n_nationkey").alias("row"), F.lit(0).alias("col"))
    return Q.cell_answers(cells, picks)


@query("select r_regionkey as id, n_nationkey::varchar as value, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as row from region join nation on n_regionkey = r_regionkey")
def parsed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's text for each region, taken apart again."""
    n = table(spark, sf_dir, "nation")
    lines = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    text = F.concat(F.lit("key#name\n"), F.array_join(F.transform("x", lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit("#"), x["n_name"])), "\n"))
    return Q.parse_table(lines.select("id", text.alias("text"))).where("name = 'key'").select("id", "value", "row")


@query("select c_custkey, c_name || ' / ' || c_mktsegment || ' // ' || c_nationkey as passage, case when contains(c_name, '_') then replace(c_name, '_', 'x') else c_name || ' x' end as filled from customer")
def passage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.passage(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("passage"), X.fill_blank(F.col("c_name"), F.lit("x")).alias("filled"))


@query(r"""with w as (select item_id, text, list_filter(string_split_regex(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' '), lambda x: x <> '') as w from benchmark)
select item_id, len(list_distinct(list_concat([text], case when len(w) > 1 then [array_to_string(w[2:], ' '), array_to_string(w[:len(w) - 1], ' ')] else [] end, [trim(regexp_replace(regexp_replace(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))])))::int as n from w""")
def alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(X.aliases(F.col("text"))).alias("n"))


@query("select doc_id, case when contains(coalesce(text, ''), chr(10)) then regexp_extract(coalesce(text, ''), '(?s)^(.*)\\n.*$', 1) else coalesce(text, '') end as head from documents")
def stop_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.cut_at_last(F.coalesce("text", F.lit("")), ["\n"]).alias("head"))


# --- batches ---------------------------------------------------------------------------------------------------
@query("select doc_id, r - 1 as pos from (select doc_id, row_number() over (order by md5(doc_id::varchar || '1'), doc_id) as r from documents) where r <= 50")
def shuffle_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the first 50 of a seeded shuffle."""
    return B.shuffle_take(_docs(spark, sf_dir).select("doc_id"), 50, id_col="doc_id", seed="1")


@query("select doc_id, bucket, r // 8 as batch, r % 8 as place from (select *, row_number() over (partition by bucket order by n_chars desc, doc_id) - 1 as r from (select doc_id, n_chars, (row_number() over (order by md5(doc_id::varchar || '0'), doc_id) - 1) // 400 as bucket from documents))")
def sortish_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sortish(_docs(spark, sf_dir), id_col="doc_id", length_col="n_chars", batch=8)


_BINS = list(range(3, 20000, 400))
_BIN = f"len(list_filter({_BINS}, lambda b: b <= n_chars))"


@query(f"select bin, count(*) as n from (select {_BIN} as bin from documents) group by bin")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(B.length_bin(F.col("n_chars"), _BINS).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with p as (select doc_id as id, {_BIN} as g from documents), r as (select id, g, row_number() over (partition by g order by id) - 1 as r, count(*) over (partition by g) as n from p),
l as (select id, row_number() over (order by g, id) - 1 as q from r where r >= n // 16 * 16)
select id, g as "group", r // 16 as batch, r % 16 as place from r where r < n // 16 * 16 union all select id, -1, q // 16, q % 16 from l""")
def grouped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", B.length_bin(F.col("n_chars"), _BINS).alias("bin"))
    return B.grouped_batches(d, id_col="doc_id", group_col="bin", batch=16)


@query("with p as (select doc_id as id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents) select id, pos % 7 as shard, pos // 7 as place from (select id, pos from p union all select id, pos + n from p where pos < (n + 6) // 7 * 7 - n)")
def wraparound_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.wraparound_shards(_docs(spark, sf_dir), 7, id_col="doc_id")


@query("select id, pos // 64 as batch, pos % 64 as place from (select doc_id as id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents) where pos < n - n % 64")
def full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.full_batches(_docs(spark, sf_dir), 64, id_col="doc_id")


@query("select doc_id as id, (row_number() over (order by doc_id) - 1) * 5 // count(*) over () as shard from documents")
def contiguous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.contiguous_shards(_docs(spark, sf_dir), 5, id_col="doc_id")


@query()
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"), F.xxhash64("source").alias("g"))
    return B.token_budget_batches(d, id_col="doc_id", length_col="n", budget=65536, group_col="g")


@query("select doc_id, n_chars >= 4000 as at_length, n_chars - 100 >= 2000 as at_new, n_chars / 1000.0 > 3 as at_time, n_chars >= 4000 or n_chars - 100 >= 2000 or n_chars / 1000.0 > 3 as stop from documents")
def stop_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("length"), F.lit(100).alias("prompt_length"), (F.col("n_chars") / 1000).alias("seconds"))
    return B.stop_flags(d, max_length=4000, max_new=2000, max_time=3.0).select("doc_id", "at_length", "at_new", "at_time", "stop")


@query("select page_id, least(1000, greatest(0, 1000 * (page_id % 640) // 640))::bigint as x, least(1000, 1000 * (page_id % 480) // 480)::bigint as y from pages where length(html) > 0")
def normalized_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a page of 640 by 480 in thousandths; pages without content are left out."""
    p = table(spark, sf_dir, "pages").where(F.length("html") > 0)
    scaled = lambda size: F.least(F.lit(1000), F.greatest(F.lit(0), F.floor(1000 * (F.col("page_id") % size) / size))).cast("long")
    return p.select("page_id", scaled(640).alias("x"), scaled(480).alias("y"))
