"""SQL for the queries that SQL can express; it must give the same rows on the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as n from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by n) as group_size, doc_id = first_value(doc_id) over w as kept, sha256(n) as text_sha256, length(t) as n_code_points
from n window w as (partition by n order by length(t) desc, doc_id)"""

OP3 = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' ')) end) as s from w),
u as materialized (select doc_id, len(s) as n, unnest(s) as x from s),
l as materialized (select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r as (select doc_id, doc_id as reach from s union select r.doc_id, l.b from r join l on l.a = r.reach),
c as (select doc_id, min(reach) as component_id from r group by doc_id)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from s join c using (doc_id)"""

OP4 = """with t as (select distinct conv_id, turn, role, text from conversations),
c as (select conv_id, count(*) as n, list({'role': role, 'text': text} order by turn, role, text) as s from t group by conv_id),
p as (select distinct s[1:k] as s from c, unnest(range(1, n)) u(k))
select min(conv_id) as conv_id, any_value(n) as n_turns, count(*) as n_copies,
  array_to_string(list_transform(c.s, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)), '') as rendered
from c anti join p on p.s = c.s group by c.s"""

_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""with d as materialized (select doc_id, {_ITEM_WORDS} as w from documents), i as (select item_id, {_ITEM_WORDS} as w from benchmark where text is not null),
p as materialized (select distinct item_id, least(len(w), 10) as n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as p from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(k) where len(w) > 0),
x as materialized (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from p))),
h as materialized (select doc_id, k, x.n, item_id from x join p on p.n = x.n and p.p = x.p),
q as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(k, k + n)) as place from h) group by doc_id),
g as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join q on q.doc_id = d.doc_id left join g on g.doc_id = d.doc_id"""

ORACLES = {"op2_exact_dedup": OP2, "op3_minhash_dedup": OP3, "op4_chat_format": OP4, "op9_decontaminate": OP9}
