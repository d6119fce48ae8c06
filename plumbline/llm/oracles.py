"""DuckDB SQL for the queries that SQL can express."""

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op5_benchmark_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
iw as (select distinct item, least(10, len(w)) as n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as win
       from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
hits as (select doc_id, s, iw.n, item from dw join iw on dw.win = iw.win and dw.n = iw.n),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by 1),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join items using (doc_id)""",
    "op7_line_dedup": """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (where f.key is not null and doc_id <> keeper) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null or doc_id = keeper), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id""",
    "op9_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
}
