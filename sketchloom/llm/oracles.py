"""DuckDB SQL for those of the ten queries that SQL expresses over whole tables."""

OP1 = r"""
with d as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         case when q.q is null then 1.0 when q.q > 0 then 2.0 else 0.5 end::double as w
  from documents d left join (select doc_id, max(quality) as q from labels where doc_id is not null group by 1) q using (doc_id)
), k as (
  select *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double) / w as key from d
), s as (
  select source, sum(size)::bigint as source_size from d group by 1
), sw as (
  select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as weight from s
), o as (
  select *, sum(source_size) over () * 1.5::double as budget,
         coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0)::double as cap_before,
         sum(weight) over (order by 2 * source_size / weight, source is null, source rows between current row and unbounded following) as weight_from
  from sw
), c as (
  select *, budget - cap_before >= 2 * source_size / weight * weight_from as capped from o
), t as (
  select source, source_size,
         case when capped then (2 * source_size)::double
              else weight * (budget - coalesce(sum(case when capped then 2 * source_size end) over (), 0)::double) / sum(case when not capped then weight end) over () end as target
  from c
), p as (
  select k.*, t.source_size, t.target,
         coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::double as before,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as epochs
  from k join t on k.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       ((epochs + case when before + size / 2.0::double <= target - epochs * source_size and size > 0 then 1 else 0 end) * size)::bigint as taken,
       source, (epochs + case when before + size / 2.0::double <= target - epochs * source_size and size > 0 then 1 else 0 end)::bigint as copies
from p
"""

OP10 = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, length('[INST]' || regexp_replace(regexp_replace(role, '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g'), '(<)(\\*)(/?s>)', '\1\\\2\3', 'g') || '[/INST]'
                   || regexp_replace(regexp_replace(text, '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g'), '(<)(\\*)(/?s>)', '\1\\\2\3', 'g') || '</s>') as n,
         lag(role, 1, 'start') over (partition by conv_id order by turn nulls first, role, text) as state,
         row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as back
  from r
), f as (
  select *, (state || '>' || role) in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant')
            and (back > 1 or role = 'assistant') as fits
  from e
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
       sum(n)::bigint as formatted_chars, bool_and(fits) as valid
from f group by conv_id
"""

#: Windows as joined words; a document word is hit if a matching window starts at most its length before it.
OP3 = r"""
with b as (
  select item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from benchmark)
), bw as (
  select distinct item_id, least(len(w), 13)::bigint as k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from b where len(w) > 0)
), d as (
  select row_number() over () as uid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as w
  from documents
), ks as (select distinct k from bw), dw as (
  select uid, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select uid, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, ks where len(w) >= k)
), m as (
  select dw.uid, dw.i, bw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.win = bw.win
), h as (
  select uid, count(distinct j) as n_hit from (select uid, unnest(generate_series(i, i + k - 1)) as j from m) group by 1
), it as (
  select uid, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct uid, item_id::varchar as id from m where item_id is not null) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (uid) left join it using (uid)
"""


#: Leaves and templates as strings where the operator has hashes of them.
OP5 = r"""
with d as (select row_number() over () as uid, doc_id, text from documents),
l as (
  select uid, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as tok
  from (select uid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d where text is not null)
), m as (
  select uid, k, len(tok) as n, tok, list_transform(tok, lambda t: case when regexp_matches(t, '[0-9]') then chr(0) else t end) as mask from l where len(tok) > 0
), w as (
  select uid, k, n, i, tok[i] as t, n::varchar || ' ' || array_to_string(mask[1:2], ' ') as leaf from (select *, unnest(range(3, n + 1)) as i from m where n >= 4) where mask[i] <> chr(0)
), c as (select leaf, i, t from w group by all having count(distinct uid) >= 5),
f as (select w.uid, w.k, list(w.i) as fields from w left join c on w.leaf = c.leaf and w.i = c.i and w.t = c.t where c.t is null group by all),
s as (
  select uid, k, n, case when 2 * len(list_filter(mask, lambda t: t <> chr(0))) >= n then mask else tok end as sig from m
  union all
  select m.uid, m.k, n, list_transform(mask, lambda t, i: case when list_contains(fields, i) then chr(0) else t end) as sig
  from m join f on m.uid = f.uid and m.k = f.k
  where len(list_filter(fields, lambda i: list_contains(fields, i + 1))) = 0 and 5 * (len(list_filter(mask, lambda t: t <> chr(0))) - len(fields)) >= 3 * n
), r as (
  select n, sig from s group by all having count(distinct uid) >= 5 or (n >= 50 and not list_contains(sig, chr(0)) and count(distinct uid) >= 2)
), g as (select distinct uid, k from s join r on s.n = r.n and s.sig = r.sig),
o as (
  select l.uid, count(*) as n_lines, count(g.uid) as n_dropped,
         coalesce(string_agg(case when g.uid is null then line end, chr(10) order by l.k), '') as kept
  from l left join g on l.uid = g.uid and l.k = g.k group by l.uid
)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped,
       sha256(coalesce(kept, '')) as kept_sha256, octet_length(encode(coalesce(kept, '')))::bigint as kept_bytes
from d left join o using (uid)
"""


OP8 = r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
g as (select h as body, max(page_id) as top from p group by 1)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(s, ((i // 4) * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
       case when page_id < top then 'revisit' else 'response' end as record_type,
       case when page_id < top then top end as refers_to, true as complete
from p join g on p.h = g.body
"""


#: Every string of 200 bytes, in hexadecimal digits; runs of removed bytes from the strings that start twice.
OP4 = r"""
with d as (select row_number() over () as uid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select uid, 1024 * j as base, h[2048 * j + 1:2048 * j + 2446] as p from (select uid, h, unnest(range(0, len(h) // 2048 + 1)) as j from d where len(h) >= 400)),
w as (select uid, base + i as i, md5(p[2 * i + 1:2 * i + 400]) as k from (select uid, base, p, unnest(range(0, least(1024, len(p) // 2 - 199))) as i from c where len(p) >= 400)),
r as (select uid, i from w where k in (select k from w group by k having count(*) > 1)),
g as (select uid, i, sum(new) over (partition by uid order by i) as run from (select uid, i, case when i - lag(i) over (partition by uid order by i) <= 200 then 0 else 1 end as new from r)),
x as (select uid, min(i) as a, max(i) + 200 as b from g group by uid, run),
y as (select uid, a, b, coalesce(lag(b) over (partition by uid order by a), 0) as before from x),
z as (
  select y.uid, count(*) as n_spans, sum(b - a) as n_removed, string_agg(h[2 * before + 1:2 * a], '' order by a) || any_value(h)[2 * max(b) + 1:] as kept
  from y join d using (uid) group by 1
)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join z using (uid)
"""

#: The true neighbours; the operator's radius is measured on all queries where they are few, so it finds them all there.
OP9 = r"""
with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
n as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from e),
p as (select q.vec_id as query_id, d.vec_id, list_dot_product(d.v, q.v) / (d.n * q.n) as score from n d, n q where q.vec_id % 50 = 0 and d.vec_id <> q.vec_id and d.n > 0 and q.n > 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p) where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op3_decontaminate": OP3, "op4_suffix_dedup": OP4, "op5_line_dedup": OP5, "op8_warc": OP8, "op9_nearest": OP9, "op10_chat_format": OP10}
