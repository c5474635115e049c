"""The registered queries that SQL can express on whole tables, for DuckDB."""

from __future__ import annotations

OP2 = r"""
with words as (
  select item_id as id, 0 as side, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from benchmark
  union all
  select doc_id, 1, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') from documents
), runs as (
  select distinct side, id, array_to_string(w[i : i + 4], ' ') as s
  from (select side, id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)
), items as (
  select id as item_id, s, count(*) over (partition by id) as n_item from runs where side = 0
)
select d.id as doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item as containment
from (select * from runs where side = 1) d join items using (s)
group by d.id, item_id, n_item having count(*) * 5 >= n_item * 4
"""

OP5 = r"""
with turns as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
), placed as (
  select *, md5(md5(role) || md5(text)) as digest from turns
), running as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
         string_agg(digest, '/') over (w rows between unbounded preceding and current row) as path
  from placed window w as (partition by conv_id order by turn nulls first, role, digest)
), kept as (
  select min(conv_id) as conv_id, k as n_turns from running a where k = n
    and not exists (select 1 from running b where b.path = a.path and b.k < b.n) group by path, k
)
select conv_id, (k - 1) // 1000 as part, n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by k) as text
from running join kept using (conv_id) group by conv_id, part, n_turns
"""

OP10 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5(coalesce(text, '')) as digest,
         row_number() over (partition by doc_id, source, coalesce(text, '')) as place
  from documents
), sums as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from sized group by source
), ranked as (
  select *, 3 * source_size as cap, 3 * source_size / weight as ratio,
         sum(source_size) over ()::bigint as total, sum(weight) over ()::bigint as weights from sums
), judged as (
  select *, ratio < (total - coalesce(sum(cap) over w, 0)::bigint) / (weights - coalesce(sum(weight) over w, 0)::bigint) as capped
  from ranked window w as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)
), targets as (
  select source, source_size, case when capped then cap::double else
    weight * (total - coalesce(sum(cap) filter (capped) over (), 0)::bigint)::double
    / nullif(weights - coalesce(sum(weight) filter (capped) over (), 0)::bigint, 0) end as target
  from judged
), rated as (
  select doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) as rate,
         ('0x' || md5('0|' || coalesce(doc_id::varchar, 'null') || '|' || digest || '|' || place)[1:13])::bigint / 4503599627370496.0 as draw
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target, (floor(rate) + (draw < rate - floor(rate))::int)::int as copies,
       size * (floor(rate) + (draw < rate - floor(rate))::int)::bigint as taken from rated
"""

#: crc32 of the bytes of a text, its table worked out by rule.
CRC32 = r"""
crc_table as (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t
  from (select unnest(range(0, 256)) as n)
), texts_of_bytes as (
  select f, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint) as bytes
  from (select f, hex(encode(f)) as h from crc_texts)
), crc32_of as (
  select f, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from texts_of_bytes, crc_table
)"""

OP11 = r"""
with words as (
  select side, id, row_number() over () as row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select 0 as side, doc_id as id, coalesce(text, '') as text from documents union all select 1, item_id, coalesce(text, '') from benchmark)
), features as (
  select side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words
), crc_texts as (
  select distinct f from features
), """ + CRC32.strip() + r""", of_bucket as (
  select crc % 10000 as bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t
  from features join crc32_of using (f) group by bucket
), gains as (
  select bucket, floor(1000 * ln(((t + 1)::double * (sum(s) over () + 10000)::double) / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from of_bucket
), weights as (
  select row, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from features join crc32_of using (f) join gains on bucket = crc % 10000 where side = 0 group by row
), scored as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(id::varchar, 'null'))[1:8])::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from words left join weights using (row) where side = 0
)
select doc_id, n_features, weight, score,
       case when n_words >= 20 and row_number() over (order by (n_words < 20)::int, score desc, doc_id nulls last, n_features desc)
                 <= count(*) filter (n_words >= 20) over () * 25 // 100
            then row_number() over (order by (n_words < 20)::int, score desc, doc_id nulls last, n_features desc) end as rank
from scored
"""

OP12 = r"""
with ids as (
  select distinct conv_id as c from conversations where conv_id is not null
), crc_texts as (
  select c::varchar as f from ids
), """ + CRC32.strip() + r""", sequences as (
  select conv_id as c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
           order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as s
  from conversations where conv_id is not null group by conv_id
), rebuilt as (
  select own.c, list_concat(coalesce(first.s[: crc % 6], []), own.s[crc % 6 + 1 :]) as s
  from sequences own join crc32_of on f = own.c::varchar left join sequences first on first.c = own.c - own.c % 100
), nodes as (
  select d, s[: d] as path, count(*) as n_convs, min(c) as conv_id,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (len(s) = d), '')) as ends_sha256
  from (select c, s, unnest(range(0, len(s) + 1)) as d from rebuilt) group by d, s[: d]
), keyed as (
  select *, md5(path::varchar) || md5(list_reverse(path)::varchar) as k,
         case when d > 0 then md5(path[: d - 1]::varchar) || md5(list_reverse(path[: d - 1])::varchar) end as up,
         case when d > 0 then (n_convs - 1) * length(path[d].text) else 0 end as saved
  from nodes
), counted as (
  select *, (select count(*) from keyed b where b.up = a.k and b.d = a.d + 1) as n_children from keyed a
)
select a.conv_id, a.d as depth, p.conv_id as parent_conv_id, a.n_convs, a.n_children, a.ends_sha256, x.n_leaves, x.saved_tokens
from counted a left join keyed p on p.k = a.up and p.d = a.d - 1
join (select v.k, v.d, count(*) filter (m.n_children = 0) as n_leaves, sum(m.saved)::bigint as saved_tokens
      from counted v join counted m on m.d >= v.d and m.path[: v.d] = v.path group by v.k, v.d) x on x.k = a.k and x.d = a.d
"""

OP13 = r"""
with vectors as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from vectors q join vectors c on q.r <> c.r where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by r order by score desc, vec_id nulls last)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

STATEMENTS = {"op2_decontamination": OP2, "op5_chat_formatting": OP5, "op10_source_mixing": OP10, "op11_importance_resampling": OP11, "op12_conversation_trie": OP12,
              "op13_exact_top_k": OP13}
