"""DuckDB twins of the queries of this subpackage that SQL can express."""

from __future__ import annotations

REPEATS = """
with texts as (
  select doc_id, hex(encode(coalesce(text, ''))) as digits from documents
), lists as (
  select doc_id, list_transform(range(0, greatest(0, len(digits) // 2 - 99)),
    lambda s: md5(substr(digits, 2 * s + 1, 200))) as sums
  from texts
), starts as (
  select doc_id, unnest(sums) as md5, generate_subscripts(sums, 1) - 1 as s from lists
), strings as (
  select doc_id, s, row_number() over (partition by md5 order by doc_id, s) as nth from starts
), again as (
  select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 100 then 0 else 1 end as opens
  from strings where nth > 1
), numbered as (
  select doc_id, s, sum(opens) over (partition by doc_id order by s) as run from again
), runs as (
  select doc_id, min(s) as a, max(s) + 100 as b from numbered group by doc_id, run
), gaps as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as from_byte from runs
), left_over as (
  select doc_id, sum(b - a) as n_removed, count(*) as n_spans,
    string_agg(substr(digits, 2 * from_byte + 1, 2 * (a - from_byte)), '' order by a)
      || any_value(substr(digits, 2 * (select max(r.b) from runs r where r.doc_id = gaps.doc_id) + 1)) as digits
  from gaps join texts using (doc_id) group by doc_id
)
select t.doc_id, (len(t.digits) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(l.digits, t.digits))) as kept_sha256
from texts t left join left_over l using (doc_id)
"""

EXACT = r"""
with bare as (
  select doc_id, length(coalesce(text, '')) as n_chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare
  from documents
), ranked as (
  select doc_id, bare,
    first_value(doc_id) over (partition by bare order by n_chars desc, doc_id) as keep_id,
    count(*) over (partition by bare) as group_size
  from bare
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from ranked
"""

WARC = """
with payloads as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), digests as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest, payload from payloads
), latest as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload) else page_id end as latest
  from digests
)
select page_id, payload_bytes, payload_digest,
  case when page_id = latest then 'response' else 'revisit' end as record_type,
  case when page_id <> latest then latest end as refers_to
from latest
"""

def _assigned(number: int) -> str:
    """Each vector's nearest centroid of table c{number}, the smaller number at ties."""
    return f"""
a{number} as (
  select vec_key, min(struct_pack(d := d, c := c)) as best from (
    select vec_key, c, list_sum(list_transform(list_zip(v.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from ints v, c{number} m)
  group by vec_key
)"""


def _moved(number: int) -> str:
    """Table c{number + 1}: centroids at floor(sum / count) of their vectors, empty ones where they were."""
    return f"""
s{number} as (
  select best.c as c, i, sum(x)::bigint as total, count(*) as n
  from (select vec_key, unnest(v) as x, generate_subscripts(v, 1) as i from ints) join a{number} using (vec_key)
  group by best.c, i
), m{number} as (
  select c, list((total - ((total % n) + n) % n) // n order by i) as v from s{number} group by c
), c{number + 1} as (
  select o.c, coalesce(m.v, o.v) as v from c{number} o left join m{number} m on m.c = o.c
)"""


CLUSTERS = f"""
with ints as materialized (
  select vec_id, row_number() over () as vec_key,
    list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id::varchar), v) - 1 as c, v from ints
  order by sha256('1:' || vec_id::varchar), v limit 16
), {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)}, {_moved(2)}, {_assigned(3)}
select vec_id, best.c::int as cluster, best.d as distance,
  sum(best.d) over (partition by best.c)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
  sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join ints using (vec_key) join c3 on c3.c = best.c
"""

RESAMPLE = r"""
with crc_table as (
  select list(list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]),
    lambda c, b: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end) order by i) as tab
  from range(256) t(i)
), texts as (
  select 's' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark
), split as (
  select side, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from texts
), tokens as (
  select side, id, unnest(ws) as w from split
), counted as (
  select side, id, w, count(*) as n from tokens group by all
), digits as (
  select w, hex(encode(w)) as d from (select distinct w from counted)
), hashed as (
  select w, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
      list_transform(range(len(d) // 2), lambda i: ('0x' || substr(d, 2 * i + 1, 2))::ubigint)),
    lambda c, b: xor(tab[(xor(c, b) & 255)::bigint + 1], c >> 8))) % 10000 as bucket
  from digits, crc_table
), sums as (
  select bucket, sum(n) filter (side = 's') as s, sum(n) filter (side = 't') as t
  from counted join hashed using (w) group by bucket
), totals as (
  select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from sums
), gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double
    / ((coalesce(s, 0) + 1)::double * (t_all + 10000)::double)))::bigint as gain from sums, totals
), weights as (
  select id, sum(n * gain)::bigint as weight from counted join hashed using (w) join gains using (bucket)
  where side = 's' group by id
), scored as (
  select id as doc_id, len(ws) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from split left join weights using (id) where side = 's'
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from ranked) then rank end as rank
from scored left join ranked using (doc_id)
"""

SQL: dict[str, str] = {
    "op2_suffix_dedup": REPEATS,
    "op7_exact_dedup": EXACT,
    "op9_warc": WARC,
    "op12_centroid_clusters": CLUSTERS,
    "op13_importance_resampling": RESAMPLE,
}
