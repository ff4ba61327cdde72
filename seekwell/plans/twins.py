"""The same results in SQL, written from what each query means, for the check tool."""

from __future__ import annotations

from seekwell.plans.parameters import BANDS, BITS, JOIN_COSINE

_TERMS = r"""
  list_filter(string_split(trim(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'))), ' '),
              lambda x: x <> '')
"""

CHUNKS = r"""
with split as (
  select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from documents
), starts as (
  select doc_id, ws, unnest(range(0, 1 + greatest(0, (len(ws) - 64 + 47) // 48))) as chunk
  from split where len(ws) > 0
), cut as (
  select doc_id, chunk, ws[chunk * 48 + 1 : chunk * 48 + 64] as part from starts
)
select doc_id, chunk, len(part) as n_words, array_to_string(part, ' ') as text from cut
"""

INDEX = f"""
with split as (
  select doc_id, {_TERMS} as ws from documents
), tokens as (
  select doc_id, len(ws) as doc_len, unnest(ws) as term from split
), entries as (
  select term, doc_id, doc_len, count(*) as tf from tokens group by all
)
select term, doc_id, tf, count(*) over (partition by term) as df, doc_len from entries
"""


TERMS = f"""
with split as (
  select doc_id, {_TERMS} as ws from documents
), once as (
  select unnest(list_distinct(ws)) as term from split
)
select term, count(*) as df, 0::bigint as total_len from once group by term
union all
select '' as term, count(*) as df, coalesce(sum(len(ws)), 0)::bigint as total_len from split
"""


def _scored(items: str, key: str) -> str:
    """Common tables up to `scored`: query, {key}, bm25, tfidf for pairs that share a term."""
    return f"""
items as ({items}),
lengths as (select {key}, len({_TERMS}) as doc_len from items),
tf as (select {key}, term, count(*) as tf
       from (select {key}, unnest({_TERMS}) as term from items) group by all),
df as (select term, count(*) as df from tf group by term),
whole as (select count(*) as n, avg(doc_len) as mean_len from lengths),
asked as (select query, term, count(*) as qtf
          from (select item_id as query, unnest({_TERMS}) as term from benchmark) group by all),
scored as (
  select query, {key},
    round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5))
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) as bm25,
    round(sum(qtf * ln(1 + n / df) * (1 + ln(tf)) / sqrt(doc_len)), 6) as tfidf
  from asked join tf using (term) join df using (term) join lengths using ({key}), whole
  group by query, {key})
"""


_DOCUMENTS = "select doc_id, text from documents"

BM25 = f"""
with {_scored(_DOCUMENTS, "doc_id")},
ranked as (select query, doc_id, bm25 as score,
           row_number() over (partition by query order by bm25 desc, doc_id) as rank from scored)
select query, rank, doc_id, score from ranked where rank <= 10
"""

FUSION = f"""
with {_scored(_DOCUMENTS, "doc_id")},
ranked as (
  select query, doc_id, row_number() over (partition by query order by bm25 desc, doc_id) as rank from scored
  union all
  select query, doc_id, row_number() over (partition by query order by tfidf desc, doc_id) as rank from scored
),
fused as (select query, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, count(*) as n_lists
          from ranked group by query, doc_id),
final as (select *, row_number() over (partition by query order by score desc, doc_id) as rank from fused)
select query, rank, doc_id, score, n_lists from final where rank <= 10
"""

PACK = f"""
with {_scored(CHUNKS, "doc_id, chunk")},
ranked as (
  select query, doc_id, chunk, bm25 as score, n_words, text,
    row_number() over best as rank, sum(n_words) over best as words_used
  from scored join items using (doc_id, chunk)
  window best as (partition by query order by bm25 desc, doc_id, chunk)
)
select query, rank, doc_id, chunk, score, n_words, words_used::bigint as words_used, text
from ranked where words_used <= 256
"""

KNN = """
with pairs as (
  select a.vec_id as query, b.vec_id as neighbour,
    round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
  from embeddings a join embeddings b on a.vec_id <> b.vec_id
), ranked as (
  select *, row_number() over (partition by query order by score desc, neighbour) as rank from pairs
)
select query, rank, neighbour, score from ranked where rank <= 10
"""

LSH = f"""
with planes as (
  select p, list(case when substr(md5(p::varchar || ':' || j::varchar), 1, 1) < '8'
                 then 1.0::double else -1.0::double end order by j) as plane
  from range({BANDS} * {BITS}) t(p), range(64) u(j) group by p
), buckets as (
  select vec_id, p // {BITS} as band,
    sum(case when list_dot_product(embedding::double[], plane) > 0 then 1 << (p % {BITS}) else 0 end) as bucket
  from embeddings, planes group by vec_id, p // {BITS}
), met as (
  select distinct a.vec_id as query, b.vec_id as neighbour
  from buckets a join buckets b on a.band = b.band and a.bucket = b.bucket and a.vec_id <> b.vec_id
), scored as (
  select query, neighbour,
    round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
  from met join embeddings a on a.vec_id = query join embeddings b on b.vec_id = neighbour
), ranked as (
  select *, row_number() over (partition by query order by score desc, neighbour) as rank from scored
)
select query, rank, neighbour, score from ranked where rank <= 10
"""

JOIN = f"""
with pairs as (
  select a.vec_id, count(*) as links from embeddings a join embeddings b on a.vec_id <> b.vec_id
  where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= {JOIN_COSINE}
  group by a.vec_id
)
select vec_id, min(vec_id) over (partition by embedding) as class_id, coalesce(links, 0) as links
from embeddings left join pairs using (vec_id)
"""

WINDOWS = """
with starts as (
  select *, unnest(range(epoch_us(ts) - epoch_us(ts) % 900000000 - 2700000000,
                         epoch_us(ts) - epoch_us(ts) % 900000000 + 1, 900000000)) as window_start
  from events
)
select event_type, window_start, window_start + 3600000000 as window_end, count(*) as n,
  round(sum(value), 6) as total, min(value) as least, max(value) as most
from starts group by event_type, window_start
"""

SESSIONS = """
with marked as (
  select *, epoch_us(ts) as us,
    case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 1800000000 then 0 else 1 end as opens
  from events where ts is not null
), numbered as (
  select *, sum(opens) over (partition by user_id order by us) as run from marked
)
select user_id, min(us) as session_start, max(us) + 1800000000 as session_end, count(*) as n, round(sum(value), 6) as total
from numbered group by user_id, run
"""

WATERMARK = "(select max(epoch_us(ts)) - 3600000000 from events)"
CLOSED_WINDOWS = f"select * from ({WINDOWS}) where window_end <= {WATERMARK}"
CLOSED_SESSIONS = f"select * from ({SESSIONS}) where session_end <= {WATERMARK}"

SQL: dict[str, str] = {
    "chunk_documents": CHUNKS,
    "inverted_index": INDEX,
    "bm25_topk": BM25,
    "rank_fusion": FUSION,
    "context_pack": PACK,
    "knn_topk": KNN,
    "knn_lsh": LSH,
    "vector_join": JOIN,
    "stream_ingest": INDEX,
    "dictionary": TERMS,
    "rank_index": BM25,
    "event_windows": WINDOWS,
    "event_sessions": SESSIONS,
    "stream_dedup": "select event_id, epoch_us(ts) as ts, user_id, event_type, value, props from events",
    "stream_windows": CLOSED_WINDOWS,
    "stream_sessions": CLOSED_SESSIONS,
}
