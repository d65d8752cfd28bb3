"""SQL for DuckDB whose rows equal those of a query of this subpackage."""

op1_vector_approximation = """
with ints as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as double)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from ints q join ints c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0
),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

op11_line_bitmaps = """
with lines as (
  select doc_id, u.line as line, u.pos as pos, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents) d, lateral (select unnest(parts) as line, generate_subscripts(parts, 1) as pos) u
),
popular as (select key, max(doc_id) as keeper from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
told as (select l.doc_id, l.line, l.pos, p.keeper is not null and l.doc_id <> p.keeper as gone from lines l left join popular p on p.key = l.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from told group by doc_id
"""

op12_pivot_negatives = """
with ints as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (
  select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
  from ints a join ints c on a.vec_id <> c.vec_id and len(a.v) = len(c.v)
  where a.vec_id % 50 = 0
),
positives as (select anchor_id, other_id as positive_id, score as positive_score from pairs where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id) as integer) as rank, n.other_id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify rank <= 3
"""
