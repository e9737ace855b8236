"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language_id, line_dedup, lm, neighbours, packing, pieces, quality, simhash, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_exact_top_k": topk.query,
    "op3_html_text": html_text.query,
    "op4_sentencepiece": pieces.query,
    "op5_nearest_neighbours": neighbours.query,
    "op6_language_id": language_id.query,
    "op7_line_dedup": line_dedup.query,
    "op8_quality_classifier": quality.query,
    "op9_lm_scoring": lm.query,
    "op10_simhash": simhash.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
with usable as (
  select vec_id, row_number() over () as row_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.row_id as query_row, q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score, c.row_id as row_id
  from usable q, usable c where q.vec_id % 20 = 0 and q.row_id <> c.row_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_row order by score desc, vec_id, row_id) as r from scored)
select query_id, r::int as rank, vec_id, score from ranked where r <= 20""",
    "op5_nearest_neighbours": """
with usable as (
  select vec_id, row_number() over () as row_id, list_transform(embedding, lambda x: x::double) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (
  select q.row_id as query_row, q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score, c.row_id as row_id
  from usable q, usable c where q.vec_id % 20 = 0 and q.row_id <> c.row_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_row order by score desc, vec_id, row_id) as r from scored)
select query_id, r::int as rank, vec_id, score from ranked where r <= 20""",
    "op7_line_dedup": """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
keyed as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
common as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where c.key is null), '')) as kept_sha256
from keyed left join common c using (key) group by doc_id""",
}
