"""DuckDB SQL for the queries whose results plain SQL can give, each written from the contract alone."""

from __future__ import annotations

#: Levels below a source's root and below the root that the SQL of the manifest has: 3^13 leaves, 3^5 sources.
SOURCE_LEVELS, TOP_LEVELS = 13, 5

CONTAMINATION = r"""
with item_words as (
  select cast(item_id as varchar) as item_id,
    list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') as w
  from benchmark where text is not null),
windows as materialized (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram
  from item_words, unnest(generate_series(1, greatest(len(w) - 9, 1))) as t(i) where len(w) > 0),
doc_words as materialized (
  select doc_id, row_number() over () as r, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') as w
  from documents),
grams as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as gram
  from doc_words, (select distinct n from windows) as lengths, unnest(generate_series(1, len(w) - n + 1)) as t(i)
  where len(w) >= n),
found as materialized (select r, i, n, item_id from grams join windows using (n, gram)),
hits as (
  select r, count(distinct p) as n_hit from found, unnest(generate_series(i, i + n - 1)) as t(p) group by r),
items as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hits using (r) left join items using (r)
"""

ARCHIVES = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
first as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as kept
  from payloads)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when kept <> page_id then 'revisit' else 'response' end as record_type,
  case when kept <> page_id then kept end as refers_to
from first
"""

TOP_K = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
met as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.w, c.w) as bigint) as score
  from whole q join whole c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from met qualify rank <= 10
"""


def _pivots(name: str, levels: int) -> str:
    """``name0`` has (s, i, d); further levels and the slot pivots between them."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}_p{k} as materialized (
  select s, i // 3 as i, max(case when i % 3 = 0 then d end) as c0, max(case when i % 3 = 1 then d end) as c1,
    max(case when i % 3 = 2 then d end) as c2
  from {name}{k} where n > 1 group by s, i // 3),
{name}{k + 1} as materialized (
  select p.s, p.i, sha256(concat(c0, c1, c2)) as d, count(*) over (partition by p.s) as n from {name}_p{k} p),""")
    roots = " union all ".join(f"select s, d from {name}{k} where n = 1" for k in range(levels + 1))
    return "".join(out) + f"\n{name}_roots as materialized ({roots}),"


def _fold(name: str, levels: int, start: str) -> str:
    """Siblings and the recomputed digest, level by level; ``start`` has (r, s, i, sib, up)."""
    out, last = [], start
    for k in range(levels):
        out.append(f"""
{name}_f{k} as materialized (
  select f.r, f.s, f.i // 3 as i, f.sib || coalesce(concat(case when f.i % 3 > 0 then c0 end, case when f.i % 3 = 2 then c1 end,
      case when f.i % 3 = 0 then c1 end, case when f.i % 3 < 2 then c2 end), '') as sib,
    case when p.s is null then up else sha256(concat(case when f.i % 3 > 0 then c0 end, case when f.i % 3 = 2 then c1 end, up,
      case when f.i % 3 = 0 then c1 end, case when f.i % 3 < 2 then c2 end)) end as up
  from {last} f left join {name}_p{k} p on p.s = f.s and p.i = f.i // 3),""")
        last = f"{name}_f{k}"
    return "".join(out)


def _field(column: str) -> str:
    return f"case when {column} is null then '-' else concat(strlen(cast({column} as varchar)), ':', {column}) end"


def _manifest() -> str:
    table = "v"
    for _ in range(8):
        table = f"(select i, xor(v >> 1, 3988292384 * (v & 1)) as v from {table})"
    table = table.replace("from v)", "from (select i, i as v from range(256) as t(i)))")
    leaf = ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))
    changed = ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "sent")))
    return f"""
with crc as (select list(v order by i) as t from {table}),
sums as (
  select *, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
      list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
      lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) as sum
  from documents, crc),
sent as (select *, case when sum % 2 = 0 then replace(text, chr(10), '') else text end as sent from sums),
leaves as materialized (
  select row_number() over () as r, doc_id, source, sha256(concat({leaf})) as leaf, sha256(concat({changed})) as received from sent),
a as materialized (
  select *, dense_rank() over (order by source nulls first) - 1 as s,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n
  from leaves),
l0 as (select s, i, leaf as d, n from a),{_pivots("l", SOURCE_LEVELS)}
t0 as materialized (select 0 as s, s as i, d, count(*) over () as n from l_roots),{_pivots("t", TOP_LEVELS)}
start as (select r, s, i, '' as sib, received as up from a),{_fold("l", SOURCE_LEVELS, "start")}
above as (select r, 0 as s, s as i, sib, up from l_f{SOURCE_LEVELS - 1}),{_fold("t", TOP_LEVELS, "above")}
done as (select r, sib, up from t_f{TOP_LEVELS - 1})
select doc_id, leaf, l_roots.d as subroot, t_roots.d as root, sha256(sib) as proof_sha256, up as folded_root, up = t_roots.d as verified
from a join done using (r) join l_roots on l_roots.s = a.s, t_roots
"""


def oracles() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": CONTAMINATION,
        "op6_warc": ARCHIVES,
        "op11_bit_sliced_top_k": TOP_K,
        "op12_merkle_manifest": _manifest(),
    }
