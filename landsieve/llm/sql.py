"""Reference SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from landsieve.llm import quality as q

ORACLE: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE["op6_line_rules"] = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] as ws from d),
win as (select rid, i, array_to_string(ws[i:i + 4], ' ') as k from w, unnest(range(1, len(ws) - 3)) as u(i)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from win) where c > 1),
cov as (select rid, sum(least(5, coalesce(nxt - i, 5))) as n
        from (select rid, i, lead(i) over (partition by rid order by i) as nxt from rep) group by rid),
li as (select rid, x, len([y for y in string_split_regex(x, '[\x20\x09-\x0D]+') if y <> '']) as nw,
              length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) as chars,
              len(regexp_extract_all(x, '{q.SEPARATORS}')) as seps, len(regexp_extract_all(x, '{q.SYMBOLS}')) as syms,
              len(regexp_extract_all(x, '{q.SHOUTS}')) as shouts
       from (select rid, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]')),
bad as (select *, (seps >= {q.MIN_SEPARATORS} and seps * 100 >= nw * {q.SEPARATOR_PERCENT})
               or (nw >= {q.SENTENCE_WORDS} and not regexp_matches(x, {_quoted(q.FINAL)}))
               or syms * 100 > nw * {q.MAX_SYMBOL_PERCENT} or shouts * 100 > nw * {q.MAX_SHOUT_PERCENT}
               or regexp_matches(lower(x), {_quoted('|'.join(q.BOILERPLATE))}) as fails from li),
ls as (select rid, count(*) - count(distinct x) as dups, coalesce(sum(chars) filter (where fails), 0) as lost
       from bad group by rid),
m as (select w.rid, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
             len(regexp_extract_all(t, '{q.SYMBOLS}')) as n_symbols, coalesce(dups, 0) as n_dup_lines,
             coalesce(cov.n, 0) as n_repeat_words, coalesce(lost, 0) as lost_chars
      from w left join ls on w.rid = ls.rid left join cov on w.rid = cov.rid),
b as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, lost_chars::bigint as lost_chars,
       base_failed, not base_failed and not lost_chars * 100 > word_chars * {q.MAX_LOST_PERCENT} as kept from b
"""

ORACLE["op5_line_windows"] = r"""
with d as (select distinct doc_id, text from documents),
n as (select row_number() over (order by doc_id nulls last, md5(text)) as rid, doc_id, text from d),
s as (select rid, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i
      from n where text is not null),
li as (select rid, x, row_number() over (partition by rid order by i) - 1 as pos from s
       where regexp_matches(x, '[^\x20\x09-\x0D]')),
win as (select rid, pos, x || chr(10) || lead(x, 1) over o || chr(10) || lead(x, 2) over o as k from li
        window o as (partition by rid order by pos)),
occ as (select rid, pos, first_value(rid) over f as rid1, first_value(pos) over f as pos1 from win where k is not null
        window f as (partition by k order by rid, pos)),
cov as (select distinct rid, unnest(range(case when rid = rid1 then greatest(pos, pos1 + 3) else pos end, pos + 3)) as pos
        from occ where not (rid = rid1 and pos = pos1)),
kept as (select li.rid, count(*) as n_lines, count(cov.pos) as n_removed,
                string_agg(case when cov.pos is null then x end, chr(10) order by li.pos) as t
         from li left join cov on li.rid = cov.rid and li.pos = cov.pos group by li.rid)
select o.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       md5(case when coalesce(n_removed, 0) = 0 then o.text else coalesce(t, '') end) as text_md5
from documents o join n on o.doc_id is not distinct from n.doc_id and o.text is not distinct from n.text
left join kept on n.rid = kept.rid
"""

ORACLE["op4_threshold_top_k"] = """
with v as (select distinct vec_id, [floor(64 * x::double)::bigint for x in embedding] as z from embeddings
           where vec_id is not null and embedding is not null
           and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select q.vec_id as query_id, q.z as qz, c.vec_id as vec_id,
             list_inner_product(q.z::double[], c.z::double[])::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id, qz order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
"""

ORACLE["op12_packed_negatives"] = """
with r as (select distinct vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
                  [floor(256 * x::double)::bigint for x in embedding] as z from embeddings
           where vec_id is not null and label is not null and embedding is not null
           and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (select a.vec_id as anchor_id, a.label as al, a.z as az, c.vec_id, c.label,
             list_inner_product(a.z::double[], c.z::double[])::bigint as score
      from r a join r c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select * from (select anchor_id, al, az, vec_id as positive_id, score as positive_score,
                            row_number() over (partition by anchor_id, al, az order by score desc, vec_id) as pr
                     from s where label = al) where pr <= 5),
n as (select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
             row_number() over (partition by p.anchor_id, p.al, p.az, p.pr order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor_id = p.anchor_id and s.al = p.al and s.az = p.az and s.label <> p.al
      and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


def _walk(name: str, start: str, groups: str) -> str:
    """Paths up one tree: the digests beside a node are added to its proof and folded into its digest."""
    before, after = "array_to_string(g.hs[1:w.pos % 16], '')", "array_to_string(g.hs[w.pos % 16 + 2:], '')"
    return f"""{name} as (select *, 0 as lvl from ({start}) union all
 select w.rid, w.tree, w.pos // 16, sha256({before} || w.f || {after}), w.proof || {before} || {after}, w.lvl + 1
 from {name} w join {groups} g on g.lvl = w.lvl and g.tree = w.tree and g.node = w.pos // 16)"""


_ORDER = "tree, doc_id nulls first, leaf"
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""

ORACLE["op11_merkle_manifest"] = f"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce('+' || source, '') as tree,
  sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) as leaf,
  case when {_CRC} % 5 = 0 then sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || coalesce(strlen(text) || ':'
   || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as altered from documents),
e as (select *, row_number() over (partition by tree order by {_ORDER.removeprefix('tree, ')}) - 1 as pos, count(*) over (partition by tree) as n from d),
lev as (select 0 as lvl, tree, pos, leaf as h, n from e
 union all select lvl + 1, tree, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from lev where n > 1 group by lvl, tree, pos // 16, n),
grp as (select lvl, tree, pos // 16 as node, list(h order by pos) as hs from lev where n > 1 group by 1, 2, 3),
sub as (select tree as name, h as subroot, 'all' as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n from lev where n = 1),
rlev as (select 0 as lvl, tree, pos, subroot as h, n from sub
 union all select lvl + 1, tree, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from rlev where n > 1 group by lvl, tree, pos // 16, n),
rgrp as (select lvl, tree, pos // 16 as node, list(h order by pos) as hs from rlev where n > 1 group by 1, 2, 3),
{_walk('w', "select rid, tree, pos, coalesce(altered, leaf) as f, '' as proof from e", 'grp')},
own as (select rid, arg_max(f, lvl) as f, arg_max(proof, lvl) as proof from w group by rid),
{_walk('v', "select o.rid, s.tree, s.pos, o.f, o.proof from own o join d on d.rid = o.rid join sub s on s.name = d.tree", 'rgrp')},
up as (select rid, arg_max(f, lvl) as folded_root, sha256(arg_max(proof, lvl)) as proof_sha256 from v group by rid)
select doc_id, leaf, subroot, r.h as root, proof_sha256, folded_root, folded_root = r.h as verified
from d join up on up.rid = d.rid join sub on sub.name = d.tree, (select h from rlev where n = 1) r
"""
