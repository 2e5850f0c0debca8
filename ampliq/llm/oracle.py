"""DuckDB SQL for those queries of this folder that SQL can express."""

from __future__ import annotations

from ampliq.llm.chat import AND, CLOSE, NAMED, OPEN

_WORD = r"'[^\x20\x09-\x0D]+'"

OP5 = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) as size from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as nth
  from sized group by source
), weighed as (
  select *, [5, 2, 1][(nth % 3 + 1)::int] as weight, 3 * source_size as most from sources
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, nth rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by most / weight, nth rows between current row and unbounded following))::double as level
  from weighed
), opened as (
  select arg_min(level, (most / weight, nth)) filter (where most >= level * weight) as level from levels
), targets as (
  select source, nth, source_size, least(most::double, coalesce(opened.level, 0.0) * weight) as target,
    round(least(most::double, coalesce(opened.level, 0.0) * weight))::bigint as wanted
  from levels, opened
), bounds as (
  select nth, floor(coalesce(sum(wanted) over (order by nth rows between unbounded preceding and 1 preceding), 0)::double
    / (sum(wanted) over ())::double * 2147483648) as low, nth = max(nth) over () as final,
    floor(sum(wanted) over (order by nth)::double / (sum(wanted) over ())::double * 2147483648) as high
  from targets
), numbered as (
  select slot, (slot % 2147483648) * 1327217885 % 2147483648 as point
  from range((select case when sum(wanted) = 0 then 0 else (sum(wanted) + 63) // 64 + 4 * count(*) end from targets)::bigint) t(slot)
), n_slots as (
  select b.nth, count(*) as n from numbered s join bounds b on s.point >= b.low and (b.final or s.point < b.high) group by b.nth
), placed as (
  select s.doc_id, s.size, t.nth, t.source_size, t.target, t.wanted,
    coalesce(sum(s.size) over (partition by t.nth order by md5('7:' || coalesce(s.doc_id::varchar, '')), s.doc_id, s.size
      rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join targets t on s.source is not distinct from t.source
), passes as (
  select p.*, greatest(0, least(start + turn * source_size + size, wanted, coalesce(n, 0) * 64) - (start + turn * source_size)) as part
  from placed p left join n_slots using (nth), range(3) r(turn)
)
select doc_id, size, source_size, target, sum(part)::bigint as taken
from passes group by doc_id, size, source_size, target, nth, start
"""

OP6 = """
with whole as (
  select vec_id, [floor(256 * x::double) for x in embedding] as ints from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.ints, v.ints)::bigint as score
  from whole q join whole v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_ESCAPED = r"replace(replace(replace(replace({}, '\', '\s'), '###', '\h'), '<also>', '\a'), '</turn>', '\t')"
_SAID = r"'\### Assistant: </turn> ok'"

OP8 = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})
), marked as (
  select *, role is distinct from lag(role) over (partition by conv_id order by turn nulls first, role, text) as opens from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESCAPED.format("text")}) + case when opens then
    {len(OPEN) + len(NAMED) + len(CLOSE)} + length(replace({_ESCAPED.format("role")}, ': ', '\\c')) else {len(AND)} end)::bigint as formatted_chars
from marked group by conv_id
"""

OP9 = f"""
with recursive listed as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w
  from documents
), sets as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end) as s
  from listed
), shingles as materialized (
  select doc_id, hash(shingle) as h, shingle from (select doc_id, unnest(s) as shingle from sets)
), counted as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from shingles a join shingles b on a.h = b.h and a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as materialized (
  select a, b from counted join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * common >= 85 * (len(x.s) + len(y.s) - common)
), ways as materialized (select a, b from links union select b, a from links),
reached as (
  select doc_id, doc_id as component from sets
  union
  select ways.b, reached.component from reached join ways on ways.a = reached.doc_id
), smallest as (select doc_id, min(component) as component_id from reached group by doc_id)
select sets.doc_id, len(s)::bigint as n_shingles, component_id, sets.doc_id = component_id as kept
from sets join smallest using (doc_id)
"""

OP11 = """
with rows as (
  select page_id, coalesce(html, '') as body, min(page_id) over (partition by coalesce(html, '')) as first from pages
), typed as (
  select *, strlen(body) >= 100 and first is not null and page_id is distinct from first as again from rows
)
select page_id, strlen(body)::bigint as payload_bytes, sha256(body) as payload_digest,
  case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
from typed
"""

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as d,
    regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), groups as (
  select distinct lang, source from docs
), counts as materialized (
  select lang, source, term, count(*) as n, count(distinct d) as df
  from (select lang, source, d, unnest(terms) as term from docs) group by lang, source, term
), kept as materialized (
  select lang, term, sum(n)::hugeint as total from counts group by lang, term having sum(df) >= 10
), langs as (
  select g.lang, count(term)::hugeint as v, coalesce(sum(total), 0)::hugeint as size from (select distinct lang from groups) g left join kept using (lang) group by g.lang
), cells as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n, k.total
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sizes as (
  select lang, source, sum(n)::hugeint as size from cells group by lang, source
), shares as materialized (
  select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 2)) // (s.size + 2 * l.v) as p,
    1 + (1000000000::hugeint * (c.total + 2)) // (l.size + 2 * l.v) as q
  from cells c join sizes s using (lang, source) join langs l using (lang)
), pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), every_pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from shares where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (select * from every_pair union all select * from terms)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""

OP13 = rf"""
with docs as (
  select row_number() over () as d, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), asked as (
  select item_id, term, count(*) as repeats from (
    select item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark)
  ) group by item_id, term
), facts as (
  select count(*)::hugeint as docs, sum(len(terms))::hugeint as terms from docs where len(terms) > 0
), held as materialized (
  select d, term, count(*)::hugeint as tf from (select d, unnest(terms) as term from docs) semi join asked using (term) group by d, term
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, facts group by term, docs
), lengths as (
  select d, doc_id, 75 + (25 * len(docs.terms) * facts.docs) // facts.terms as m from docs, facts
), scored as (
  select a.item_id, l.d, l.doc_id, sum(a.repeats * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * l.m)))::bigint as score
  from asked a join held h using (term) join weights w using (term) join lengths l on l.d = h.d group by a.item_id, l.d, l.doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""

SQL = {
    "op5_mixing": OP5, "op6_topk": OP6, "op8_chat": OP8, "op9_near_duplicates": OP9, "op11_warc": OP11,
    "op12_divergence": OP12, "op13_search": OP13,
}
