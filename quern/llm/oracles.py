"""DuckDB SQL for the operators that SQL can express."""

MIXING = r"""
with sized as (
  select row_number() over () as rid, doc_id, source, case when doc_id is null then 'null|' || md5(coalesce(text, '')) else doc_id::varchar end as drawn_by,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per as (
  select source, sum(size)::bigint as source_size, count(*) as n_docs from sized group by source),
weighted as (
  select *, ([5, 2, 1])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::bigint as weight, source_size * 3 as cap from per),
filled as (
  select *, cap::double / weight as fills_at, sum(source_size) over () as all_size from weighted),
levels as (
  select *, (all_size - coalesce(sum(cap) over before, 0))::double / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from filled window before as (order by fills_at, source asc nulls last rows between unbounded preceding and 1 preceding)),
aimed as (
  select *, least(cap::double, coalesce(max(case when fills_at >= level then level end) over (), 'infinity'::double) * weight) as target from levels),
plan as (
  select source, source_size, n_docs, target, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from aimed),
sources as (
  select s.rid, s.doc_id, s.drawn_by, s.source, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as rest,
    case when s.size > 0 and p.source_size > 0 then pow(2.0::double, least(8.0::double, greatest(-8.0::double, round(log2(s.size::double * p.n_docs / p.source_size) * 4))) / 4) end as measure
  from sized s join plan p on s.source is not distinct from p.source),
measures as (
  select source, measure, sum(size) as words, any_value(rest) as rest from sources where rest > 0 and size > 0 group by source, measure),
tried as (
  select *, coalesce(sum(words) over (partition by source order by measure desc rows between unbounded preceding and 1 preceding), 0) as before,
    (rest - before) / sum(measure * words) over (partition by source order by measure desc rows between current row and unbounded following) as c from measures),
odds as (
  select source, coalesce(arg_max(c, measure) filter (c * measure < 1), 'infinity'::double) as c, coalesce(arg_max(before, measure) filter (c * measure < 1), sum(words)) as certain
  from tried group by source),
ranked as (
  select s.*, s.rest - coalesce(o.certain, 0) as left_over, case when s.rest > 0 and s.size > 0 then least(1.0::double, o.c * s.measure) else 0 end as p,
    (('0x' || substr(md5(s.drawn_by || '|42'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u,
    case when p > 0 and p < 1 then u / (1 - u) * (1 - p) / p end as rank
  from sources s left join odds o on s.source is not distinct from o.source),
summed as (
  select *, sum(size) over (partition by source order by rank, doc_id nulls first, size) as upto from ranked where rank is not null and left_over > 0),
got as (
  select source, coalesce(max(case when upto <= left_over then upto end), 0) as got from summed group by source),
extra as (
  select s.source, arg_min({'k': s.rank, 'id': s.doc_id, 'n': s.size}, (abs(s.left_over - g.got - s.size), s.rank, s.doc_id, s.size)) as extra
  from summed s join got g on s.source is not distinct from g.source
  where s.upto > s.left_over and abs(s.left_over - g.got - s.size) < s.left_over - g.got group by s.source)
select r.doc_id, r.size, r.source_size, r.target,
  (r.size * (r.whole + case when r.whole < 3 and (r.p >= 1 or s.upto <= r.left_over or (s.upto is not null and e.extra is not null and {'k': r.rank, 'id': r.doc_id, 'n': r.size} is not distinct from e.extra)) then 1 else 0 end))::bigint as taken
from ranked r
left join summed s on r.rid = s.rid
left join extra e on r.source is not distinct from e.source
"""


def _cut(kind: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  select rid, {kind} as kind, n, hit, sum(gap + hit) over (partition by rid order by n) as upto, counted >= {least} as ok from (
    select rid, unnest(generate_series(1, len(hits))) as n, unnest(list_transform(hits, lambda x: length(x))) as hit,
      unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) as gap, unnest(list_transform(counts, lambda x: length(x))) as counted
    from (select rid, regexp_extract_all(text, '{quoted}') as hits, regexp_extract_all(text, '{quoted}', {group}) as counts, string_split_regex(text, '{quoted}') as gaps from docs)
    where len(hits) > 0)"""


SECRETS = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
cuts as ({" union all ".join([
    _cut(0, r'''((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 2, 12),
    _cut(1, "AKIA[A-Z0-9]+", 0, 18),
    _cut(2, "[0-9a-f]+", 0, 16),
    _cut(3, r'''(?i:client_?id|key_?id|user_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+''', 0, 0),
    _cut(4, "[A-Za-z0-9+/_=-]+", 0, 24),
    _cut(5, "[a-z][a-z0-9+]*://[A-Za-z0-9.:@/_-]+", 0, 0),
])}),
found as (select rid, kind, (upto - hit)::bigint as s, upto::bigint as e from cuts where ok),
base as (select * from found where kind < 3),
parts as (
  select * from base union all
  select * from found w where kind >= 3 and not exists (select 1 from base b where b.rid = w.rid and b.s < w.e and w.s < b.e)),
meets as (
  select x.*, max((y.kind in (1, 3))::int) as named, max((y.kind in (0, 2, 4))::int) as held
  from parts x join parts y on x.rid = y.rid and x.s <= y.e + 200 and y.s <= x.e + 200 where x.kind >= 3 group by all),
said as (
  select * from base union all
  select rid, kind, s, e from meets where case kind when 3 then held = 1 when 4 then named = 1 else named + held = 2 end),
per as (
  select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind > 2) as n_linked,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e) filter (kind < 3) as base,
    string_agg(['assign', 'access', 'hex', 'ident', 'part', 'endpoint'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e) as spans
  from said group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0)::bigint as n_linked
from docs left join per using (rid)
"""

DECONTAMINATION = r"""
with words as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
tests as (
  select distinct item_id, least(len(w), 10) as need, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from items where len(w) > 0)),
spots as (
  select rid, i, need, array_to_string(w[i : i + need - 1], ' ') as gram
  from (select rid, w, need, unnest(generate_series(1, len(w) - need + 1)) as i from words, (select distinct need from tests) where len(w) >= need)),
hits as (select rid, i, item_id, need from spots join tests using (need, gram)),
covered as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + need - 1)) as p from hits) group by rid),
named as (
  select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct rid, item_id from hits) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (rid) left join named using (rid)
"""

WARC = """
with page as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as payload_digest from pages),
sized as (select page_id, octet_length(payload)::bigint as payload_bytes, payload_digest, max(page_id) over (partition by payload_digest) as kept from page)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id is distinct from kept and kept is not null then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from kept and kept is not null then kept end as refers_to
from sized
"""

VECTORS = """
with recursive sized as (select *, len(embedding) as n from embeddings),
valid as materialized (
  select vec_id, embedding::double[] as e from sized where vec_id is not null and n = (select n from sized where n is not null group by n order by count(*) desc, n limit 1)
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as materialized (select a.vec_id as a, b.vec_id as b from valid a join valid b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
walk as (select vec_id as id, vec_id as c from embeddings union select l.b, w.c from walk w join links l on l.a = w.id),
least as (select id, min(c) as c from walk group by id)
select vec_id, (select count(*) from links where a = vec_id) as n_links, c as component_id, vec_id = c as kept from embeddings join least on vec_id = id
"""

JACCARD = r"""
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
shingles as materialized (
  select distinct doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from words where len(w) > 0)),
sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
links as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all) p
  join sizes m on m.doc_id = a join sizes n on n.doc_id = b where 100 * k >= 90 * (m.n + n.n - k)),
walk as (select doc_id as id, doc_id as c from documents union select l.b, w.c from walk w join links l on l.a = w.id),
least as (select id, min(c) as c from walk group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id from documents d left join sizes using (doc_id) join least on d.doc_id = id
"""

COLLOCATIONS = r"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (
  select lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from texts),
totals as (
  select lang, sum(len(w))::bigint as n from pieces group by lang),
places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
spelt as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from places, (values (1), (2), (3)) as sizes(k) where i + k - 1 <= len(w)),
counted as (
  select lang, k, phrase, count(*) as f from spelt group by lang, k, phrase having count(*) >= 10),
cuts as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from counted where k > 1),
scored as (
  select c.lang, c.k, c.phrase, c.a, c.cut, l.f as l, r.f as r, ((1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f))::bigint as score
  from cuts c
  join counted l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.cut], ' ')
  join counted r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, phrase, max(f) as f from (
    select lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as phrase
    from counted where k = 3) group by lang, phrase),
kept as (
  select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
  from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where g.f is null or 100 * g.f < 50 * b.a)
select lang, rank, phrase, a, l, r, n, score from kept join totals using (lang) where rank <= 2000
"""

INFILL = r"""
with texts as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents),
drawn as (
  select doc_id, text, u, len(u) as n, [('0x' || substr(h, 8 * k + 1, 8))::bigint for k in range(4)] as d from texts),
ranked as (
  select *, least(d[1] % (n + 1), d[2] % (n + 1)) as lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) as hi,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 100 then 'plain'
      when d[4] % 100 < 50 then 'spm' else 'psm' end as form from drawn),
cut as (
  select doc_id, text, n, form, array_to_string(u[1:lo], '') as p, array_to_string(u[lo + 1:hi], '') as m, array_to_string(u[hi + 1:], '') as s from ranked)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from cut
"""
