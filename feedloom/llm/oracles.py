"""DuckDB twins of the queries whose results SQL can express."""

OP11_SQL = r"""
with recursive bits as (  -- the table of crc32
  select list_transform(range(256), lambda x: list_reduce(
    list_concat([x::ubigint], list_transform(range(8), lambda y: 0::ubigint)),
    lambda c, y: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as t
), runs as (
  select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents
), lowered as (
  select doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from runs where length(run) >= 7 group by all
), coded as (
  select run, n, hex(encode(doc || ':' || run)) as code from lowered
), summed as (
  select run, n, xor(list_reduce(
    list_concat([4294967295::ubigint], list_transform(range(length(code) // 2), lambda i:
      ((instr('0123456789ABCDEF', substr(code, 2 * i + 1, 1)) - 1) * 16
        + instr('0123456789ABCDEF', substr(code, 2 * i + 2, 1)) - 1)::ubigint)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint) as h
  from coded, bits
), cut as (
  select case when h % 31 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2)
    else run end as word, n from summed
), words as materialized (
  select word, sum(n)::bigint as n from cut where length(word) >= 7 group by word having sum(n) >= 2
), less as materialized (
  select word, n, i, left(word, i) || substr(word, i + 2) as rest
  from words, lateral (select unnest(range(length(word))) as i)
), near as (
  select a.word, a.n, b.word as near, b.n as near_n from less a join less b using (i, rest) where a.word <> b.word
  union select w.word, w.n, l.word, l.n from words w join less l on l.rest = w.word
  union select l.word, l.n, w.word, w.n from words w join less l on l.rest = w.word
), ranked as (
  select *, row_number() over (partition by word order by near_n desc, near) as r, count(*) over (partition by word) as k
  from near
), formed as (
  select w.word, w.n, coalesce(k, 0) as n_near,
    case when near_n >= 10 * w.n then near end as form, case when near_n >= 10 * w.n then near_n end as form_n
  from words w left join (select * from ranked where r = 1) x using (word)
), chain as (
  select word, word as at from formed
  union all select c.word, f.form from chain c join formed f on f.word = c.at where f.form is not null
), ends as (
  select c.word, c.at as root from chain c join formed f on f.word = c.at where f.form is null
)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""

OP12_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
  from documents
), w as (
  select id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from d
), kept as materialized (
  select lang, term, count(*) as n from w group by all having count(distinct id) >= 3
), counted as materialized (
  select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all
), langs as (
  select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by lang
), groups as materialized (select distinct lang, source from d),
sums as (
  select lang, source, coalesce(sum(n), 0)::hugeint as n from groups left join counted using (lang, source) group by all
), p as materialized (
  select lang, s.source, term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0)::hugeint + 1) // (s.n + langs.v) as p
  from sums s join langs using (lang) join kept using (lang) left join counted c using (lang, source, term)
), pairs as (
  select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f, 0)::bigint as value
  from groups x join groups y on x.lang = y.lang and x.source <> y.source
  left join (
    select a.lang, a.source, b.source as other, sum((a.p - b.p) * (a.p - b.p) // b.p) as f
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  ) z on z.lang = x.lang and z.source = x.source and z.other = y.source
), terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value
  from (
    select p.*, 1 + 1000000000 * (k.n::hugeint + 1) // (langs.n + langs.v) as q
    from p join kept k using (lang, term) join langs using (lang)
  ) where n > 0 and p > q
)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 200
"""

OP1_SQL = r"""
with d as (
  select row_number() over (order by doc_id) as id, doc_id,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words
  from documents
), windows as materialized (
  select id, doc_id, pos, sha256(array_to_string(words[pos : pos + 19], ' ')) as key
  from d, lateral (select unnest(range(1, len(words) - 18)) as pos)
), repeated as (
  select id, pos from (select *, row_number() over (partition by key order by doc_id, id, pos) as nth from windows) where nth > 1
), gone as (
  select distinct id, i from repeated, lateral (select unnest(range(pos, pos + 20)) as i)
), word as (
  select id, i, words[i] as w from d, lateral (select unnest(range(1, len(words) + 1)) as i)
), kept as (
  select id, count(*) as n, string_agg(w, ' ' order by i) as text from word anti join gone using (id, i) group by id
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (id)
"""

OP3_SQL = r"""
with recursive v as materialized (
  select row_number() over () as id, vec_id, label, embedding::double[] as e from embeddings
), fit as materialized (
  select * from v where label is not null and e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0
), links as materialized (
  select a.id as u, b.id as w from fit a join fit b on a.label = b.label and a.id <> b.id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reached as (
  select id as u, id as w from v
  union select r.u, l.w from reached r join links l on l.u = r.w
), components as (
  select u as id, min(vec_id) as component_id from reached join v on v.id = reached.w group by u
), counted as (select u as id, count(*) as n from links group by u)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from v join components using (id) left join counted using (id)
"""


def _crc32(code: str) -> str:
    """crc32 of the bytes whose hexadecimal digits are ``code``, given the table ``t``."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr({code}, {at}, 1)) - 1)"
    return f"""xor(list_reduce(
    list_concat([4294967295::ubigint], list_transform(range(length({code}) // 2), lambda i:
      ({digit('2 * i + 1')} * 16 + {digit('2 * i + 2')})::ubigint)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint)"""


_CRC_TABLE = """bits as (  -- the table of crc32
  select list_transform(range(256), lambda x: list_reduce(
    list_concat([x::ubigint], list_transform(range(8), lambda y: 0::ubigint)),
    lambda c, y: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as t
)"""

# What the contracts fix of results whose rest a model decides.

MIX_TARGETS_SQL = r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size,
    (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source
), step as (
  select 0 as n, source, source_size, weight, false as capped from sources
  union all
  select n + 1, source, source_size, weight, capped or share > 3 * source_size
  from (
    select *, (total - held) * weight / nullif(free, 0) as share
    from (select *, sum(source_size) over () as total,
        sum(case when capped then 3 * source_size else 0 end) over () as held,
        sum(case when capped then 0 else weight end) over () as free
      from step)
  ) where n < 200
), last as (
  select *, sum(source_size) over () as total, sum(case when capped then 3 * source_size else 0 end) over () as held,
    sum(case when capped then 0 else weight end) over () as free
  from step where n = 200
)
select doc_id, size, l.source_size,
  round(case when capped then 3.0 * l.source_size else (total - held) * weight / free end, 3)::double as target
from d join last l on l.source is not distinct from d.source
"""

LM_BASE_SQL = (
    "with "
    + _CRC_TABLE
    + r""", d as (
  select doc_id, coalesce(text, '') as text, hex(encode(doc_id::varchar)) as code from documents
), h as (
  select doc_id, text, """
    + _crc32("code")
    + r""" % 7 = 2 as held_out from d, bits
), token as (
  select doc_id, held_out, unnest(list_concat(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [chr(10)])) as w
  from h
), counted as (
  select w, count(*) as c from token where not held_out group by w
), totals as (select sum(c) as n, count(*) as v from counted)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, max(n)::bigint as train_tokens,
  round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 3) as base_score
from token left join counted using (w), totals group by doc_id, held_out
"""
)

PII_COUNTS_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text from documents
), found as (
  select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
    len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x:
      len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 or try_cast(p as hugeint) > 255)) = 0)) as n_ip,
    list_filter(list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'),
      lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) between 13 and 19) as cards,
    len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'),
      lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 9 and 15)) as n_phone
  from d
)
select doc_id, n_email, n_ip, n_phone,
  len(list_filter(cards, lambda x: list_sum(list_transform(range(length(x)), lambda i:
    case when i % 2 = 0 then substr(x, length(x) - i, 1)::int
      else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(x, length(x) - i, 1)::int + 1] end)) % 10 = 0)) as n_card
from found
"""

URL_RULES_SQL = r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), rules(host_of, path_of, rule, verdict) as (values
  ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')
), fits as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as ruled
  from p join rules on (host = host_of or ends_with(host, '.' || host_of)) and starts_with(path, path_of)
  group by page_id
)
select page_id, host, path, coalesce(rule, '') as rule, coalesce(ruled, '') as ruled from p left join fits using (page_id)
"""
