"""The same queries in DuckDB SQL, written row by row where the jobs use sets."""

from __future__ import annotations

from feedloom.workload.adaptors import (
    CLOCK_CHANGE,
    CUT,
    DOC_SINCE,
    ZONE_DAYS,
    LOG_NOW,
    MUTED_RULES,
    NOW,
    NOW_MID,
    ORDER_RULES,
    ORDERS_NOW,
    RULES,
    WEEK,
)

DAY = 86_400

POST_COLUMNS = (
    "id, community_id, community_name, name, permalink, time_created, time_stored, "
    "is_active, is_sticky, score, title, url"
)

POSTS_EV = """posts_ev as (
  select cast(event_id as varchar) as id, 'c_' || event_type as community_id,
    event_type as community_name, 't3_' || event_id as name,
    '/r/' || event_type || '/comments/' || event_id as permalink,
    cast(floor(epoch(ts)) as bigint) as time_created,
    cast(floor(epoch(ts)) as bigint) as time_stored,
    event_id % 10 <> 0 as is_active, event_id % 37 = 0 as is_sticky,
    cast(floor(value) as bigint) - 20 as score,
    event_type || ' item ' || event_id as title,
    case event_id % 13
      when 0 then ''
      when 1 then 'https://imgur.com/a' || event_id
      when 2 then 'http://www.imgur.com:80/Ab' || event_id || '.gifv?x=1'
      when 3 then 'https://media.giphy.com/media/g' || event_id || '/giphy.gif'
      when 4 then 'https://giphy.com/gifs/foo-bar-x' || event_id
      when 5 then 'https://gfycat.com//Gf' || event_id
      when 6 then 'https://gfycat.com/gifs/detail/d' || event_id
      when 7 then 'https://www.reddit.com/r/foo/comments/' || event_id
      when 8 then 'https://example.org/v/' || event_id || '.MP4'
      when 9 then 'https://example.org/v/' || event_id || '.webm'
      when 10 then 'https://example.org/i/' || (event_id % 50) || '.JPG'
      when 11 then 'ftp://example.org/i/' || event_id || '.png'
      else 'https://example.org/page/' || event_id end as url
  from events)"""

LISTING_EV = (
    POSTS_EV
    + f""",
listing_ev as (
  select * exclude rn, (rn - 1) // 100 + 1 as page_no, (rn - 1) % 100 + 1 as pos,
    time_created >= {CUT} as is_new
  from (select *, row_number() over (
          partition by community_name
          order by time_created desc, cast(id as bigint)) as rn
        from posts_ev))"""
)

POSTS_DOC = """posts_doc as (
  select cast(doc_id as varchar) as id, 'c_' || source as community_id,
    source as community_name, 't3_' || doc_id as name,
    '/r/' || source || '/comments/' || doc_id as permalink,
    doc_id + 1700000000 as time_created, doc_id * 60 + 1700000000 as time_stored,
    doc_id % 10 <> 0 as is_active, false as is_sticky, n_chars as score,
    lang || ' document ' || doc_id as title, 'doc://' || md5(text) as url, doc_id as seq
  from documents),
doc_store as (select * from posts_doc where seq % 3 = 0),
doc_batch as (
  select id, community_id, upper(community_name) as community_name, name, permalink,
    time_created + 5 as time_created, time_stored + 86400 as time_stored, is_active, is_sticky,
    score + 7 as score, 'new ' || title as title,
    case when seq % 6 = 0 then url || '-v2' else url end as url, seq
  from posts_doc)"""

POSTS_ORD = """posts_ord as (
  select cast(o_orderkey as varchar) as id, 'c_' || o_orderpriority as community_id,
    lower(o_orderpriority) as community_name,
    cast(floor(epoch(o_orderdate)) as bigint) as time_stored,
    o_orderstatus <> 'P' as is_active,
    cast(floor(o_totalprice / 100) as bigint) as score, '' as url,
    'order ' || o_orderkey as title
  from orders)"""


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def _rules(rows: list[tuple]) -> str:
    """Rules with their defaults, worked out by hand of the cascade."""
    out = []
    for feed, description, media, feed_p, feed_n, community, p, n in rows:
        feed_p = feed_p if feed_p != 0 else 80
        feed_n = 100 if feed_n == 0 else max(feed_n, 0)
        p = p if p != 0 else feed_p
        n = feed_n if n == 0 else max(n, 0)
        out.append(
            f"('{feed}', '{description}', '{media or 'text'}', '{community.lower()}', "
            f"cast({p} as double), cast({n} as bigint))"
        )
    return (
        "rules(feed, description, feed_media, community, percentile, max_daily) as (values\n  "
        + ",\n  ".join(out)
        + ")"
    )


def _recent(now: int, source: str = "posts_ev") -> str:
    return f"recent as (select * from {source} where time_stored >= {now - WEEK} and is_active)"


# The score at offset int(P * n / 100) of each community, best score first.
BARS = """placed as (
  select community_name, score,
    row_number() over (partition by community_name order by score desc) - 1 as place,
    count(*) over (partition by community_name) as n
  from recent),
bars as (
  select r.*, case when r.percentile >= 100 then 0 else coalesce(p.score, 0) end as min_score
  from rules r left join placed p
    on p.community_name = r.community
   and p.place = cast(trunc(r.percentile * p.n / 100::double) as bigint)
  where r.percentile > 0)"""

# Link parts and the site rules, in order; hosts, patterns and markup are fixed values.
MEDIA = r"""parts as (
  select *,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as hostport,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) as query
  from {source}),
hosts as (select *, lower(split_part(hostport, ':', 1)) as host from parts),
found as (
  select *, case
    when scheme not in ('http', 'https') then null
    when regexp_matches(host, '(^|\.)reddit\.com$')
     and regexp_matches(lower(path), '^/r/[^/]+/comments') then null
    when regexp_matches(host, '(^|\.)imgur\.com$') and regexp_matches(lower(path), '\.gifv$')
      then {{'url': scheme || '://i.imgur.com' || path || query, 'embed': ''}}
    when regexp_matches(host, '(^|\.)imgur\.com$') and regexp_matches(path, '^/[[:alnum:]]+$')
      then {{'url': scheme || '://i.imgur.com' || path || '.jpg' || query, 'embed': ''}}
    when regexp_matches(host, '(^|\.)giphy\.com$')
     and regexp_matches(path, '^/media/([[:alnum:]]+)')
      then {{'url': '', 'embed': '<iframe src="https://giphy.com/embed/'
        || regexp_extract(path, '^/media/([[:alnum:]]+)', 1)
        || '" frameborder="0" scrolling="no" width="100%" height="100%" class="giphy-embed" allowFullScreen></iframe>'}}
    when regexp_matches(host, '(^|\.)giphy\.com$')
     and regexp_matches(path, '^/gifs/(?:[[:alnum:]]+-)*([[:alnum:]]+)')
      then {{'url': '', 'embed': '<iframe src="https://giphy.com/embed/'
        || regexp_extract(path, '^/gifs/(?:[[:alnum:]]+-)*([[:alnum:]]+)', 1)
        || '" frameborder="0" scrolling="no" width="100%" height="100%" class="giphy-embed" allowFullScreen></iframe>'}}
    when regexp_matches(host, '(^|\.)gfycat\.com$')
     and regexp_matches(path, '^/+(?:gifs/detail/)?([[:alnum:]]+)')
      then {{'url': '', 'embed': '<div style="position:relative;padding-bottom:54%"><iframe src="https://gfycat.com/ifr/'
        || regexp_extract(path, '^/+(?:gifs/detail/)?([[:alnum:]]+)', 1)
        || '" frameborder="0" scrolling="no" width="100%" height="100%" style="position:absolute;top:0;left:0" allowfullscreen></iframe></div>'}}
    when regexp_matches(path, '(?i)\.(?:gifv?|png|jpe?g|mp4|webm)$')
      then {{'url': url, 'embed': ''}}
    end as media
  from hosts),
linked as (
  select *, coalesce(media.url, '') as media_url, coalesce(media.embed, '') as media_embed,
    case when media is null then 'none' when media.embed <> '' then 'embed'
      when media.url like '%.mp4' then 'mp4' when media.url like '%.webm' then 'webm'
      when media.url <> '' then 'image' else 'none' end as media_kind
  from found)"""


def _boundary(now: str) -> str:
    """Next 03:00 UTC after an epoch second."""
    return f"(({now}) - (({now}) - 10800) % {DAY} + {DAY})"


def _boundary_in_zone(now: str) -> str:
    """The same in a zone whose clocks go from 8 to 7 hours behind UTC at ``CLOCK_CHANGE``."""
    off = lambda t: f"(case when {t} >= {CLOCK_CHANGE} then -25200 else -28800 end)"
    local = f"({now} + {off(now)} - 10800)"
    at_three = f"({local} - ({local} % {DAY} + {DAY}) % {DAY} + {DAY} + 10800)"
    return f"({at_three} - {off(f'({at_three} + 25200)')})"


def _age(boundary: str, stored: str = "time_stored") -> str:
    delta = f"({boundary} - {stored})"
    return f"(case when {delta} < 0 then {delta} - {DAY} else {delta} end) // {DAY}"


def _candidates(now: int, cap: int) -> str:
    return f"""{BARS},
candidates as (
  select *, {_age(_boundary(str(now)))} as age_in_days
  from (select p.*, b.feed, b.feed_media, b.max_daily, b.min_score,
          row_number() over (partition by b.feed
            order by p.time_stored desc, p.id, p.community_id) as newest
        from recent p join bars b
          on p.community_name = b.community and p.score >= b.min_score)
  where newest <= {cap})"""


def _feeds(
    now: int, rows: list[tuple] = RULES, source: str = "posts_ev", base: str = POSTS_EV,
    cap: int = 3000,
) -> str:
    return _with(
        base,
        _rules(rows),
        _recent(now, source),
        _candidates(now, cap),
        MEDIA.format(source="candidates"),
        """daily as (
  select *, row_number() over (partition by feed, community_name, age_in_days
      order by score desc, id, community_id) as daily_rank
  from linked where feed_media <> 'image' or media is not null)""",
        """feeds as (
  select *, row_number() over (partition by feed
      order by time_stored desc, id, community_id) as display_rank
  from daily where daily_rank <= max_daily)""",
    )


PAGES = "(display_rank - 1) // 10 + 1"

STATS = """stats as (
  select community_name, page_no, cast(sum(case when is_sticky then 0 else 1 end) as bigint) as n_rows,
    cast(sum(case when not is_sticky and is_new then 1 else 0 end) as bigint) as n_new
  from listing_ev group by all),
judged as (
  select *, case when n_rows = 0 then 0.0::double else 100.0::double * n_new / n_rows end
      as percent_new
  from stats),
reasons as (
  select *, case when page_no > 10 then 'page limit' when n_rows < 10 then 'too few rows'
    when percent_new < 20 then 'too few new rows' else 'continue' end as stop_reason
  from judged)"""

INGESTED = """select * from reasons r
where not exists (select 1 from reasons e where e.community_name = r.community_name
  and e.page_no < r.page_no and e.stop_reason <> 'continue')"""


def _upsert_round(k: int, batch: str, order: str) -> str:
    """One batch against state ``st{k-1}``: labels ``lab{k}`` and state ``st{k}``.

    A row inserts its link if, at its turn, nobody holds it: holders are the
    state's rows, less updates before it that dropped the link, plus those that
    took it.
    """
    before = f"st{k - 1}"
    return f"""bat{k} as materialized (
  select b.*, row_number() over (order by {order}) as seq_no, s.url as old_url,
    s.time_created as old_created, s.time_stored as old_stored, s.community_name as old_community,
    s.id is not null as hit
  from ({batch}) b left join {before} s on s.id = b.id and s.community_id = b.community_id),
ev{k} as (
  select url, 0 as seq_no, 1 as d, false as cand from {before} where url <> ''
  union all select old_url, seq_no, -1, false from bat{k} where hit
  union all select url, seq_no, 1, false from bat{k} where hit
  union all select url, seq_no, 0, true from bat{k} where not hit),
occ{k} as (
  select *, coalesce(sum(d) over (partition by url order by seq_no
      range between unbounded preceding and 1 preceding), 0) as held
  from ev{k} where url <> ''),
win{k} as (select url, min(seq_no) as seq_no from occ{k} where cand and held = 0 group by url),
lab{k} as materialized (
  select b.*, case when hit then 'UPDATED' when b.url = '' or w.seq_no is not null then 'NEW'
    else 'SKIPPED' end as store_result
  from bat{k} b left join win{k} w on w.url = b.url and w.seq_no = b.seq_no),
st{k} as materialized (
  select {POST_COLUMNS} from {before} s
  where not exists (select 1 from lab{k} l where l.id = s.id and l.community_id = s.community_id)
  union all
  select id, community_id, coalesce(old_community, community_name), name, permalink,
    coalesce(old_created, time_created), coalesce(old_stored, time_stored),
    is_active, is_sticky, score, title, url
  from lab{k} where store_result <> 'SKIPPED')"""


def _row_by_row() -> str:
    """The batch of documents stored row by row: labels ``lab1`` and state ``st1``.

    ``written`` is what a writer keeps: the turn it is at, posts by key with their links, and
    the label of each row so far. A step looks one row's key and link up in it.
    """
    return "with recursive " + ",\n".join(
        [
            POSTS_DOC,
            "numbered as materialized (select *, row_number() over (order by seq) as turn from doc_batch)",
            """written(kind, id, community_id, url, result, turn) using key (kind, id, community_id) as (
  select 'post', id, community_id, coalesce(url, ''), '', 0::bigint from doc_store
  union all select 'turn', '', '', '', '', 1
  union
  (with now as (
    select b.id, b.community_id, coalesce(b.url, '') as url, b.turn,
      exists (select 1 from recurring.written p
        where p.kind = 'post' and p.id = b.id and p.community_id = b.community_id) as hit,
      exists (select 1 from recurring.written p where p.kind = 'post' and p.url = b.url and b.url <> '') as held
    from written w join numbered b on w.kind = 'turn' and b.turn = w.turn
  ), said as (
    select *, case when hit then 'UPDATED' when held then 'SKIPPED' else 'NEW' end as result from now
  )
  select 'turn', '', '', '', '', turn + 1 from said
  union all select 'label', id, community_id, '', result, turn from said
  union all select 'post', id, community_id, url, '', 0 from said where result <> 'SKIPPED'))""",
            """lab1 as materialized (
  select b.*, w.result as store_result, s.community_name as old_community,
    s.time_created as old_created, s.time_stored as old_stored
  from numbered b join written w on w.kind = 'label' and w.id = b.id and w.community_id = b.community_id
  left join doc_store s on s.id = b.id and s.community_id = b.community_id)""",
            f"""st1 as materialized (
  select {POST_COLUMNS} from doc_store s
  where not exists (select 1 from lab1 l where l.id = s.id and l.community_id = s.community_id)
  union all
  select id, community_id, coalesce(old_community, community_name), name, permalink,
    coalesce(old_created, time_created), coalesce(old_stored, time_stored),
    is_active, is_sticky, score, title, url
  from lab1 where store_result <> 'SKIPPED')
""",
        ]
    )


def _harvest() -> str:
    """Eleven rounds, page by page, over communities still going."""
    ctes = [
        LISTING_EV,
        f"""st0 as materialized (
  select {POST_COLUMNS.replace("score, title", "score - 5 as score, 'old ' || title as title")}
  from posts_ev where time_created < {CUT})""",
        "go0 as (select distinct community_name from listing_ev)",
    ]
    for k in range(1, 12):
        batch = f"""select * replace ({NOW} as time_stored) from listing_ev
    where page_no = {k} and not is_sticky
      and community_name in (select community_name from go{k - 1})"""
        ctes.append(_upsert_round(k, batch, "b.community_name, b.pos"))
        ctes.append(
            f"""page{k} as (
  select community_name, cast({k} as bigint) as page_no, count(*) as n_rows,
    cast(sum(case when store_result = 'NEW' then 1 else 0 end) as bigint) as n_new
  from lab{k} group by community_name),
stop{k} as (
  select *, 100.0::double * n_new / n_rows as percent_new,
    case when page_no > 10 then 'page limit' when n_rows < 10 then 'too few rows'
      when 100.0 * n_new / n_rows < 20 then 'too few new rows' else 'continue' end as stop_reason
  from page{k}),
go{k} as (select community_name from stop{k} where stop_reason = 'continue')"""
        )
    return _with(*ctes)


def _stream() -> str:
    ctes = [
        LISTING_EV,
        """dropped as (
  select *, case when time_created < 1704931200 then 0 when time_created < 1705708800 then 1
    else 2 end as drop_no
  from listing_ev),
landed as (
  select * from dropped
  union all
  select * replace (score + 7 as score, drop_no + 1 as drop_no,
    case when cast(id as bigint) % 15 = 0 and url <> '' then url || '-v2' else url end as url)
  from dropped where cast(id as bigint) % 5 = 0 and drop_no < 2)""",
        f"st0 as (select {POST_COLUMNS} from posts_ev where false)",
    ]
    for k in (1, 2, 3):
        batch = f"""select * replace ({NOW + (k - 1) * 21_600} as time_stored)
    from landed where drop_no = {k - 1} and not is_sticky"""
        ctes.append(_upsert_round(k, batch, "b.page_no, b.community_name, b.pos"))
    return _with(*ctes)


# Feed documents of customers, as flat rows.
FEED_RULES = """feeds_c as (
  select c.*, j from customer c, (values (1), (2)) t(j) where j <= 1 + c_custkey % 2),
members_c as (
  select f.*, i from feeds_c f left join (values (1), (2), (3)) t(i) on i <= c_custkey % 4),
feed_rules as (
  select cast(c_custkey as varchar) as document, cast(j as bigint) as feed_no,
    case when c_custkey % 11 = 0 and j = 1 then ''
      when c_custkey % 13 = 0 then 'bad name ' || c_custkey
      when c_custkey % 19 = 0 then 'feed_' || (c_custkey - 1) || '_' || j
      else 'feed_' || c_custkey || '_' || j end as feed,
    case when c_custkey % 17 = 0 then '' else c_mktsegment end as description,
    case c_custkey % 6 when 0 then 'image' when 1 then 'text' when 2 then 'video' else '' end
      as media,
    cast(case when c_custkey % 5 = 0 then 0 when c_custkey % 23 = 0 then -1
      when c_custkey % 29 = 0 then 101 else abs(c_nationkey * 4) end as double)
      as feed_percentile,
    cast(c_custkey % 8 - 1 as bigint) as feed_max_daily,
    cast(coalesce(i, 0) as bigint) as community_no,
    case when i is null then '' when c_custkey % 31 = 0 and i = 1 then ''
      when c_custkey % 3 = 0 and i = 2 then 'Everyone'
      else 'Comm_' || c_custkey || '_' || j || '_' || i end as community,
    cast(case when i is null or (c_custkey + i) % 3 = 0 then 0
      when (c_custkey + i) % 37 = 0 then 120 else (c_custkey + i) % 100 end as double)
      as percentile,
    cast(case when i is null then 0 else (c_custkey + i) % 5 - 1 end as bigint) as max_daily
  from members_c),
feed_level as (
  select * replace (
    case when feed_percentile = 0 then 80 else feed_percentile end as feed_percentile,
    cast(case when feed_max_daily < 0 then 0 when feed_max_daily = 0 then 100
      else feed_max_daily end as bigint) as feed_max_daily,
    case when media = '' then 'text' else media end as media, lower(community) as community)
  from feed_rules),
resolved as (
  select * replace (
    case when percentile = 0 then feed_percentile else percentile end as percentile,
    cast(case when max_daily < 0 then 0 when max_daily = 0 then feed_max_daily
      else max_daily end as bigint) as max_daily)
  from feed_level)"""

ACCOUNT_RULES = """account_rules as (
  select cast(s_suppkey as varchar) as document, cast(1 as bigint) as feed_no,
    case when s_suppkey % 11 = 0 then '' when s_suppkey % 7 = 0 then 'feed_' || s_suppkey || '_1'
      else 'accounts_' || s_suppkey end as feed,
    case when s_suppkey % 17 = 0 then '' else s_name end as description,
    cast(i as bigint) as filter_no,
    case when (s_suppkey + i) % 13 = 0 then '' else 'user_' || s_suppkey end as account,
    case (s_suppkey + i) % 5 when 0 then 'likes' when 1 then 'retweets' else 'original' end
      as filter_type,
    cast(case when (s_suppkey + i) % 19 = 0 then -3 else (s_suppkey + i) % 110 end as double)
      as percentile,
    cast((s_suppkey + i) % 9 - 1 as bigint) as max_daily
  from supplier, (values (1), (2), (3)) t(i) where i <= 1 + s_suppkey % 3)"""

MENU = """menu as (
  select distinct 'community' as source, document, feed_no, feed, description from feed_rules
  union all
  select distinct 'account', document, feed_no, feed, description from account_rules)"""

FEED_COLUMNS = (
    "feed, display_rank, id, community_id, community_name, time_stored, score, title, url, "
    "cast(age_in_days as bigint) as age_in_days, media_url, media_embed"
)
LINK = "'/reddit/?feed=' || feed || '&page=' || page_no"


def _percentiles(base: str, source: str, percentiles: list[str]) -> str:
    values = ", ".join(f"({p}::double)" for p in percentiles)
    return (
        _with(
            base,
            f"""placed as (
  select community_name, score,
    row_number() over (partition by community_name order by score desc) - 1 as place,
    count(*) over (partition by community_name) as n
  from ({source}))""",
        )
        + f"""select community_name as community, percentile,
  cast(case when percentile >= 100 then 0
    else max(score) filter (place = cast(trunc(percentile * n / 100::double) as bigint)) end
    as bigint) as min_score
from placed, (values {values}) v(percentile) group by community_name, percentile"""
    )


def _host_share(base: str, source: str, domain: str) -> str:
    return (
        _with(
            *([base] if base else []),
            f"""hosts as (
  select community_name, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) as host
  from {source}),
counted as (
  select community_name, host, count(*) as posts,
    cast(sum(count(*)) over (partition by community_name) as bigint) as community_posts
  from hosts group by community_name, host)""",
        )
        + f"""select *, posts / community_posts::double as share from counted
where regexp_matches(host, '(^|\\.){domain}$')"""
    )


def _rule_checks(rows: str, checks: list[tuple[str, str]], columns: str) -> str:
    return "\nunion all\n".join(
        f"select {columns}, '{text}' as violation from {rows} where {broken}"
        for text, broken in checks
    )


def all_oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    ev = _with(POSTS_EV)
    sql["listing_normalize"] = ev + f"select {POST_COLUMNS} from posts_ev"
    sql["drop_sticky"] = (
        _with(LISTING_EV)
        + "select community_name, page_no, pos, name, is_new from listing_ev where not is_sticky"
    )
    sql["listing_rejects"] = """select 't3_' || event_id as name, case event_id % 20
  when 1 then 'no id' when 2 then 'no title' when 3 then 'malformed' when 4 then 'malformed'
  when 5 then 'no community' else '' end as reason from events"""
    sql["page_cursor"] = (
        _with(LISTING_EV)
        + """select community_name, page_no, coalesce(last_value(own ignore nulls) over (
    partition by community_name order by page_no), '') as cursor
from (select community_name, page_no, arg_max(name, pos) filter (where not is_sticky) as own
  from listing_ev group by community_name, page_no)"""
    )
    sql["page_cursor_batches"] = sql["page_cursor"]
    sql["stamp_harvest_time"] = (
        _with(LISTING_EV)
        + f"select id, community_id, time_created, cast({NOW} as bigint) as time_stored from listing_ev"
    )
    sql["posts_scan"] = (
        ev
        + f"""select {POST_COLUMNS} from posts_ev
where community_name = 'click' and score >= 10 and time_stored >= {NOW_MID}"""
    )
    sql["posts_sink"] = (
        ev
        + f"""select {POST_COLUMNS},
  cast(date '1970-01-01' + cast(time_stored // {DAY} as integer) as varchar) as stored_date
from posts_ev"""
    )
    sql["feed_rules_source"] = _with(FEED_RULES) + "select * from feed_rules"

    doc = _with(POSTS_DOC)
    sql["known_by_key"] = (
        doc
        + """select id, community_id, seq from doc_batch b where exists (
  select 1 from doc_store s where s.id = b.id and s.community_id = b.community_id)"""
    )
    sql["known_by_url"] = (
        doc
        + """select id, community_id, url from doc_batch
where url <> '' and url in (select url from doc_store)"""
    )
    upsert = _row_by_row()
    sql["ingest_classify"] = upsert + "select id, community_id, store_result from lab1"
    sql["ingest_merge"] = upsert + f"select {POST_COLUMNS} from st1"
    for name in ("known_by_key", "known_by_url", "ingest_classify", "ingest_merge"):
        sql[f"{name}_index"] = sql[name]
    sql["score_at_percentile_index"] = "with recursive " + _percentiles(
        upsert.removeprefix("with recursive "),
        f"select * from st1 where time_stored >= {DOC_SINCE} and is_active",
        ["0", "10", "50", "90", "99.9", "100"],
    ).removeprefix("with ")

    stats = _with(LISTING_EV, STATS)
    sql["harvest_page_stats"] = stats + "select * from judged"
    sql["harvest_stop_rule"] = stats + INGESTED
    sql["harvest_run"] = _harvest() + f"select {POST_COLUMNS} from st11"
    sql["harvest_run_pages"] = _harvest() + "\nunion all\n".join(
        f"select * from stop{k}" for k in range(1, 12)
    )

    again = f"""select * replace ({NOW + 21_600} as time_stored, score + 7 as score) from listing_ev
    where page_no = 1 and not is_sticky"""
    twice = _harvest().rstrip() + ",\n" + _upsert_round(12, again, "b.community_name, b.pos")
    sql["harvest_stream_stop_rule"] = twice + f"\nselect {POST_COLUMNS} from st12"
    labels = "\n  union all ".join(
        f"select community_name, store_result, page_no, {3 if k == 12 else 2}::bigint as version from lab{k}"
        for k in range(1, 13)
    )
    sql["harvest_ledger"] = f"""{twice},
labels as ({labels}),
counted as (
  select version, community_name, max(page_no) as last_page, count(*) filter (store_result = 'NEW') as n_new,
    count(*) filter (store_result = 'UPDATED') as n_updated, count(*) filter (store_result = 'SKIPPED') as n_skipped
  from labels group by all),
landed as (select community_name, count(*) as n_landed from listing_ev group by all)
select community_name, 'IDLE' as status, '' as reason, n_landed, 0::bigint as n_rejected, n_new, n_updated, n_skipped,
  last_page, {NOW} + (version - 2) * 21600 as ts, version
from landed join counted using (community_name)
union all
select 'lost', 'ERROR', 'a row without a place', count(*), 0, 0, 0, 0, 0, {NOW}, 2
from listing_ev where community_name = 'view' and pos % 25 = 0 having count(*) > 0"""

    week = _with(POSTS_EV, _recent(NOW))
    sql["retention_window"] = (
        ev + f"select {POST_COLUMNS} from posts_ev where time_stored >= {NOW - WEEK}"
    )
    sql["active_only"] = ev + "select id, community_id, is_active from posts_ev where is_active"
    bars = _with(POSTS_EV, _rules(RULES), _recent(NOW), BARS)
    sql["community_score_filter"] = (
        bars
        + """select b.feed, p.id, p.community_id, p.community_name, p.score, b.min_score
from recent p join bars b on p.community_name = b.community and p.score >= b.min_score"""
    )
    sql["feed_scan_cap"] = (
        _with(POSTS_EV, _rules(RULES), _recent(NOW), _candidates(NOW, 40))
        + "select feed, id, community_id, time_stored from candidates"
    )
    sql["feed_scan_cap_stamped"] = (
        _with(
            POSTS_EV,
            f"""stamped as (
  select * replace ({NOW} - time_stored % 3 * 21600 as time_stored) from posts_ev)""",
            _rules(RULES),
            _recent(NOW, "stamped"),
            _candidates(NOW, 40),
        )
        + "select feed, id, community_id, time_stored from candidates"
    )
    sql["zero_percentile_excluded"] = (
        _with(POSTS_EV, _rules(MUTED_RULES))
        + """select feed, id, community_id, community_name
from posts_ev join rules on community_name = community where percentile > 0"""
    )
    sql["image_feed_filter"] = (
        _with(
            POSTS_EV,
            _rules(RULES),
            "members as (select * from posts_ev join rules on community_name = community)",
            MEDIA.format(source="members"),
        )
        + """select feed, feed_media, id, community_id, media_url, media_embed
from linked where feed_media = 'text' or media_url <> '' or media_embed <> ''"""
    )

    sql["active_count"] = (
        week
        + """select community, count(p.id) as active_posts
from (values ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('nobody')) r(community)
left join recent p on p.community_name = r.community group by community"""
    )
    sql["score_at_percentile"] = _percentiles(
        f"{POSTS_EV}, {_recent(NOW)}",
        "select * from recent",
        ["0", "30", "50", "60", "99.9", "100"],
    )
    sql["score_at_percentile_orders"] = _percentiles(
        POSTS_ORD,
        "select * from posts_ord where is_active",
        ["0", "0.1", "30", "50", "70", "99.9", "101"],
    )
    sql["community_thresholds"] = (
        bars + "select feed, community, percentile, max_daily, min_score from bars"
    )
    candidates = _with(POSTS_EV, _rules(RULES), _recent(NOW), _candidates(NOW, 3000))
    sql["max_daily_posts"] = (
        candidates
        + """select feed, community_name, cast(age_in_days as bigint) as age_in_days, id,
  community_id, score, daily_rank
from (select *, row_number() over (partition by feed, community_name, age_in_days
        order by score desc, id, community_id) as daily_rank from candidates)
where daily_rank <= max_daily"""
    )
    feeds = _feeds(NOW)
    sql["feed_summary"] = (
        feeds
        + """select feed, count(*) as items, cast(ceil(count(*) / 10.0) as bigint) as pages
from feeds group by feed"""
    )

    sql["day_boundary"] = """select event_id, now, cast(epoch(case
    when hour(t) < 3 then date_trunc('day', t) + interval 3 hours
    else date_trunc('day', t) + interval 27 hours end) as bigint) as boundary
from (select event_id, cast(floor(epoch(ts)) as bigint) as now, ts as t from events)"""
    later = f"(cast(floor(epoch(ts)) as bigint) + {ZONE_DAYS * DAY})"
    sql["day_boundary_zone"] = (
        f"select event_id, {later} as now, {_boundary_in_zone(later)} as boundary from events"
    )
    sql["media_links_malformed"] = """select page_id, link, case when page_id % 6 in (3, 5) then link else '' end as media_url
from (select page_id, case page_id % 6
  when 0 then 'http://exa mple.org/i/' || page_id || '.png' when 1 then 'http://example.org:8x/i/' || page_id || '.png'
  when 2 then 'https://example.org/i/%zz' || page_id || '.png' when 3 then 'https://example.org:80/i/%41' || page_id || '.png'
  when 4 then 'https://[::1/i/' || page_id || '.png' else 'https://[::1]:8/i/' || page_id || '.png' end as link
  from pages)"""
    sql["age_in_days"] = (
        ev
        + f"""select id, community_id, time_stored,
  cast({_age(_boundary(str(NOW_MID)))} as bigint) as age_in_days from posts_ev"""
    )

    media = _with(POSTS_EV, MEDIA.format(source="posts_ev"))
    sql["media_links"] = media + "select id, community_id, url, media_url, media_embed from linked"
    sql["media_kind"] = media + "select id, community_id, media_kind from linked"
    sql["media_coverage"] = (
        media
        + "select community_name, count(*) as posts, count(*) filter (url <> '') as linked, "
        + ", ".join(
            f"count(*) filter (media_kind = '{k}') as {k}_posts"
            for k in ("embed", "mp4", "webm", "image", "none")
        )
        + " from linked group by community_name"
    )
    sql["domain_share"] = _host_share(POSTS_EV, "posts_ev", "giphy\\.com")
    sql["domain_share_pages"] = _host_share(
        "", "(select 'pages' as community_name, url from pages)", "example\\.com"
    )

    sql["rank_order"] = (
        candidates
        + """select feed, row_number() over (partition by feed
    order by community_name, age_in_days, score desc, id, community_id) as rank,
  community_name, cast(age_in_days as bigint) as age_in_days, score, id, community_id
from candidates"""
    )
    sql["rank_order_orders"] = (
        _with(POSTS_ORD, _rules(ORDER_RULES), _recent(ORDERS_NOW, "posts_ord"), _candidates(ORDERS_NOW, 2**62))
        + """select feed, row_number() over (partition by feed
    order by community_name, age_in_days, score desc, id, community_id) as rank,
  community_name, cast(age_in_days as bigint) as age_in_days, score, id
from candidates"""
    )
    sql["display_order"] = (
        candidates
        + """select feed, row_number() over (partition by feed
    order by time_stored desc, id, community_id) as display_rank, time_stored, id, community_id
from candidates"""
    )
    sql["feed_pages"] = (
        feeds
        + f"select feed, {PAGES} as page_no, display_rank, id, community_id from feeds"
    )
    sql["page_manifest"] = (
        feeds
        + f"""select feed, page_no, items, newest, oldest, {LINK} as link,
  case when page_no > 1 then '/reddit/?feed=' || feed || '&page=' || (page_no - 1) else '' end
    as previous_link,
  case when page_no < last_page then '/reddit/?feed=' || feed || '&page=' || (page_no + 1)
    else '' end as next_link
from (select feed, {PAGES} as page_no, count(*) as items, max(time_stored) as newest,
        min(time_stored) as oldest, max({PAGES}) over_all
      from feeds group by feed, {PAGES}) p
join (select feed, max({PAGES}) as last_page from feeds group by feed) l using (feed)""".replace(
            f", max({PAGES}) over_all", ""
        )
    )

    muted = _rules(MUTED_RULES).replace("rules(", "caps(", 1)
    sql["rule_lookup_join"] = (
        _with(POSTS_EV, _rules(RULES), muted)
        + """select r.feed, community_name, id, community_id, coalesce(c.max_daily, 0) as max_daily
from posts_ev p join rules r on p.community_name = r.community
left join caps c on c.feed = r.feed and c.community = r.community"""
    )
    sql["feed_membership"] = (
        _with(POSTS_EV, _rules(RULES))
        + """select feed, community_name, id, community_id, score
from posts_ev join rules on community_name = community"""
    )
    menu = _with(FEED_RULES, ACCOUNT_RULES, MENU)
    sql["feed_menu"] = menu + "select * from menu"

    sql["resolve_feed_rules"] = _with(FEED_RULES) + "select * from resolved where community_no > 0"
    ranges = [
        ("percentile outside 0-100", "(percentile < 0 or percentile > 100)"),
        ("daily cap negative", "max_daily < 0"),
    ]
    sql["feed_rule_violations"] = _with(FEED_RULES) + _rule_checks(
        "resolved",
        [
            ("feed name blank", "community_no <= 1 and feed = ''"),
            (
                "feed name has other characters",
                "community_no <= 1 and feed <> '' and not regexp_matches(feed, '^[-_a-zA-Z0-9]+$')",
            ),
            ("feed description blank", "community_no <= 1 and description = ''"),
            ("media type unknown", "community_no <= 1 and media not in ('image', 'text')"),
            ("community blank", "community_no > 0 and community = ''"),
            *[(text, f"community_no > 0 and {broken}") for text, broken in ranges],
        ],
        "document, feed_no, feed, community_no, community",
    )
    sql["account_rule_violations"] = _with(ACCOUNT_RULES) + _rule_checks(
        "account_rules",
        [
            ("feed name blank", "filter_no = 1 and feed = ''"),
            ("feed description blank", "filter_no = 1 and description = ''"),
            ("account blank", "account = ''"),
            ("filter type unknown", "filter_type not in ('original', 'retweets')"),
            *ranges,
        ],
        "document, feed_no, feed, filter_no, account",
    )
    sql["duplicate_feed_names"] = (
        menu + "select feed, count(*) as uses from menu group by feed having count(*) > 1"
    )
    sql["duplicate_communities"] = (
        _with(FEED_RULES)
        + """select community, count(*) as uses from resolved where community_no > 0
group by community having count(*) > 1"""
    )

    sql["harvest_stream"] = _stream() + f"select {POST_COLUMNS} from st3"
    snapshot_columns = "display_rank, id, community_id, score"
    sql["feed_snapshot"] = f"""select feed, cast({NOW - 1_800} as bigint) as snapshot_ts,
  {snapshot_columns} from ({_feeds(NOW - 1_800)} select * from feeds) where feed = 'news'
union all
select feed, cast({NOW} as bigint), {snapshot_columns}
from ({_feeds(NOW)} select * from feeds) where feed <> 'news'"""

    sql["feed_snapshot_changes"] = f"""select feed, cast({NOW} as bigint) as snapshot_ts, {snapshot_columns}
from ({_feeds(NOW)} select * from feeds)"""

    sql["feed_status"] = f"""with log as (
  select event_type as feed, cast(floor(epoch(ts)) as bigint) as ts,
    case event_id % 7 when 0 then 'ERROR' when 1 then 'HARVESTING' else 'IDLE' end as status,
    row_number() over (partition by event_type
      order by cast(floor(epoch(ts)) as bigint) desc, event_id desc) as back
  from events),
latest as (
  select f.feed, coalesce(status, 'IDLE') as status, coalesce(ts, 0) as last_harvest
  from (select distinct event_type as feed from events union all select 'quiet') f
  left join log l on l.feed = f.feed and back = 1)
select *, case status when 'ERROR' then 'Error' when 'HARVESTING' then 'Harvesting'
  else case when last_harvest = 0 then 'Not harvested yet'
    else printf('%02d:%02d ago', ({LOG_NOW} - last_harvest) // 3600,
      ({LOG_NOW} - last_harvest) // 60 % 60) end end as status_text
from latest"""
    sql["menu_with_status"] = f"""{menu.rstrip()},
log as (
  select 'feed_' || event_id % 200 || '_' || (1 + event_id % 2) as feed, cast(floor(epoch(ts)) as bigint) as ts,
    case event_id % 7 when 0 then 'ERROR' when 1 then 'HARVESTING' else 'IDLE' end as status,
    row_number() over (partition by event_id % 200, event_id % 2
      order by cast(floor(epoch(ts)) as bigint) desc, event_id desc) as back
  from events),
shown as (
  select m.*, coalesce(l.status, 'IDLE') as status, coalesce(l.ts, 0) as last_harvest
  from menu m left join log l on l.feed = m.feed and back = 1)
select *, case status when 'ERROR' then 'Error' when 'HARVESTING' then 'Harvesting'
  else case when last_harvest = 0 then 'Not harvested yet'
    else printf('%02d:%02d ago', ({LOG_NOW} - last_harvest) // 3600,
      ({LOG_NOW} - last_harvest) // 60 % 60) end end as status_text
from shown"""
    sql["feed_listing"] = (
        feeds
        + """select feed, display_rank, 'https://www.reddit.com' || permalink as link, title,
  case when length(title) > 11 then left(title, 11) || '...' else title end as title_preview,
  score, cast(age_in_days as bigint) as age_in_days, community_name as community,
  media_url, media_embed
from feeds"""
    )
    sql["build_feed"] = feeds + f"select {FEED_COLUMNS} from feeds where feed = 'news'"
    sql["build_all_feeds"] = feeds + f"select {FEED_COLUMNS} from feeds"
    sql["build_all_feeds_store"] = sql["build_all_feeds"]
    sql["build_all_feeds_orders"] = (
        _feeds(ORDERS_NOW, ORDER_RULES, "posts_ord", POSTS_ORD, cap=2**62)
        + """select feed, display_rank, id, community_name, score,
  cast(age_in_days as bigint) as age_in_days from feeds"""
    )
    return sql
