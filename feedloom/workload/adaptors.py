"""The given tables seen as posts, listings, rules and logs.

Every view here is also written in DuckDB SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.prefix import row_numbers
from feedloom.operators.rules import resolve_feed_rules
from feedloom.schema import POST_COLUMNS
from feedloom.sources.listings import listing_normalize

# Clocks of the workload: inside and after the month of January 2024 that the
# events cover.
NOW = 1_706_616_000
NOW_MID = 1_705_320_000
CUT = 1_705_708_800
LOG_NOW = 1_706_800_000
ORDERS_NOW = 902_000_000
WEEK = 7 * 86_400
# Days that bring January's events to both sides of a clock change in ZONE, and its second.
ZONE, ZONE_DAYS, CLOCK_CHANGE = "America/Los_Angeles", 50, 1_710_064_800
DOC_SINCE = 1_700_003_000

# feed, description, media, feed percentile, feed cap, community, percentile, cap.
# 0 and blank are unset.
RULES = [
    ("news", "News", "", 60, 10, "view", 0, 0),
    ("news", "News", "", 60, 10, "Click", 30, 5),
    ("shop", "Shop", "image", 0, 0, "purchase", 0, 0),
    ("shop", "Shop", "image", 0, 0, "signup", 50, -1),
    ("all", "All errors", "text", 100, 20, "error", 0, 0),
]
# Some communities with a percentile below zero, one feed with nothing else.
MUTED_RULES = [
    ("news", "News", "", 60, 10, "view", -5, 0),
    ("news", "News", "", 60, 10, "click", 30, 5),
    ("shop", "Shop", "image", 0, 0, "purchase", 0, 0),
    ("all", "All errors", "text", -1, 20, "error", 0, 0),
]
ORDER_RULES = [
    ("urgent", "Urgent orders", "text", 60, 50, "1-urgent", 0, 0),
    ("urgent", "Urgent orders", "text", 60, 50, "2-high", 30, 0),
    ("rest", "Other orders", "text", 0, 0, "3-medium", 0, 0),
    ("rest", "Other orders", "text", 0, 0, "4-not specified", 100, 40),
    ("rest", "Other orders", "text", 0, 0, "5-low", 45, 0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Epoch second of a timestamp without zone, taken as UTC."""
    col = F.col(ts)
    days = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(col) * 3_600 + F.minute(col) * 60 + F.second(col)


def _since(df: DataFrame, ts: str, second: int | None) -> DataFrame:
    """Rows at or after an epoch second, tested on the bare column so that the
    Parquet reader skips what is older."""
    if second is None:
        return df
    text = f"timestampadd(SECOND, {second}, timestamp_ntz'1970-01-01 00:00:00')"
    return df.where(F.col(ts) >= F.expr(text))


def rule_rows(spark: SparkSession, rows: list[tuple] = RULES) -> DataFrame:
    """Unresolved rules as literal rows, which Spark knows the size of."""
    values = ", ".join(
        f"('{f}', '{d}', '{m}', {float(fp)}D, {fc}L, '{c}', {float(p)}D, {n}L)"
        for f, d, m, fp, fc, c, p, n in rows
    )
    return spark.sql(
        f"select * from values {values} as t"
        "(feed, description, media, feed_percentile, feed_max_daily,"
        " community, percentile, max_daily)"
    )


def rules(spark: SparkSession, rows: list[tuple] = RULES) -> DataFrame:
    return resolve_feed_rules(rule_rows(spark, rows))


# The link of an event, one of thirteen kinds.
_EVENT_URL = """case event_id % 13
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
  else 'https://example.org/page/' || event_id end"""


def raw_listing(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """Events as raw listing rows, not yet normalized."""
    events = _since(table(spark, sf_dir, "events"), "ts", since)
    return events.select(
        "event_id",
        F.expr("cast(event_id as string) as id"),
        F.expr("'c_' || event_type as community_id"),
        F.initcap("event_type").alias("community"),
        F.expr("'t3_' || event_id as name"),
        F.expr("'/r/' || event_type || '/comments/' || event_id as permalink"),
        epoch("ts").cast("double").alias("created_utc"),
        F.expr("event_id % 10 = 0 as deleted"),
        F.expr("event_id % 37 = 0 as stickied"),
        F.expr("cast(floor(value) as bigint) - 20 as score"),
        F.expr("event_type || ' item ' || event_id as title"),
        F.expr(f"{_EVENT_URL} as url"),
    )


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of landed files, a quarter of them broken in five ways."""
    kind = F.col("event_id") % 20
    rows = raw_listing(spark, sf_dir)
    for column, kinds in (("id", (1,)), ("title", (2,)), ("community", (5,)), ("created_utc", (5,))):
        rows = rows.withColumn(column, F.when(~kind.isin(*kinds), F.col(column)))
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"]))
    no_number = F.regexp_replace(line, '"score":-?[0-9]+', '"score":"many"')
    cut_off = F.expr("left(line, length(line) - 5)")
    return rows.select("event_id", line.alias("line"), no_number.alias("no_number")).select(
        F.when(kind == 3, F.col("no_number")).when(kind == 4, cut_off).otherwise(F.col("line")).alias("value")
    )


def posts_ev(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """Events as posts; ``since`` narrows the scan to what a caller will keep anyway."""
    return listing_normalize(raw_listing(spark, sf_dir, since))


def week_posts(spark: SparkSession, sf_dir: str, now: int = NOW) -> DataFrame:
    """``posts_ev``, of which only the week up to ``now`` and later is scanned."""
    return posts_ev(spark, sf_dir, since=now - WEEK)


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages: each community's events, newest first, a hundred a page."""
    listed = raw_listing(spark, sf_dir).withColumn(
        "chunk", -F.floor(F.col("created_utc") / 60)
    )
    order = [F.desc("created_utc"), F.col("event_id")]
    numbered = row_numbers(listed, ["community"], "chunk", order, "rn")
    hundred = F.lit(100).cast("long")
    rn = F.col("rn").cast("long") - 1
    return numbered.withColumns(
        {"page_no": F.call_function("div", rn, hundred) + 1, "pos": rn % hundred + 1}
    ).drop("chunk", "rn", "event_id")


def listing_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages as posts, with ``is_new`` for those after the cut."""
    pages = listing_normalize(landed_pages(spark, sf_dir))
    return pages.withColumn("is_new", F.col("time_created") >= CUT)


def posts_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts that link to a digest of their text; ``seq`` orders them."""
    return table(spark, sf_dir, "documents").select(
        F.expr("cast(doc_id as string) as id"),
        F.expr("'c_' || source as community_id"),
        F.col("source").alias("community_name"),
        F.expr("'t3_' || doc_id as name"),
        F.expr("'/r/' || source || '/comments/' || doc_id as permalink"),
        (F.col("doc_id") + 1_700_000_000).alias("time_created"),
        (F.col("doc_id") * 60 + 1_700_000_000).alias("time_stored"),
        F.expr("doc_id % 10 <> 0 as is_active"),
        F.lit(False).alias("is_sticky"),
        F.col("n_chars").alias("score"),
        F.expr("lang || ' document ' || doc_id as title"),
        F.concat(F.lit("doc://"), F.md5("text")).alias("url"),
        F.col("doc_id").alias("seq"),
    )


def doc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is already stored."""
    return posts_doc(spark, sf_dir).where("seq % 3 = 0").select(*POST_COLUMNS)


def doc_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as seen a day later: better scored, and every sixth has moved."""
    return posts_doc(spark, sf_dir).withColumns(
        {
            "url": F.expr("case when seq % 6 = 0 then url || '-v2' else url end"),
            "score": F.col("score") + 7,
            "title": F.concat(F.lit("new "), F.col("title")),
            "time_created": F.col("time_created") + 5,
            "time_stored": F.col("time_stored") + 86_400,
            "community_name": F.upper("community_name"),
        }
    )


def posts_ord(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """Orders as posts without links, stored when ordered."""
    ordered = epoch("o_orderdate")
    return _since(table(spark, sf_dir, "orders"), "o_orderdate", since).select(
        F.expr("cast(o_orderkey as string) as id"),
        F.expr("'c_' || o_orderpriority as community_id"),
        F.lower("o_orderpriority").alias("community_name"),
        F.expr("'t3_' || o_orderkey as name"),
        F.expr("'/r/orders/comments/' || o_orderkey as permalink"),
        ordered.alias("time_created"),
        ordered.alias("time_stored"),
        F.expr("o_orderstatus <> 'P' as is_active"),
        F.lit(False).alias("is_sticky"),
        F.expr("cast(floor(o_totalprice / 100) as bigint) as score"),
        F.expr("'order ' || o_orderkey as title"),
        F.lit("").alias("url"),
    )


def store_before_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to the cut, as stored by earlier harvests: lower scored, other titles."""
    return posts_ev(spark, sf_dir).where(F.col("time_created") < CUT).withColumns(
        {"score": F.col("score") - 5, "title": F.concat(F.lit("old "), F.col("title"))}
    )


# A feed document per customer: one or two feeds with up to three communities
# each. Remainders of the key spread unset fields and every kind of mistake.
_FEED_DOCUMENT = """select
  cast(c_custkey as string) as document,
  transform(sequence(1, 1 + c_custkey % 2), j -> named_struct(
    'name', case
      when c_custkey % 11 = 0 and j = 1 then ''
      when c_custkey % 13 = 0 then 'bad name ' || c_custkey
      when c_custkey % 19 = 0 then 'feed_' || (c_custkey - 1) || '_' || j
      else 'feed_' || c_custkey || '_' || j end,
    'description', case when c_custkey % 17 = 0 then '' else c_mktsegment end,
    'media', case c_custkey % 6 when 0 then 'image' when 1 then 'text' when 2 then 'video'
             else '' end,
    'percentile', cast(case
      when c_custkey % 5 = 0 then 0 when c_custkey % 23 = 0 then -1
      when c_custkey % 29 = 0 then 101 else abs(c_nationkey * 4) end as double),
    'max_daily_posts', cast(c_custkey % 8 - 1 as bigint),
    'communities', case when c_custkey % 4 = 0
      then cast(array() as array<struct<name: string, percentile: double, max_daily_posts: bigint>>)
      else transform(sequence(1, c_custkey % 4), i -> named_struct(
        'name', case
          when c_custkey % 31 = 0 and i = 1 then ''
          when c_custkey % 3 = 0 and i = 2 then 'Everyone'
          else 'Comm_' || c_custkey || '_' || j || '_' || i end,
        'percentile', cast(case when (c_custkey + i) % 3 = 0 then 0
          when (c_custkey + i) % 37 = 0 then 120 else (c_custkey + i) % 100 end as double),
        'max_daily_posts', cast((c_custkey + i) % 5 - 1 as bigint))) end)) as feeds
from {customer}"""

# An account feed document per supplier; some reuse a community feed's name.
_ACCOUNT_DOCUMENT = """select
  cast(s_suppkey as string) as document,
  transform(sequence(1, 1), j -> named_struct(
    'name', case
      when s_suppkey % 11 = 0 then ''
      when s_suppkey % 7 = 0 then 'feed_' || s_suppkey || '_1'
      else 'accounts_' || s_suppkey end,
    'description', case when s_suppkey % 17 = 0 then '' else s_name end,
    'filters', transform(sequence(1, 1 + s_suppkey % 3), i -> named_struct(
      'account', case when (s_suppkey + i) % 13 = 0 then '' else 'user_' || s_suppkey end,
      'filtertype', case (s_suppkey + i) % 5 when 0 then 'likes' when 1 then 'retweets'
                    else 'original' end,
      'percentile', cast(case when (s_suppkey + i) % 19 = 0 then -3
        else (s_suppkey + i) % 110 end as double),
      'max_daily_posts', cast((s_suppkey + i) % 9 - 1 as bigint))))) as feeds
from {supplier}"""


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FEED_DOCUMENT, customer=table(spark, sf_dir, "customer"))


def account_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ACCOUNT_DOCUMENT, supplier=table(spark, sf_dir, "supplier"))


def harvest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status changes of the feed named after their type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed"),
        epoch("ts").alias("ts"),
        F.col("event_id").alias("entry_no"),
        F.expr(
            "case event_id % 7 when 0 then 'ERROR' when 1 then 'HARVESTING' else 'IDLE' end"
        ).alias("status"),
    )


def menu_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status changes of feeds named as those of the first customers."""
    feed = F.expr("'feed_' || event_id % 200 || '_' || (1 + event_id % 2) as feed")
    return harvest_log(spark, sf_dir).select(F.col("entry_no").alias("event_id"), "ts", "entry_no", "status").select(
        feed, "ts", "entry_no", "status"
    )


def lost_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a community of their own, whose pages have lost their numbers."""
    lost = landed_pages(spark, sf_dir).where("community = 'View' and pos % 25 = 0")
    return lost.withColumns(
        {"community": F.lit("Lost"), "id": F.concat(F.lit("lost"), "id"), "page_no": F.lit(None).cast("long")}
    )


def odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a link of six kinds: bad host, port, escape and bracket, and two that are sound."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        """case page_id % 6
          when 0 then 'http://exa mple.org/i/' || page_id || '.png'
          when 1 then 'http://example.org:8x/i/' || page_id || '.png'
          when 2 then 'https://example.org/i/%zz' || page_id || '.png'
          when 3 then 'https://example.org:80/i/%41' || page_id || '.png'
          when 4 then 'https://[::1/i/' || page_id || '.png'
          else 'https://[::1]:8/i/' || page_id || '.png' end as url""",
    )
