"""One query per operator over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import timeops
from feedloom.operators import filters, ingest, media_jobs, ranking, scores, status
from feedloom.operators import rules as rule_ops
from feedloom.plans import feeds as feed_plans
from feedloom.plans import harvest
from feedloom.schema import POST_COLUMNS, POSTS
from feedloom.session import materialize, new_folder
from feedloom.sources import index, listings, posts
from feedloom.sources import rules as rule_sources
from feedloom.streaming import cursors
from feedloom.streaming import harvest as harvest_streaming
from feedloom.streaming import snapshots
from feedloom.workload import adaptors as a

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}

# Small enough to bite on the smallest tables.
SMALL_CAP = 40


def query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def _media_columns(df: DataFrame) -> DataFrame:
    """Media as two plain columns, blank where there is none."""
    return df.withColumns(
        {
            "media_url": F.coalesce("media.url", F.lit("")),
            "media_embed": F.coalesce("media.embed", F.lit("")),
        }
    ).drop("media")


# Sources, scans, sinks


@query
def listing_normalize(spark, sf):
    return listings.listing_normalize(a.raw_listing(spark, sf))


@query
def drop_sticky(spark, sf):
    kept = listings.drop_sticky(a.listing_ev(spark, sf))
    return kept.select("community_name", "page_no", "pos", "name", "is_new")


@query
def listing_rejects(spark, sf):
    """What becomes of every line: the reason it is refused for, or none."""
    folder = new_folder(spark, "lines")
    a.broken_lines(spark, sf).write.text(folder)
    raw = listings.read_listings(spark, folder)
    name = F.coalesce("name", F.regexp_extract("_corrupt_record", "t3_[0-9]+", 0))
    refused = listings.listing_rejects(raw).select(name.alias("name"), "reason")
    kept = listings.listing_normalize(raw).select("name", F.lit("").alias("reason"))
    return refused.unionByName(kept)


@query
def page_cursor(spark, sf):
    return listings.page_cursor(a.listing_ev(spark, sf))


@query
def page_cursor_batches(spark, sf):
    """The same from pages that land in three batches."""
    folder = new_folder(spark, "cursors")
    landed = materialize(a.landed_pages(spark, sf), f"{folder}/landed")
    for first, last in ((1, 2), (3, 7), (8, 10**9)):
        landed.where(F.col("page_no").between(first, last)).write.mode("append").json(f"{folder}/landing")
        listing = listings.stream_listings(spark, f"{folder}/landing")
        cursors.cursor_stream(listing, f"{folder}/root", f"{folder}/progress").awaitTermination()
    return cursors.read_cursors(spark, f"{folder}/root")


@query
def stamp_harvest_time(spark, sf):
    stamped = listings.stamp_harvest_time(a.listing_ev(spark, sf), a.NOW)
    return stamped.select("id", "community_id", "time_created", "time_stored")


@query
def posts_scan(spark, sf):
    return posts.posts_scan(
        a.posts_ev(spark, sf),
        "community_name = :community and score >= :least and time_stored >= :since",
        {"community": "click", "least": 10, "since": a.NOW_MID},
        order_by="time_created, id",
    )


@query
def posts_sink(spark, sf):
    root = new_folder(spark, "posts")
    posts.posts_sink(a.posts_ev(spark, sf), root)
    stored = posts.read_posts(spark, root)
    return stored.withColumn("stored_date", F.col("stored_date").cast("string"))


@query
def feed_rules_source(spark, sf):
    path = new_folder(spark, "rules")
    a.feed_documents(spark, sf).write.json(path)
    rows = rule_sources.feed_rules_source(rule_sources.read_feed_documents(spark, path))
    return rows.na.fill({"community_no": 0, "community": "", "percentile": 0.0, "max_daily": 0})


# Ingest


@query
def known_by_key(spark, sf):
    known = ingest.known_by_key(a.doc_batch(spark, sf), a.doc_store(spark, sf))
    return known.select("id", "community_id", "seq")


@query
def known_by_url(spark, sf):
    known = ingest.known_by_url(a.doc_batch(spark, sf), a.doc_store(spark, sf))
    return known.select("id", "community_id", "url")


@query
def ingest_classify(spark, sf):
    batch = ingest.by_sequence(a.doc_batch(spark, sf), "seq")
    labelled = ingest.ingest_classify(a.doc_store(spark, sf), batch)
    return labelled.select("id", "community_id", "store_result")


@query
def ingest_merge(spark, sf):
    batch = ingest.by_sequence(a.doc_batch(spark, sf), "seq")
    return ingest.ingest_merge(a.doc_store(spark, sf), batch)


# The same by the index of a stored store


def _merged(spark, sf, merges=3):
    """The store of documents with an index, and the batch in so many merges; its folder and version."""
    root = new_folder(spark, "indexed")
    posts.posts_sink(a.doc_store(spark, sf), root, version=1, index_buckets=16)
    batch = ingest.by_sequence(a.doc_batch(spark, sf), "seq")
    size = -(-(batch.agg(F.max("seq")).first()[0] + 1) // max(merges, 1))
    for i in range(merges):
        part = batch.where((F.col("seq") >= i * size) & (F.col("seq") < (i + 1) * size))
        posts.merge_posts(spark, root, part, version=2 + i)
    return root, 1 + merges


@query
def known_by_key_index(spark, sf):
    known = index.open_index(spark, *_merged(spark, sf, 0)).known_by_key(a.doc_batch(spark, sf))
    return known.select("id", "community_id", "seq")


@query
def known_by_url_index(spark, sf):
    known = index.open_index(spark, *_merged(spark, sf, 0)).known_by_url(a.doc_batch(spark, sf))
    return known.select("id", "community_id", "url")


@query
def ingest_classify_index(spark, sf):
    batch = ingest.by_sequence(a.doc_batch(spark, sf), "seq")
    labelled = index.open_index(spark, *_merged(spark, sf, 0)).classify(batch)
    return labelled.select("id", "community_id", "store_result")


@query
def ingest_merge_index(spark, sf):
    root, version = _merged(spark, sf)
    return posts.read_posts(spark, root, version).select(*POST_COLUMNS)


@query
def score_at_percentile_index(spark, sf):
    """Percentiles of a store that merges have changed, from the scores they kept."""
    kept = index.open_index(spark, *_merged(spark, sf)).score_counts(a.DOC_SINCE)
    counts = materialize(kept, new_folder(spark, "scores"))
    return scores.percentiles_of_counts(counts, [0, 10, 50, 90, 99.9, 100])


@query
def harvest_page_stats(spark, sf):
    return harvest.harvest_page_stats(a.listing_ev(spark, sf), F.col("is_new"))


@query
def harvest_stop_rule(spark, sf):
    stats = harvest.harvest_page_stats(a.listing_ev(spark, sf), F.col("is_new"))
    return harvest.harvest_stop_rule(stats)


def _harvest(spark, sf):
    store = a.store_before_harvest(spark, sf)
    landed = listings.listing_normalize(a.landed_pages(spark, sf))
    return store, harvest.harvest_run(store, landed, a.NOW)


@query
def harvest_run(spark, sf):
    store, result = _harvest(spark, sf)
    return result.applied_to(store)


@query
def harvest_run_pages(spark, sf):
    return _harvest(spark, sf)[1].pages


# Filters


@query
def retention_window(spark, sf):
    return filters.retention_window(a.posts_ev(spark, sf), a.NOW)


@query
def active_only(spark, sf):
    return filters.active_only(a.posts_ev(spark, sf)).select("id", "community_id", "is_active")


def _candidates(spark, sf, rows=a.RULES, cap=filters.SCAN_CAP):
    sized = rule_ops.size_rules(rule_ops.zero_percentile_excluded(a.rules(spark, rows)))
    return sized, feed_plans.feed_candidates(a.week_posts(spark, sf), sized, a.NOW, scan_cap=cap)


@query
def community_score_filter(spark, sf):
    sized = rule_ops.size_rules(a.rules(spark))
    recent = feed_plans.recent_posts(a.week_posts(spark, sf), a.NOW)
    bars = scores.community_thresholds(recent, sized).select("feed", "community", "min_score")
    kept = filters.community_score_filter(recent, bars, sized)
    return kept.select("feed", "id", "community_id", "community_name", "score", "min_score")


@query
def feed_scan_cap(spark, sf):
    _, capped = _candidates(spark, sf, cap=SMALL_CAP)
    return capped.select("feed", "id", "community_id", "time_stored")


@query
def feed_scan_cap_stamped(spark, sf):
    """The cap falls among many rows that three harvests gave their second."""
    stamped = a.posts_ev(spark, sf).withColumn("time_stored", F.lit(a.NOW) - F.col("time_stored") % 3 * 21_600)
    sized = rule_ops.size_rules(rule_ops.zero_percentile_excluded(a.rules(spark)))
    capped = feed_plans.feed_candidates(stamped, sized, a.NOW, scan_cap=SMALL_CAP)
    return capped.select("feed", "id", "community_id", "time_stored")


@query
def zero_percentile_excluded(spark, sf):
    live = rule_ops.zero_percentile_excluded(a.rules(spark, a.MUTED_RULES))
    members = rule_ops.feed_membership(a.posts_ev(spark, sf), live)
    return members.select("feed", "id", "community_id", "community_name")


@query
def image_feed_filter(spark, sf):
    rules = a.rules(spark).withColumnRenamed("media", "feed_media")
    members = a.posts_ev(spark, sf).join(
        rules.select("feed", "feed_media", F.col("community").alias("community_name")),
        "community_name",
    )
    kept = filters.image_feed_filter(media_jobs.media_links(members))
    return _media_columns(kept.select("feed", "feed_media", "id", "community_id", "media"))


# Aggregations


@query
def active_count(spark, sf):
    recent = feed_plans.recent_posts(a.week_posts(spark, sf), a.NOW)
    quiet = ("quiet", "Nobody posts here", "", 0, 0, "nobody", 0, 0)
    return scores.active_count(recent, a.rules(spark, [*a.RULES, quiet]))


@query
def score_at_percentile(spark, sf):
    recent = feed_plans.recent_posts(a.week_posts(spark, sf), a.NOW)
    return scores.score_at_percentile(recent, [0, 30, 50, 60, 99.9, 100])


@query
def score_at_percentile_orders(spark, sf):
    active = filters.active_only(a.posts_ord(spark, sf))
    return scores.score_at_percentile(active, [0, 0.1, 30, 50, 70, 99.9, 101])


@query
def community_thresholds(spark, sf):
    recent = feed_plans.recent_posts(a.week_posts(spark, sf), a.NOW)
    found = scores.community_thresholds(recent, rule_ops.size_rules(a.rules(spark)))
    return found.select("feed", "community", "percentile", "max_daily", "min_score")


@query
def max_daily_posts(spark, sf):
    sized, candidates = _candidates(spark, sf)
    kept = ranking.max_daily_posts(candidates, sized.max_daily)
    return kept.select(
        "feed", "community_name", "age_in_days", "id", "community_id", "score",
        F.col("daily_rank").cast("long").alias("daily_rank"),
    )


@query
def feed_summary(spark, sf):
    return ranking.feed_summary(_all_feeds(spark, sf))


# Time


@query
def day_boundary(spark, sf):
    now = a.table(spark, sf, "events").select("event_id", a.epoch("ts").alias("now"))
    return now.withColumn("boundary", timeops.day_boundary(F.col("now")))


@query
def day_boundary_zone(spark, sf):
    """In a zone whose clocks change within the days covered."""
    now = (a.epoch("ts") + a.ZONE_DAYS * timeops.DAY_SECONDS).alias("now")
    rows = a.table(spark, sf, "events").select("event_id", now)
    return rows.withColumn("boundary", timeops.day_boundary(F.col("now"), a.ZONE))


@query
def age_in_days(spark, sf):
    boundary = timeops.day_boundary(F.lit(a.NOW_MID).cast("long"))
    aged = a.posts_ev(spark, sf).select("id", "community_id", "time_stored")
    return aged.withColumn("age_in_days", timeops.age_in_days(boundary, F.col("time_stored")))


# Media


@query
def media_links(spark, sf):
    linked = media_jobs.media_links(a.posts_ev(spark, sf))
    return _media_columns(linked.select("id", "community_id", "url", "media"))


@query
def media_links_malformed(spark, sf):
    linked = media_jobs.media_links(a.odd_links(spark, sf))
    return linked.select("page_id", F.col("url").alias("link"), F.coalesce("media.url", F.lit("")).alias("media_url"))


@query
def media_kind(spark, sf):
    kinds = media_jobs.with_media_kind(a.posts_ev(spark, sf))
    return kinds.select("id", "community_id", "media_kind")


@query
def media_coverage(spark, sf):
    return media_jobs.media_coverage(a.posts_ev(spark, sf))


@query
def domain_share(spark, sf):
    return media_jobs.domain_share(a.posts_ev(spark, sf), "giphy.com")


@query
def domain_share_pages(spark, sf):
    pages = a.table(spark, sf, "pages").select(F.lit("pages").alias("community_name"), "url")
    return media_jobs.domain_share(pages, "example.com")


# Orders and pages


def _all_feeds(spark, sf):
    return feed_plans.build_all_feeds(
        a.week_posts(spark, sf), a.rules(spark), a.NOW, scan_cap=filters.SCAN_CAP
    )


@query
def rank_order(spark, sf):
    _, candidates = _candidates(spark, sf)
    ranked = ranking.rank_order(candidates, most=filters.SCAN_CAP)
    return ranked.select(
        "feed", "rank", "community_name", "age_in_days", "score", "id", "community_id"
    )


@query
def rank_order_orders(spark, sf):
    """Feeds of any size, numbered in ranges."""
    orders = a.posts_ord(spark, sf, since=a.ORDERS_NOW - a.WEEK)
    sized = rule_ops.size_rules(a.rules(spark, a.ORDER_RULES))
    ranked = ranking.rank_order(feed_plans.feed_candidates(orders, sized, a.ORDERS_NOW))
    return ranked.select("feed", "rank", "community_name", "age_in_days", "score", "id")


@query
def display_order(spark, sf):
    _, candidates = _candidates(spark, sf)
    ordered = ranking.display_order(candidates, most=filters.SCAN_CAP)
    return ordered.select("feed", "display_rank", "time_stored", "id", "community_id")


@query
def feed_pages(spark, sf):
    path = new_folder(spark, "pages")
    ranking.write_pages(ranking.feed_pages(_all_feeds(spark, sf)), path)
    pages = spark.read.parquet(path)
    return pages.select("feed", "page_no", "display_rank", "id", "community_id")


@query
def page_manifest(spark, sf):
    manifest = ranking.page_manifest(ranking.feed_pages(_all_feeds(spark, sf)))
    return manifest.na.fill("", ["previous_link", "next_link"])


# Joins and unions


@query
def rule_lookup_join(spark, sf):
    members = rule_ops.feed_membership(a.posts_ev(spark, sf), a.rules(spark))
    # Looking up other rules than those of the feeds leaves some without a cap.
    found = rule_ops.rule_lookup_join(members, a.rules(spark, a.MUTED_RULES))
    return found.select("feed", "community_name", "id", "community_id", "max_daily")


@query
def feed_membership(spark, sf):
    members = rule_ops.feed_membership(a.posts_ev(spark, sf), a.rules(spark))
    return members.select("feed", "community_name", "id", "community_id", "score")


def _feed_rules(spark, sf):
    return rule_sources.feed_rules_source(a.feed_documents(spark, sf))


def _account_rules(spark, sf):
    return rule_sources.account_rules_source(a.account_documents(spark, sf))


def _menus(spark, sf):
    return (
        rule_sources.feeds_of(_feed_rules(spark, sf), "community"),
        rule_sources.feeds_of(_account_rules(spark, sf), "account"),
    )


@query
def feed_menu(spark, sf):
    return rule_ops.feed_menu(*_menus(spark, sf))


# Rules


@query
def resolve_feed_rules(spark, sf):
    listed = _feed_rules(spark, sf).where("community_no is not null")
    return rule_ops.resolve_feed_rules(listed)


@query
def feed_rule_violations(spark, sf):
    return rule_ops.feed_rule_violations(rule_ops.resolve_feed_rules(_feed_rules(spark, sf)))


@query
def account_rule_violations(spark, sf):
    return rule_ops.account_rule_violations(_account_rules(spark, sf))


@query
def duplicate_feed_names(spark, sf):
    return rule_ops.duplicate_feed_names(*_menus(spark, sf))


@query
def duplicate_communities(spark, sf):
    return rule_ops.duplicate_communities(rule_ops.resolve_feed_rules(_feed_rules(spark, sf)))


# Streaming


# Events land in three drops by date. Every fifth event lands once more with the
# next drop, better scored; every fifteenth then also has another link.
DROP_ENDS = (1_704_931_200, 1_705_708_800)


def _drops(spark, sf):
    rows = a.landed_pages(spark, sf)
    created = F.col("created_utc")
    drop = F.when(created < DROP_ENDS[0], 0).when(created < DROP_ENDS[1], 1).otherwise(2)
    rows = rows.withColumn("drop", drop)
    event = F.col("id").cast("long")
    again = rows.where((event % 5 == 0) & (F.col("drop") < 2)).withColumns(
        {
            "drop": F.col("drop") + 1,
            "score": F.col("score") + 7,
            "url": F.when((event % 15 == 0) & (F.col("url") != ""), F.concat("url", F.lit("-v2")))
            .otherwise(F.col("url")),
        }
    )
    return rows.unionByName(again)


@query
def harvest_stream(spark, sf):
    folder = new_folder(spark, "stream")
    root, landing = f"{folder}/store", f"{folder}/landing"
    posts.posts_sink(spark.createDataFrame([], POSTS), root, version=0)
    drops = materialize(_drops(spark, sf), f"{folder}/drops")
    for drop in range(3):
        landed = drops.where(F.col("drop") == drop).drop("drop")
        landed.write.mode("append").json(landing)
        harvest_streaming.harvest_stream(
            listings.stream_listings(spark, landing),
            root,
            checkpoint=f"{folder}/progress",
            run_ts=lambda batch_id: a.NOW + batch_id * 21_600,
            once=True,
        ).awaitTermination()
    return posts.read_posts(spark, root).select(*POST_COLUMNS)


def _harvested_twice(spark, sf):
    """A store with an index, harvested twice by a stream with the stop rule; one community is broken."""
    folder = new_folder(spark, "stream")
    root, landing = f"{folder}/store", f"{folder}/landing"
    posts.posts_sink(a.store_before_harvest(spark, sf), root, index_buckets=8)
    landed = materialize(a.landed_pages(spark, sf), f"{folder}/landed")
    lost = a.lost_pages(spark, sf).select(landed.columns)
    for rows in (landed.unionByName(lost), landed.withColumn("score", F.col("score") + 7)):
        rows.write.mode("append").json(landing)
        harvest_streaming.harvest_stream(
            listings.stream_listings(spark, landing),
            root,
            checkpoint=f"{folder}/progress",
            run_ts=lambda batch_id: a.NOW + batch_id * 21_600,
            stop_rule=True,
            once=True,
        ).awaitTermination()
    return root


@query
def harvest_stream_stop_rule(spark, sf):
    return posts.read_posts(spark, _harvested_twice(spark, sf)).select(*POST_COLUMNS)


@query
def harvest_ledger(spark, sf):
    ledger = harvest_streaming.read_ledger(spark, _harvested_twice(spark, sf))
    return ledger.na.fill({"reason": "", "n_new": 0, "n_updated": 0, "n_skipped": 0, "last_page": 0})


@query
def feed_snapshot(spark, sf):
    root = new_folder(spark, "snapshots")
    events = a.posts_ev(spark, sf, since=a.NOW - 7_200 - a.WEEK)
    rules = a.rules(spark)
    # Two feeds two hours ago, one of them again half an hour ago, then all.
    for part, now in (("feed <> 'all'", 7_200), ("feed = 'news'", 1_800), ("true", 0)):
        snapshots.refresh_feeds(
            spark, root, events, rules.where(part), a.NOW - now, scan_cap=filters.SCAN_CAP
        )
    current = snapshots.current_feeds(spark, root)
    return current.select("feed", "snapshot_ts", "display_rank", "id", "community_id", "score")


@query
def feed_snapshot_changes(spark, sf):
    """Feeds of a store, rebuilt after a merge only where the merge changed them."""
    folder = new_folder(spark, "snapshots")
    events = materialize(a.posts_ev(spark, sf, since=a.NOW - a.WEEK), f"{folder}/events")
    # some clicks come later: links that no other post has
    later = F.expr("community_name = 'click' and cast(id as bigint) % 13 in (1, 3, 5) and cast(id as bigint) % 4 = 0")
    posts.posts_sink(events.where(~later), f"{folder}/store", version=1, index_buckets=4)
    rules = a.rules(spark)
    refresh = lambda: snapshots.refresh_changed_feeds(
        spark, f"{folder}/feeds", f"{folder}/store", rules, a.NOW, scan_cap=filters.SCAN_CAP
    )
    refresh()
    batch = ingest.by_sequence(events.where(later).withColumn("seq", F.col("id").cast("long")), "seq")
    posts.merge_posts(spark, f"{folder}/store", batch, version=2)
    refresh()
    current = snapshots.current_feeds(spark, f"{folder}/feeds")
    return current.select("feed", "snapshot_ts", "display_rank", "id", "community_id", "score")


# Reports and the whole pipeline


@query
def feed_status(spark, sf):
    log = a.harvest_log(spark, sf)
    feeds = log.select("feed").distinct().unionByName(spark.sql("select 'quiet' as feed"))
    return status.feed_status(feeds, log, a.LOG_NOW)


@query
def menu_with_status(spark, sf):
    return status.menu_with_status(rule_ops.feed_menu(*_menus(spark, sf)), a.menu_log(spark, sf), a.LOG_NOW)


@query
def feed_listing(spark, sf):
    return status.feed_listing(_all_feeds(spark, sf), preview_chars=11)


_FEED_COLUMNS = [
    "feed", "display_rank", "id", "community_id", "community_name", "time_stored", "score",
    "title", "url", "age_in_days", "media",
]


@query
def build_feed(spark, sf):
    built = feed_plans.build_feed(a.week_posts(spark, sf), a.rules(spark), "news", a.NOW, scan_cap=filters.SCAN_CAP)
    return _media_columns(built.select(*_FEED_COLUMNS))


@query
def build_all_feeds(spark, sf):
    return _media_columns(_all_feeds(spark, sf).select(*_FEED_COLUMNS))


@query
def build_all_feeds_store(spark, sf):
    """Feeds from a stored store: a week's folders are read, thresholds come from its index."""
    root = new_folder(spark, "store")
    posts.posts_sink(a.posts_ev(spark, sf), root, version=1, index_buckets=4)
    counts = index.open_index(spark, root, 1).score_counts(a.NOW - a.WEEK)
    built = feed_plans.build_all_feeds(
        posts.read_posts(spark, root), a.rules(spark), a.NOW, scan_cap=filters.SCAN_CAP, counts=counts
    )
    return _media_columns(built.select(*_FEED_COLUMNS))


@query
def build_all_feeds_orders(spark, sf):
    """Feeds over orders, in the middle of the years the table covers."""
    orders = a.posts_ord(spark, sf, since=a.ORDERS_NOW - a.WEEK)
    rules = a.rules(spark, a.ORDER_RULES)
    built = feed_plans.build_all_feeds(orders, rules, a.ORDERS_NOW)
    return built.select("feed", "display_rank", "id", "community_name", "score", "age_in_days")
