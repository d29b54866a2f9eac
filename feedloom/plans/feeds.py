"""Whole feeds in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.media import with_media
from feedloom.functions.timeops import DAY_SECONDS, age_in_days, day_boundary
from feedloom.operators.filters import (
    active_only,
    community_score_filter,
    feed_scan_cap,
    image_feed_filter,
    retention_window,
)
from feedloom.operators.ranking import display_order, max_daily_posts
from feedloom.operators.rules import SizedRules, size_rules, zero_percentile_excluded
from feedloom.operators.scores import community_thresholds
from feedloom.schema import POST_COLUMNS
from feedloom.session import materialize, new_folder


def recent_posts(posts: DataFrame, now: int) -> DataFrame:
    """Posts a feed may show at ``now``."""
    return active_only(retention_window(posts, now)).select(*POST_COLUMNS)


def feed_candidates(
    posts: DataFrame,
    sized: SizedRules,
    now: int,
    tz: str = "UTC",
    scan_cap: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Posts over their community's threshold, with ``age_in_days``.

    With ``scan_cap`` only the newest so many of each feed; None keeps all. ``counts`` of the
    recent posts' scores, as the store's index keeps them, spare a pass over the posts.

    The thresholds, one row per rule, are stored once: two steps need them, and
    their plan reads all recent posts. Posts meet them in a broadcast join; only
    the newest ``scan_cap`` of each feed are shuffled. The windows that follow
    are per feed or finer and reuse that partitioning.
    """
    recent = recent_posts(posts, now)
    thresholds = community_thresholds(recent, sized, counts).select(
        "feed", "community", F.col("media").alias("feed_media"), "max_daily", "min_score"
    )
    thresholds = materialize(thresholds, new_folder(posts.sparkSession, "thresholds"))
    candidates = community_score_filter(recent, thresholds, sized).drop("min_score")
    boundary = day_boundary(F.lit(now).cast("long"), tz)
    if scan_cap is not None:
        candidates = feed_scan_cap(candidates, sized, scan_cap)
    return candidates.withColumn(
        "age_in_days", age_in_days(boundary, F.col("time_stored"))
    )


def build_all_feeds(
    posts: DataFrame,
    rules: DataFrame,
    now: int,
    tz: str = "UTC",
    scan_cap: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Every feed's posts at ``now`` with age, media and ``display_rank``.

    ``rules`` has resolved rules (see ``resolve_feed_rules``).
    """
    sized = size_rules(zero_percentile_excluded(rules))
    shown = image_feed_filter(with_media(feed_candidates(posts, sized, now, tz, scan_cap, counts)))
    capped = max_daily_posts(shown, sized.max_daily).drop("daily_rank", "max_daily")
    most = scan_cap if scan_cap is not None else _most_rows(recent_posts(posts, now), sized)
    return display_order(capped, most)


def _most_rows(recent: DataFrame, sized: SizedRules) -> int:
    """A number of rows that no feed exceeds: its daily caps over all days that have posts."""
    first, last = recent.agg(F.min("time_stored"), F.max("time_stored")).first()
    days = 0 if first is None else (last - first) // DAY_SECONDS + 2
    return sized.n * days * sized.max_daily


def build_feed(
    posts: DataFrame,
    rules: DataFrame,
    feed: str,
    now: int,
    tz: str = "UTC",
    scan_cap: int | None = None,
) -> DataFrame:
    """One feed's posts at ``now``."""
    return build_all_feeds(posts, rules.where(F.col("feed") == feed), now, tz, scan_cap)
