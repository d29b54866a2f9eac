"""Caps, orders and pages of feeds.

A feed that has been through ``feed_scan_cap`` is a few thousand rows and numbered in one
task. Where no such bound is stated, a feed may be any size and is numbered in ranges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import page_link
from feedloom.operators.prefix import numbers_in_order
from feedloom.operators.topn import top_n_per_group

# Fixed values.
PAGE_SIZE = 10
HIGHEST_PAGE = 5_000

TIES = ["id", "community_id"]

# Feeds known to have no more rows are numbered in one task.
ONE_TASK = 100_000


def max_daily_posts(posts: DataFrame, bound: int) -> DataFrame:
    """The best-scored posts per (feed, community, age) up to the rule's ``max_daily``.

    ``bound`` is the largest ``max_daily`` of any rule.
    """
    keys = ["feed", "community_name", "age_in_days"]
    order = [F.desc("score"), *TIES]
    return top_n_per_group(posts, keys, order, F.col("max_daily"), bound, "daily_rank")


def _numbered(posts: DataFrame, order: list, name: str, most: int | None) -> DataFrame:
    if most is None or most > ONE_TASK:
        return numbers_in_order(posts, "feed", order, name)
    within = Window.partitionBy("feed").orderBy(*order)
    return posts.withColumn(name, F.row_number().over(within).cast("long"))


def rank_order(posts: DataFrame, most: int | None = None) -> DataFrame:
    """Add ``rank``: by community, then age, then best score. No feed has over ``most`` rows, if given."""
    return _numbered(posts, ["community_name", "age_in_days", F.desc("score"), *TIES], "rank", most)


def display_order(posts: DataFrame, most: int | None = None) -> DataFrame:
    """Add ``display_rank``: newest stored first, then id. No feed has over ``most`` rows, if given."""
    return _numbered(posts, [F.desc("time_stored"), *TIES], "display_rank", most)


def feed_pages(posts: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Add ``page_no`` to posts in display order."""
    page = F.call_function("div", F.col("display_rank") - 1, F.lit(page_size).cast("long")) + 1
    return posts.withColumn("page_no", page)


def write_pages(pages: DataFrame, path: str) -> None:
    """Publish pages, a folder per feed: a feed is a few thousand rows, so a folder
    per page would be hundreds of files of ten rows each."""
    pages.write.mode("overwrite").partitionBy("feed").parquet(path)


def requested_page(text: str) -> int:
    """Page number asked for: blank, 0 and any text but a plain whole number mean page 1."""
    page_no = int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else 0
    if not 0 <= page_no <= HIGHEST_PAGE:
        raise ValueError(f"page must be 0 to {HIGHEST_PAGE}, not {page_no}")
    return page_no or 1


def read_page(pages: DataFrame, feed: str, page: str = "") -> DataFrame:
    """The items of one page of one feed, in display order."""
    here = (F.col("feed") == feed) & (F.col("page_no") == requested_page(page))
    return pages.where(here).orderBy("display_rank")


def page_manifest(pages: DataFrame) -> DataFrame:
    """One row per page: items, time range, its link and its neighbours' links."""
    manifest = pages.groupBy("feed", "page_no").agg(
        F.count(F.lit(1)).alias("items"),
        F.max("time_stored").alias("newest"),
        F.min("time_stored").alias("oldest"),
    )
    along = Window.partitionBy("feed").orderBy("page_no")
    linked = manifest.withColumn("link", page_link(F.col("feed"), F.col("page_no")))
    return linked.withColumns(
        {
            "previous_link": F.lag("link").over(along),
            "next_link": F.lead("link").over(along),
        }
    )


def feed_summary(posts: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Items and pages of every feed."""
    items = posts.groupBy("feed").agg(F.count(F.lit(1)).alias("items"))
    size = F.lit(page_size).cast("long")
    return items.withColumn("pages", F.call_function("div", F.col("items") + size - 1, size))
