"""Table jobs on post links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.links import computed_once, in_domain, with_link_parts
from feedloom.functions.media import media_kind, with_media

KINDS = ("embed", "mp4", "webm", "image", "none")


def media_links(posts: DataFrame) -> DataFrame:
    """Posts with nullable ``media{url, embed}``."""
    return with_media(posts)


def with_media_kind(posts: DataFrame) -> DataFrame:
    """Posts with ``media`` and ``media_kind``."""
    return with_media(posts).withColumn("media_kind", media_kind(F.col("media")))


def media_coverage(posts: DataFrame) -> DataFrame:
    """Per community: posts, posts with a link, and posts of each media kind."""
    kinds = with_media_kind(posts.select("community_name", "url"))
    return kinds.groupBy("community_name").agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(F.coalesce("url", F.lit("")) != "").alias("linked"),
        *[F.count_if(F.col("media_kind") == kind).alias(f"{kind}_posts") for kind in KINDS],
    )


def domain_share(posts: DataFrame, domain: str) -> DataFrame:
    """Posts per host of ``domain`` and their share of the community's posts.

    Hosts are counted first, so what follows runs on one row per (community,
    host). Totals come from a second aggregate instead of a window, which would
    gather all hosts of a community in one task.
    """
    hosts = (
        with_link_parts(posts.select("community_name", "url"))
        .select("community_name", computed_once(F.col("_host")).alias("host"))
        .groupBy("community_name", "host")
        .agg(F.count(F.lit(1)).alias("posts"))
    )
    totals = hosts.groupBy("community_name").agg(F.sum("posts").alias("community_posts"))
    share = F.col("posts") / F.col("community_posts")
    return (
        hosts.where(in_domain(F.col("host"), domain))
        .join(totals, "community_name")
        .withColumn("share", share)
    )
