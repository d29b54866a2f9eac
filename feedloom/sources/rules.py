"""Rule documents: nested JSON to one row per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schema import ACCOUNT_DOCUMENT, FEED_DOCUMENT


def read_feed_documents(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Documents of community feeds, one per line (or one per file)."""
    return spark.read.schema(FEED_DOCUMENT).json(path, multiLine=multiline)


def read_account_documents(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Documents of account feeds, one per line (or one per file)."""
    return spark.read.schema(ACCOUNT_DOCUMENT).json(path, multiLine=multiline)


def feed_rules_source(documents: DataFrame) -> DataFrame:
    """One row per community of each feed, numbered from 1 within their parents.

    A feed without communities keeps one row with null community columns, so
    its own rules can still be judged. Unset numbers are 0, unset text is blank.
    """
    feeds = documents.select("document", F.posexplode("feeds").alias("feed_pos", "f"))
    members = feeds.select(
        "document", "feed_pos", "f", F.posexplode_outer("f.communities").alias("member_pos", "m")
    )
    listed = F.col("member_pos").isNotNull()
    return members.select(
        "document",
        (F.col("feed_pos") + 1).cast("long").alias("feed_no"),
        F.coalesce("f.name", F.lit("")).alias("feed"),
        F.coalesce("f.description", F.lit("")).alias("description"),
        F.coalesce("f.media", F.lit("")).alias("media"),
        F.coalesce("f.percentile", F.lit(0.0)).alias("feed_percentile"),
        F.coalesce("f.max_daily_posts", F.lit(0)).alias("feed_max_daily"),
        (F.col("member_pos") + 1).cast("long").alias("community_no"),
        F.when(listed, F.coalesce("m.name", F.lit(""))).alias("community"),
        F.when(listed, F.coalesce("m.percentile", F.lit(0.0))).alias("percentile"),
        F.when(listed, F.coalesce("m.max_daily_posts", F.lit(0))).alias("max_daily"),
    )


def account_rules_source(documents: DataFrame) -> DataFrame:
    """One row per filter of each account feed, as above."""
    feeds = documents.select("document", F.posexplode("feeds").alias("feed_pos", "f"))
    members = feeds.select(
        "document", "feed_pos", "f", F.posexplode_outer("f.filters").alias("member_pos", "m")
    )
    listed = F.col("member_pos").isNotNull()
    return members.select(
        "document",
        (F.col("feed_pos") + 1).cast("long").alias("feed_no"),
        F.coalesce("f.name", F.lit("")).alias("feed"),
        F.coalesce("f.description", F.lit("")).alias("description"),
        (F.col("member_pos") + 1).cast("long").alias("filter_no"),
        F.when(listed, F.coalesce("m.account", F.lit(""))).alias("account"),
        F.when(listed, F.coalesce("m.filtertype", F.lit(""))).alias("filter_type"),
        F.when(listed, F.coalesce("m.percentile", F.lit(0.0))).alias("percentile"),
        F.when(listed, F.coalesce("m.max_daily_posts", F.lit(0))).alias("max_daily"),
    )


def feeds_of(rules: DataFrame, source: str) -> DataFrame:
    """One row per feed (``source, document, feed_no, feed, description``)."""
    first = "community_no" if "community_no" in rules.columns else "filter_no"
    return rules.where(F.coalesce(F.col(first), F.lit(1)) == 1).select(
        F.lit(source).alias("source"), "document", "feed_no", "feed", "description"
    )
