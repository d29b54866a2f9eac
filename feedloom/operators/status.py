"""Reports: harvest status of feeds and the rows a feed page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import preview

# Fixed values.
IDLE, HARVESTING, ERROR = "IDLE", "HARVESTING", "ERROR"
SITE_PREFIX = "https://www.reddit.com"


_LOG = "feed string, ts long, entry_no long, status string"


def log_status(feeds: DataFrame, path: str, ts: int, entry_no: int, status: str) -> None:
    """Note a status of all ``feeds`` in the harvest log at ``path``."""
    entry = feeds.select(
        "feed",
        F.lit(ts).cast("long").alias("ts"),
        F.lit(entry_no).cast("long").alias("entry_no"),
        F.lit(status).alias("status"),
    )
    entry.distinct().coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LOG).parquet(path)


def feed_status(feeds: DataFrame, harvest_log: DataFrame, now: int) -> DataFrame:
    """Latest status and harvest time of each feed, with the text a menu shows.

    ``harvest_log`` has ``feed, ts, entry_no, status``; the latest row by
    (ts, entry_no) counts. A feed with no row is idle and not harvested yet.
    """
    latest = harvest_log.groupBy("feed").agg(
        F.max(F.struct("ts", "entry_no", "status")).alias("last")
    )
    waited = F.lit(now).cast("long") - F.col("last_harvest")
    # Whole hours are not wrapped at 24, and pad to two digits without cutting.
    ago = F.format_string(
        "%02d:%02d ago",
        F.floor(waited / 3600),
        F.floor(waited / 60) % 60,
    )
    return (
        feeds.join(latest, "feed", "left")
        .withColumn("status", F.coalesce("last.status", F.lit(IDLE)))
        .withColumn("last_harvest", F.coalesce("last.ts", F.lit(0)))
        .drop("last")
        .withColumn(
            "status_text",
            F.when((F.col("status") == IDLE) & (F.col("last_harvest") == 0), "Not harvested yet")
            .when(F.col("status") == IDLE, ago)
            .when(F.col("status") == HARVESTING, "Harvesting")
            .otherwise("Error"),
        )
    )


def menu_with_status(menu: DataFrame, harvest_log: DataFrame, now: int) -> DataFrame:
    """``feed_menu`` with each feed's status and the text shown for it, sorted by feed name.

    Feeds of two sources that share a name share its status.
    """
    return feed_status(menu, harvest_log, now).orderBy("feed", "source")


def feed_listing(
    posts: DataFrame, site_prefix: str = SITE_PREFIX, preview_chars: int = 80
) -> DataFrame:
    """What a page shows of each post of a feed."""
    return posts.select(
        "feed",
        "display_rank",
        F.concat(F.lit(site_prefix), "permalink").alias("link"),
        "title",
        preview(F.col("title"), preview_chars).alias("title_preview"),
        "score",
        "age_in_days",
        F.col("community_name").alias("community"),
        F.coalesce("media.url", F.lit("")).alias("media_url"),
        F.coalesce("media.embed", F.lit("")).alias("media_embed"),
    )
