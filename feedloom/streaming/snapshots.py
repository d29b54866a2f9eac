"""Built feeds kept as snapshots and rebuilt only when stale."""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.timeops import DAY_SECONDS, day_boundary
from feedloom.operators.filters import RETENTION_DAYS, active_only
from feedloom.plans.feeds import build_all_feeds
from feedloom.schema import FEED_ITEMS
from feedloom.session import materialize, new_folder
from feedloom.sources.index import open_index
from feedloom.sources.posts import (
    changed_communities,
    newest_version,
    oldest_version,
    read_posts,
)

# Fixed value.
MAX_AGE_SECONDS = 3_600

# With so many communities or fewer, the reader is told their names.
NAMED_COMMUNITIES = 1_000

_LOG = "feed string, snapshot_ts long, version long"
_ITEMS = T.StructType([*FEED_ITEMS.fields, T.StructField("snapshot_ts", T.LongType())])


def _log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_LOG).parquet(f"{root}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def newest_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Newest finished snapshot of every feed, and the store's version it was built from, if known."""
    newest = F.max(F.struct("snapshot_ts", "version")).alias("newest")
    return _log(spark, root).groupBy("feed").agg(newest).select("feed", "newest.*")


def stale_rules(
    spark: SparkSession, root: str, rules: DataFrame, now: int, max_age: int = MAX_AGE_SECONDS
) -> DataFrame:
    """Rules of feeds whose newest snapshot is older than ``max_age``, or missing."""
    newest = newest_snapshots(spark, root).select("feed", F.col("snapshot_ts").alias("_built"))
    stale = F.col("_built").isNull() | (F.col("_built") + max_age < now)
    return rules.join(newest, "feed", "left").where(stale).drop("_built")


def _store_snapshots(
    posts: DataFrame, root: str, rules: DataFrame, now: int, tz: str, scan_cap: int | None,
    version: int | None = None, counts: DataFrame | None = None,
) -> None:
    built = build_all_feeds(posts, rules, now, tz, scan_cap, counts)
    (
        built.select(*FEED_ITEMS.fieldNames(), F.lit(now).cast("long").alias("snapshot_ts"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_ts", "feed")
        .parquet(f"{root}/items")
    )
    done = rules.select(
        "feed", F.lit(now).cast("long").alias("snapshot_ts"), F.lit(version).cast("long").alias("version")
    ).distinct()
    done.coalesce(1).write.mode("append").parquet(f"{root}/log")


def refresh_feeds(
    spark: SparkSession,
    root: str,
    posts: DataFrame,
    rules: DataFrame,
    now: int,
    tz: str = "UTC",
    max_age: int = MAX_AGE_SECONDS,
    scan_cap: int | None = None,
) -> None:
    """Build the stale feeds as of ``now`` and store them.

    Feeds are logged after their items are stored, so an unfinished refresh
    leaves the older snapshots in force and is simply run again.
    """
    stale = stale_rules(spark, root, rules, now, max_age)
    if stale.isEmpty():
        return
    _store_snapshots(posts, root, stale, now, tz, scan_cap)


def outdated_rules(
    spark: SparkSession, root: str, store: str, rules: DataFrame, now: int, tz: str = "UTC"
) -> DataFrame:
    """Rules of feeds that a refresh at ``now`` would build differently from their newest snapshot.

    That is a feed without a snapshot of a known version; one with a community that later
    versions of the store have put posts of; one with a community of which an active post
    has left the week since; and all feeds of which a day has ended since, as ages count days.
    Communities of which only posts changed that no feed shows are among them.
    """
    until = newest_version(spark, store) or 0
    # of versions that have expired it is not known what they changed
    kept = F.col("version") >= (oldest_version(spark, store) or 0)
    newest = newest_snapshots(spark, root).withColumn("version", F.when(kept, F.col("version")))
    rules = rules.join(newest, "feed", "left")
    known = rules.where("version is not null").select("version", "snapshot_ts").distinct()
    index = open_index(spark, store, until)
    found = [rules.where("version is null").select("feed")]
    today = day_boundary(F.lit(now).cast("long"), tz)
    found.append(rules.where(day_boundary(F.col("snapshot_ts"), tz) != today).select("feed"))
    for r in known.collect():  # a row for each refresh that is still in force
        own = rules.where((F.col("version") == r["version"]) & (F.col("snapshot_ts") == r["snapshot_ts"]))
        moved = changed_communities(spark, store, r["version"], until)
        weeks = [t - RETENTION_DAYS * DAY_SECONDS for t in (r["snapshot_ts"], now)]
        if index:
            left = index.communities_between(*weeks)
        else:
            stored = active_only(read_posts(spark, store, until))
            left = stored.where(F.col("time_stored").between(weeks[0], weeks[1] - 1)).select("community_name")
        moved = moved.unionByName(left).select(F.col("community_name").alias("community"))
        found.append(own.join(moved, "community", "left_semi").select("feed"))
    feeds = functools.reduce(DataFrame.unionByName, found).distinct()
    return rules.drop("snapshot_ts", "version").join(feeds, "feed", "left_semi")


def refresh_changed_feeds(
    spark: SparkSession,
    root: str,
    store: str,
    rules: DataFrame,
    now: int,
    tz: str = "UTC",
    scan_cap: int | None = None,
) -> list[str]:
    """Build the feeds that have changed since their snapshots, from the post store; returns their names.

    Only posts of those feeds' communities are read. The others' snapshots stay in force:
    building them again would give the same items. If the store has an index, thresholds
    come from it.
    """
    outdated = materialize(outdated_rules(spark, root, store, rules, now, tz), new_folder(spark, "outdated"))
    names = sorted(r["feed"] for r in outdated.select("feed").distinct().collect())
    if not names:
        return []
    version = newest_version(spark, store)
    communities = outdated.select("community").distinct().limit(NAMED_COMMUNITIES + 1).collect()
    posts = read_posts(spark, store, version)
    if len(communities) <= NAMED_COMMUNITIES:  # few enough to be tested by the Parquet reader
        posts = posts.where(F.col("community_name").isin([r["community"] for r in communities]))
    index = open_index(spark, store, version)
    counts = index.score_counts(now - RETENTION_DAYS * DAY_SECONDS) if index else None
    _store_snapshots(posts, root, outdated, now, tz, scan_cap, version, counts)
    return names


def current_feeds(spark: SparkSession, root: str) -> DataFrame:
    """Items of every feed's newest snapshot.

    The folders to read are named from the log, at most one time per feed, so
    older snapshots are not read.
    """
    newest = newest_snapshots(spark, root).select("feed", "snapshot_ts")
    times = [row[0] for row in newest.select("snapshot_ts").distinct().collect()]
    items = spark.read.schema(_ITEMS).parquet(f"{root}/items")
    return items.where(F.col("snapshot_ts").isin(times)).join(newest, ["feed", "snapshot_ts"])
