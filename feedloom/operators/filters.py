"""Predicates on posts and feed candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.timeops import DAY_SECONDS, stored_date
from feedloom.operators.rules import SizedRules
from feedloom.schema import KEY
from feedloom.session import materialize, new_folder

# Fixed values.
RETENTION_DAYS = 7
SCAN_CAP = 3_000

# A second with more candidates of a feed is looked into before the scan cap's shuffle, by
# beginnings of ids up to so many characters.
CROWDED = 10_000
LONGEST_START = 64


def retention_window(posts: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Posts first stored in the last ``days`` days, the bound included.

    On a store partitioned by ``stored_date`` the date is tested too, so older
    directories are never listed or read.
    """
    oldest = F.lit(now - days * DAY_SECONDS).cast("long")
    recent = posts.where(F.col("time_stored") >= oldest)
    if "stored_date" in posts.columns:
        recent = recent.where(F.col("stored_date") >= stored_date(oldest))
    return recent


def active_only(posts: DataFrame) -> DataFrame:
    return posts.where("is_active")


def community_score_filter(posts: DataFrame, thresholds: DataFrame, sized: SizedRules) -> DataFrame:
    """Posts at or above their community's ``min_score``, once per feed.

    ``thresholds`` has one row per rule, so it is broadcast when rules are few
    and posts are not shuffled.
    """
    bars = thresholds.withColumnRenamed("community", "community_name")
    return posts.join(sized.hint(bars), "community_name").where("score >= min_score")


def feed_scan_cap(candidates: DataFrame, sized: SizedRules, cap: int) -> DataFrame:
    """The newest ``cap`` candidates of each feed, ties by id.

    A histogram over stored seconds (at most one row per feed and second) finds
    the second in which the cap falls. A harvest gives all its rows one second, so a
    second with more than ``CROWDED`` candidates is looked into by the beginnings of
    ids, until the cap falls among so few. Rows beyond are dropped before any shuffle;
    what is stored and numbered is at most ``cap + CROWDED`` rows of a feed.
    """
    spark, columns = candidates.sparkSession, candidates.columns
    newest = Window.partitionBy("feed").orderBy(F.desc("time_stored"))
    seconds = (
        candidates.groupBy("feed", "time_stored").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(newest))
        .where(F.col("upto") - F.col("n") < cap)
    )
    above = (F.col("upto") - F.col("n")).alias("above")
    last = F.min_by(F.struct("time_stored", above, "n"), "time_stored")
    cuts = seconds.groupBy("feed").agg(last.alias("last")).selectExpr(
        "feed", "last.time_stored as _second", "last.above as _above", "last.n as _inside", "0 as _chars", "'' as _start"
    )
    cuts = materialize(cuts, new_folder(spark, "cuts"))
    open_ones = cuts.where(_crowded(cap))
    while not open_ones.isEmpty():
        closer = materialize(_closer(candidates, open_ones, sized, cap), new_folder(spark, "cuts"))
        rest = cuts.join(closer.select("feed"), "feed", "left_anti")
        cuts = materialize(rest.unionByName(closer), new_folder(spark, "cuts"))
        open_ones = cuts.where(_crowded(cap))
    late = candidates.join(sized.hint(cuts), "feed").where(
        "time_stored > _second or time_stored = _second and substring(id, 1, _chars) <= _start"
    )
    late = materialize(late.select(*columns), new_folder(spark, "late"))
    order = Window.partitionBy("feed").orderBy(F.desc("time_stored"), "id", "community_id")
    numbered = late.select("feed", "time_stored", *KEY).withColumn("_rank", F.row_number().over(order))
    kept = numbered.where(F.col("_rank") <= cap).select("feed", *KEY)
    return late.join(kept, ["feed", *KEY], "left_semi").select(*columns)


def _crowded(cap: int) -> str:
    """Cuts to be looked into; an id that long is not told apart by its beginning."""
    return f"_inside > {CROWDED} and _above + _inside > {cap} and _chars < {LONGEST_START}"


def _closer(candidates: DataFrame, cuts: DataFrame, sized: SizedRules, cap: int) -> DataFrame:
    """The cuts with the beginning of ids, two characters longer, that the cap falls in."""
    here = candidates.select("feed", "time_stored", "id").join(sized.hint(cuts), "feed").where(
        "time_stored = _second and substring(id, 1, _chars) = _start"
    )
    starts = here.groupBy("feed", "_second", "_above", "_chars", F.expr("substring(id, 1, _chars + 2)").alias("start"))
    along = Window.partitionBy("feed").orderBy("start")
    upto = F.sum("n").over(along)
    found = starts.agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto + F.col("_above"))
    # what comes before the cap's beginning counts as above it
    last = F.max_by(F.struct("start", "n", "upto"), "start").alias("last")
    return found.where(F.col("upto") - F.col("n") < cap).groupBy("feed", "_second", "_chars").agg(last).selectExpr(
        "feed", "_second", "last.upto - last.n as _above", "last.n as _inside", "_chars + 2 as _chars", "last.start as _start"
    )


def image_feed_filter(posts: DataFrame) -> DataFrame:
    """Image feeds keep only posts with media; other feeds keep all.

    ``feed_media`` is the feed's media type, ``media`` the post's media link.
    """
    return posts.where((F.col("feed_media") != "image") | F.col("media").isNotNull())
