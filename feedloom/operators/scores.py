"""Score thresholds: the score at the top-P-percent point of a community."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.rules import SizedRules, size_rules
from feedloom.session import materialize, new_folder

# Scores are ranked in bands of 2**16: a window inside a band holds at most 65,536
# scores, one over the bands of a community at most 65,536 bands for scores that
# spread over 32 bits.
BAND_BITS = 16


def active_count(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Posts per rule's community, 0 where there are none."""
    sized = size_rules(rules)
    communities = sized.rows.select("community").distinct()
    counts = posts.groupBy(F.col("community_name").alias("community")).agg(
        F.count(F.lit(1)).alias("active_posts")
    )
    return communities.join(counts, "community", "left").withColumn(
        "active_posts", F.coalesce("active_posts", F.lit(0))
    )


def score_histogram(posts: DataFrame) -> DataFrame:
    """Posts per (community, score): small however hot a community is.

    Stored, because a percentile takes two looks at it and the posts should be
    read only once.
    """
    counts = posts.groupBy(F.col("community_name").alias("community"), "score").agg(
        F.count(F.lit(1)).alias("n")
    )
    return materialize(counts, new_folder(posts.sparkSession, "scores"))


def community_thresholds(
    posts: DataFrame, sized: SizedRules, counts: DataFrame | None = None
) -> DataFrame:
    """Rules with ``min_score``, the lowest score their percentile lets in.

    With n posts that is the score at zero-based offset int(P * n / 100) in
    descending order; 0 for P ≥ 100 and for communities without posts. All
    rules are answered in one pass over the posts. Given ``counts`` of them
    (community, score, n), such as a store's index keeps, no post is read.
    """
    wanted = sized.rows.select("community").distinct()
    if counts is not None:
        kept = counts.join(sized.hint(wanted), "community", "left_semi")
        return _thresholds(materialize(kept, new_folder(posts.sparkSession, "scores")), sized)
    wanted = wanted.withColumnRenamed("community", "community_name")
    posts = posts.join(sized.hint(wanted), "community_name", "left_semi")
    return _thresholds(score_histogram(posts), sized)


def score_at_percentile(posts: DataFrame, percentiles: list[float]) -> DataFrame:
    """``min_score`` of every community of ``posts`` at each of the percentiles."""
    return percentiles_of_counts(score_histogram(posts), percentiles)


def percentiles_of_counts(hist: DataFrame, percentiles: list[float]) -> DataFrame:
    """``score_at_percentile`` from stored counts of posts (community, score, n)."""
    asked = F.explode(F.array(*[F.lit(float(p)) for p in percentiles]))
    rules = (
        hist.select("community")
        .distinct()
        .select("community", asked.alias("percentile"))
        .withColumn("feed", F.col("percentile").cast("string"))
    )
    # These rules grow with the communities found, so they are not broadcast.
    found = _thresholds(hist, SizedRules(rules, small=False, max_daily=0))
    return found.select("community", "percentile", "min_score")


def _thresholds(hist: DataFrame, sized: SizedRules) -> DataFrame:
    """Answer every rule from a score histogram.

    A running count over score bands finds the band of each percentile asked of a
    community, then one over the scores of those bands finds the score. Neither
    depends on how many feeds ask.
    """
    hist = hist.withColumn("band", F.shiftright("score", BAND_BITS))
    down = Window.partitionBy("community").orderBy(F.desc("band"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = (
        hist.groupBy("community", "band")
        .agg(F.sum("n").alias("in_band"))
        .withColumns(
            {
                "upto": F.sum("in_band").over(down),
                "total": F.sum("in_band").over(whole),
            }
        )
    )
    rank = (F.col("percentile") * F.col("total") / F.lit(100.0)).cast("long")
    targets = (
        sized.rows.where("percentile < 100")
        .select("community", "percentile")
        .distinct()
        .join(bands, "community")
        .withColumn("offset", F.least(rank, F.col("total") - 1))
        .withColumn("above", F.col("upto") - F.col("in_band"))
        .where("above <= offset and offset < upto")
        .select("community", "percentile", "band", (F.col("offset") - F.col("above")).alias("place"))
    )
    inside = Window.partitionBy("community", "band").orderBy(F.desc("score"))
    wanted = targets.select("community", "band").distinct()
    reached = hist.join(sized.hint(wanted), ["community", "band"], "left_semi").withColumn(
        "reached", F.sum("n").over(inside)
    )
    found = (
        reached.join(sized.hint(targets), ["community", "band"])
        .where("reached - n <= place and place < reached")
        .select("community", "percentile", F.col("score").alias("min_score"))
    )
    return sized.rows.join(sized.hint(found), ["community", "percentile"], "left").withColumn(
        "min_score", F.coalesce("min_score", F.lit(0))
    )
