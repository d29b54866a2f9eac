"""Feed rules: defaults, quality checks and joins with posts.

A rule row is one community of one feed:
``feed, description, media, community, percentile, max_daily``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_PERCENTILE = 80.0
DEFAULT_MAX_DAILY = 100
MEDIA_TYPES = ("image", "text")
FILTER_TYPES = ("original", "retweets")
FEED_NAME_PATTERN = r"^[-_a-zA-Z0-9]+\z"

# Above this size of the rules, texts and all, nothing derived from them is broadcast.
MAX_BROADCAST_BYTES = 32_000_000


@dataclass(frozen=True)
class SizedRules:
    """Rules with one row per (feed, community), and what a plan must know of them.

    ``max_daily`` and ``n`` are numbers that no cap and no feed's communities exceed.
    """

    rows: DataFrame
    small: bool
    max_daily: int
    n: int = 0

    def hint(self, df: DataFrame) -> DataFrame:
        """Mark for broadcast a table with at most one row per rule, if rules are few.

        Otherwise the join is left to Spark, which shuffles and splits hot keys.
        """
        return F.broadcast(df) if self.small else df


def size_rules(rules: DataFrame) -> SizedRules:
    """Measure the rules table; of repeated (feed, community) rows the last one counts.

    Last by document, place of the feed in it and place of the community in the feed.
    """
    pair = F.struct("feed", "community")
    texts = [c for c, kind in rules.dtypes if kind == "string"]
    size = F.lit(16 * len(rules.columns) + 64)  # numbers, and what an operator adds
    for c in texts:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    n, distinct, max_daily, in_bytes = rules.agg(
        F.count(F.lit(1)),
        F.count_distinct(pair),
        F.coalesce(F.max("max_daily"), F.lit(0)),
        F.coalesce(F.sum(size.cast("long")), F.lit(0)),
    ).first()
    if n != distinct:
        place = ("document", "feed_no", "community_no")
        if missing := [c for c in place if c not in rules.columns]:
            raise ValueError(f"repeated rules, and no {', '.join(missing)} to order them by")
        position = F.struct(*place)
        others = [c for c in rules.columns if c not in ("feed", "community")]
        rules = (
            rules.groupBy("feed", "community")
            .agg(F.max_by(F.struct(*others), position).alias("last"))
            .select("feed", "community", "last.*")
        )
    return SizedRules(rules, in_bytes <= MAX_BROADCAST_BYTES, max_daily, n)


def resolve_feed_rules(
    rules: DataFrame,
    default_percentile: float = DEFAULT_PERCENTILE,
    default_max_daily: int = DEFAULT_MAX_DAILY,
) -> DataFrame:
    """Cascade defaults community → feed → global.

    0 (or missing) means unset; a negative daily cap asks for 0. Blank media is
    text and community names are lower-cased.
    """

    def given(value: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(value), F.lit(0)), default)

    feed_daily = F.greatest(given("feed_max_daily", F.lit(default_max_daily)), F.lit(0))
    daily = F.greatest(given("max_daily", F.lit(None).cast("long")), F.lit(0))
    media = F.coalesce(F.nullif(F.col("media"), F.lit("")), F.lit("text"))
    return rules.withColumns(
        {
            "feed_percentile": given("feed_percentile", F.lit(default_percentile)),
            "feed_max_daily": feed_daily.cast("long"),
            "media": media,
            "community": F.lower("community"),
        }
    ).withColumns(
        {
            "percentile": given("percentile", F.col("feed_percentile")),
            "max_daily": F.when(F.col("max_daily") != 0, daily)
            .otherwise(F.col("feed_max_daily"))
            .cast("long"),
        }
    )


def rule_lookup_join(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Posts of feeds (``feed, community_name``) with their rule's cap; no rule → 0."""
    sized = size_rules(rules)
    caps = sized.rows.select("feed", F.col("community").alias("community_name"), "max_daily")
    return posts.join(sized.hint(caps), ["feed", "community_name"], "left").withColumn(
        "max_daily", F.coalesce("max_daily", F.lit(0))
    )


def zero_percentile_excluded(rules: DataFrame) -> DataFrame:
    """Rules that select anything: a percentile of zero or less contributes nothing."""
    return rules.where(F.col("percentile") > 0)


def feed_membership(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every post once per feed that lists its community."""
    sized = size_rules(rules)
    members = sized.rows.select("feed", F.col("community").alias("community_name"))
    return posts.join(sized.hint(members), "community_name")


def feed_menu(*sources: DataFrame) -> DataFrame:
    """All sources' feeds (``source, feed, description``), sorted by feed name."""
    menu = sources[0]
    for other in sources[1:]:
        menu = menu.unionByName(other)
    return menu.orderBy("feed", "source")


def _violations(rows: DataFrame, checks: dict[str, Column], where: dict[str, Column]) -> DataFrame:
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), text) for text, broken in checks.items()])
    )
    return rows.select(
        *[col.alias(name) for name, col in where.items()], F.explode(found).alias("violation")
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _range_checks() -> dict[str, Column]:
    return {
        "percentile outside 0-100": (F.col("percentile") < 0) | (F.col("percentile") > 100),
        "daily cap negative": F.col("max_daily") < 0,
    }


def feed_rule_violations(rules: DataFrame) -> DataFrame:
    """One row per broken rule of community feeds.

    Expects the output of ``feed_rules_source`` (with or without defaults
    resolved). A feed's own rules are judged once, on its first row.
    """
    first = F.coalesce(F.col("community_no"), F.lit(1)) == 1
    member = F.col("community_no").isNotNull()
    checks = {
        "feed name blank": first & _blank("feed"),
        "feed name has other characters": first
        & ~_blank("feed")
        & ~F.col("feed").rlike(FEED_NAME_PATTERN),
        "feed description blank": first & _blank("description"),
        "media type unknown": first
        & ~F.coalesce(F.col("media"), F.lit("")).isin(*MEDIA_TYPES),
        "community blank": member & _blank("community"),
        **{text: member & broken for text, broken in _range_checks().items()},
    }
    where = {
        name: F.col(name) for name in ("document", "feed_no", "feed", "community_no", "community")
    }
    where["community_no"] = F.coalesce(where["community_no"], F.lit(0).cast("long"))
    where["community"] = F.coalesce(where["community"], F.lit(""))
    return _violations(rules, checks, where)


def account_rule_violations(rules: DataFrame) -> DataFrame:
    """One row per broken rule of account feeds; expects ``account_rules_source``."""
    first = F.coalesce(F.col("filter_no"), F.lit(1)) == 1
    member = F.col("filter_no").isNotNull()
    checks = {
        "feed name blank": first & _blank("feed"),
        "feed description blank": first & _blank("description"),
        "account blank": member & _blank("account"),
        "filter type unknown": member
        & ~F.coalesce(F.col("filter_type"), F.lit("")).isin(*FILTER_TYPES),
        **{text: member & broken for text, broken in _range_checks().items()},
    }
    where = {name: F.col(name) for name in ("document", "feed_no", "feed", "filter_no", "account")}
    where["filter_no"] = F.coalesce(where["filter_no"], F.lit(0).cast("long"))
    where["account"] = F.coalesce(where["account"], F.lit(""))
    return _violations(rules, checks, where)


def duplicate_feed_names(*sources: DataFrame) -> DataFrame:
    """Feed names used more than once over all sources (one row per feed in each)."""
    names = sources[0].select("feed")
    for other in sources[1:]:
        names = names.unionByName(other.select("feed"))
    return names.groupBy("feed").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") > 1)


def duplicate_communities(rules: DataFrame) -> DataFrame:
    """Communities listed more than once over all feeds (a warning, not an error)."""
    listed = rules.where(F.col("community").isNotNull())
    return (
        listed.groupBy("community")
        .agg(F.count(F.lit(1)).alias("uses"))
        .where(F.col("uses") > 1)
    )
