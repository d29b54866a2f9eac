"""Named post sources: how another site is added.

A source is a function from a session and options to a DataFrame in the post
schema (paging columns ``page_no`` and ``pos`` may follow).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.schema import POST_COLUMNS
from feedloom.sources.listings import listing_normalize, read_listings

PostSource = Callable[..., DataFrame]
_sources: dict[str, PostSource] = {}


def register_source(name: str, source: PostSource) -> None:
    _sources[name] = source


def source_names() -> list[str]:
    return sorted(_sources)


def load_posts(spark: SparkSession, name: str, **options) -> DataFrame:
    """Posts of a registered source, checked to have every post column."""
    posts = _sources[name](spark, **options)
    missing = [c for c in POST_COLUMNS if c not in posts.columns]
    if missing:
        raise ValueError(f"source {name} lacks columns {missing}")
    return posts


register_source("listing", lambda spark, path: listing_normalize(read_listings(spark, path)))
