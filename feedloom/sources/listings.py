"""Landed listing pages: reading, normalizing and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.operators.prefix import carry_in
from feedloom.schema import CORRUPT, POST_COLUMNS, READ_LISTING, REQUIRED_IN_LISTING
from feedloom.session import materialize, new_folder

PAGES_PER_CHUNK = 1_000


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON listing rows, with the schema given rather than inferred.

    A line that is no such row keeps its text in ``_corrupt_record``.
    """
    return spark.read.schema(READ_LISTING).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_listings(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of newly landed files."""
    reader = spark.readStream.schema(READ_LISTING)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def listing_reject_reason(raw: DataFrame) -> Column:
    """Why a listing row can't be a post; null if it can."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in REQUIRED_IN_LISTING]
    if CORRUPT in raw.columns:
        reasons.insert(0, F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")))
    return F.coalesce(*reasons)


def listing_rejects(raw: DataFrame) -> DataFrame:
    """Listing rows that ``listing_normalize`` leaves out, with the ``reason``.

    Lines that are no listing row, and rows without a value a post must have; of
    several reasons the first, in the order of the columns of a listing.
    """
    return raw.withColumn("reason", listing_reject_reason(raw)).where(F.col("reason").isNotNull())


def listing_normalize(raw: DataFrame) -> DataFrame:
    """Listing rows in the post schema; paging columns pass through.

    ``time_stored`` starts as the creation time, until a harvest stamps it. Rows
    of ``listing_rejects`` are no posts, so no page counts them.
    """
    posts = raw.where(listing_reject_reason(raw).isNull()).withColumns(
        {
            "community_name": F.lower("community"),
            "time_created": F.col("created_utc").cast("long"),
            "time_stored": F.col("created_utc").cast("long"),
            "is_active": ~F.coalesce("deleted", F.lit(False)),
            "is_sticky": F.coalesce("stickied", F.lit(False)),
            "url": F.coalesce("url", F.lit("")),
        }
    )
    paging = [c for c in ("page_no", "pos") if c in raw.columns]
    return posts.select(*POST_COLUMNS, *paging)


def drop_sticky(rows: DataFrame) -> DataFrame:
    """Leave out pinned rows, before anything counts them."""
    return rows.where(~F.col("is_sticky"))


def stamp_harvest_time(rows: DataFrame, run_ts: int) -> DataFrame:
    """One harvest time for all rows of a run."""
    return rows.withColumn("time_stored", F.lit(run_ts).cast("long"))


def page_cursor(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Per page, the cursor of the next one: the name of the last row not pinned.

    A page of pinned rows only leaves the cursor as it was; before any other
    row it is that of ``before`` (community_name, cursor), where earlier pages
    ended, or blank. Pages are stored before cursors are carried over them, as
    that takes two looks at them.
    """
    pages = rows.groupBy("community_name", "page_no").agg(
        F.max_by("name", F.when(~F.col("is_sticky"), F.col("pos"))).alias("own")
    )
    pages = materialize(pages, new_folder(rows.sparkSession, "pages")).withColumn(
        "chunk", F.call_function("div", F.col("page_no"), F.lit(PAGES_PER_CHUNK).cast("long"))
    )
    latest = F.max_by("own", F.when(F.col("own").isNotNull(), F.col("page_no")))
    carried = carry_in(
        pages, ["community_name"], "chunk", latest, lambda c: F.last(c, ignorenulls=True), "carried"
    )
    start = F.lit("")
    if before is not None:
        ended = before.select("community_name", F.col("cursor").alias("start"))
        carried, start = carried.join(ended, "community_name", "left"), F.coalesce("start", F.lit(""))
    so_far = Window.partitionBy("community_name", "chunk").orderBy("page_no")
    cursor = F.coalesce(F.last("own", ignorenulls=True).over(so_far), "carried", start)
    return carried.select("community_name", "page_no", cursor.alias("cursor"))


def last_cursors(cursors: DataFrame, before: DataFrame) -> DataFrame:
    """Where each community's pages end: the cursor of its last page here, else that of ``before``."""
    here = cursors.groupBy("community_name").agg(F.max_by("cursor", "page_no").alias("cursor"))
    return here.unionByName(before.join(here, "community_name", "left_anti").select(here.columns))
