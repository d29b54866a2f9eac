"""The recurring harvest as a stream over landed listing files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.ingest import (
    NEW,
    SKIPPED,
    UPDATED,
    ingest_classify,
    merged_rows,
    one_row_per_key,
)
from feedloom.operators.status import ERROR, HARVESTING, IDLE, log_status
from feedloom.plans.harvest import harvest_run
from feedloom.session import materialize, new_folder
from feedloom.sources.index import open_index
from feedloom.sources.listings import (
    drop_sticky,
    listing_normalize,
    listing_reject_reason,
    listing_rejects,
    stamp_harvest_time,
)
from feedloom.sources.posts import (
    expire_versions,
    newest_version,
    next_version,
    posts_before,
    refuse_overwrite,
    store_changed,
    version_before,
)

# Fixed value.
HARVEST_INTERVAL = "360 minutes"

NO_POSTS, UNPLACED = "no row can be a post", "a row without a place"

_LEDGER = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("community_name", "status", "reason")),
        *(
            T.StructField(c, T.LongType())
            for c in ("n_landed", "n_rejected", "n_new", "n_updated", "n_skipped", "last_page", "ts", "version")
        ),
    ]
)


def place_rows(rows: DataFrame) -> DataFrame:
    """Order a batch by page, community and position."""
    return rows.withColumns(
        {"chunk": F.struct("page_no", "community_name"), "seq": F.col("pos").cast("long")}
    )


def community_outcomes(batch: DataFrame) -> DataFrame:
    """community_name, n_landed, n_rejected and ``reason`` of the landed rows of each community.

    A community is broken, with a reason, if one of its rows has no place (a page from 1 on
    and a position) or none of them can be a post. Lines that name no community are
    nobody's.
    """
    refused = listing_reject_reason(batch).isNotNull()
    unplaced = (F.coalesce("page_no", F.lit(0)) < 1) | F.col("pos").isNull()
    named = batch.select(F.lower("community").alias("community_name"), refused.alias("refused"), unplaced.alias("unplaced"))
    counts = named.where("community_name is not null").groupBy("community_name").agg(
        F.count(F.lit(1)).alias("n_landed"),
        F.count_if("refused").alias("n_rejected"),
        F.count_if(F.col("unplaced") & ~F.col("refused")).alias("n_unplaced"),
    )
    reason = F.when(F.col("n_rejected") == F.col("n_landed"), NO_POSTS).when(F.col("n_unplaced") > 0, UNPLACED)
    return counts.select("community_name", "n_landed", "n_rejected", reason.alias("reason"))


def _write_ledger(outcomes: DataFrame, labelled: DataFrame, root: str, version: int, ts: int) -> None:
    count = lambda result: F.count_if(F.col("store_result") == result)
    done = labelled.groupBy("community_name").agg(
        count(NEW).alias("n_new"), count(UPDATED).alias("n_updated"), count(SKIPPED).alias("n_skipped"),
        F.max("page_no").alias("last_page"),
    )
    rows = outcomes.join(done, "community_name", "left").withColumns(
        {
            "status": F.when(F.col("reason").isNull(), IDLE).otherwise(ERROR),
            "ts": F.lit(ts).cast("long"),
        }
    )
    rows.select(*_LEDGER.fieldNames()[:-1]).write.mode("overwrite").parquet(f"{root}/ledger/version={version}")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """What became of each community in each harvest that made a version which is kept."""
    rows = spark.read.schema(_LEDGER).parquet(f"{root}/ledger")
    return rows.where(F.col("version") <= (newest_version(spark, root) or 0))


def harvest_stream(
    listings: DataFrame,
    root: str,
    checkpoint: str,
    run_ts: Callable[[int], int],
    rules: DataFrame | None = None,
    log: str | None = None,
    stop_rule: bool = False,
    once: bool = False,
    rejects: str | None = None,
    keep_versions: int | None = None,
) -> StreamingQuery:
    """Upsert newly landed listing files into the post store at ``root``.

    A micro-batch becomes the version after the newest, under its checkpoint's name and
    number, so a batch that is replayed after a failure replaces its own result. ``run_ts`` gives the harvest time of a
    batch and must give a replayed batch the same time. If the store has an index, rows
    are looked up there.

    With ``stop_rule`` each batch is a harvest whose listings are followed only
    as deep as they pay; otherwise all landed rows are ingested. A community whose listing
    is broken (see ``community_outcomes``) is left out of the batch alone. What became of
    each community is written with the version (``read_ledger``). ``rules`` limits
    the harvest to the communities of feeds, whose status is then noted in ``log``: a
    feed with a broken community is in error, and so are all feeds of a
    batch that fails, until its replay. ``once`` takes what
    has landed and ends. With ``keep_versions`` older versions of the store expire after each
    batch. Rows that can't be posts are left out, and stored in a
    folder per batch under ``rejects`` if that is given.
    """

    def note(batch_id: int, feeds: DataFrame | None, status: str) -> None:
        if feeds is not None and log:
            entry_no = 2 * batch_id + (status != HARVESTING)
            log_status(feeds, log, run_ts(batch_id), entry_no, status)

    def ingest(batch: DataFrame, batch_id: int) -> DataFrame:
        """Take the batch in; returns the broken communities."""
        spark = batch.sparkSession
        writer = f"{checkpoint}#{batch_id}"
        version = next_version(spark, root, writer)
        refuse_overwrite(spark, root, version, writer)
        if rejects:
            listing_rejects(batch).write.mode("overwrite").json(f"{rejects}/batch_id={batch_id}")
        if rules is not None:
            wanted = rules.select(F.col("community").alias("wanted")).distinct()
            batch = batch.join(wanted, F.lower("community") == F.col("wanted"), "left_semi")
        outcomes = materialize(community_outcomes(batch), new_folder(spark, "outcomes"))
        broken = outcomes.where("reason is not null").select("community_name")
        posts = listing_normalize(batch).join(broken, "community_name", "left_anti")
        store = posts_before(spark, root, version)
        index = open_index(spark, root, version_before(spark, root, version))
        if stop_rule:
            result = harvest_run(store, posts, run_ts(batch_id), index=index)
            labelled = result.labelled
            changed = materialize(result.changed, new_folder(spark, "changed"))
        else:
            rows = place_rows(stamp_harvest_time(drop_sticky(posts), run_ts(batch_id)))
            rows = materialize(one_row_per_key(rows), new_folder(spark, "batch"))
            labelled = index.classify(rows) if index else ingest_classify(store, rows)
            labelled = materialize(labelled, new_folder(spark, "ingest"))
            changed = merged_rows(labelled)
        _write_ledger(outcomes, labelled, root, version, run_ts(batch_id))
        store_changed(spark, store, changed, root, version, writer)
        if keep_versions:
            expire_versions(spark, root, keep_versions)
        return broken

    def harvest(batch: DataFrame, batch_id: int) -> None:
        note(batch_id, rules, HARVESTING)
        try:
            broken = ingest(batch, batch_id)
        except Exception:
            note(batch_id, rules, ERROR)
            raise
        if rules is not None:
            hit = rules.join(broken, F.col("community") == F.col("community_name"), "left_semi")
            feeds = rules.select("feed").distinct()
            note(batch_id, feeds.join(hit.select("feed").distinct(), "feed", "left_anti"), IDLE)
            note(batch_id, hit, ERROR)

    writer = listings.writeStream.foreachBatch(harvest).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=HARVEST_INTERVAL).start()
