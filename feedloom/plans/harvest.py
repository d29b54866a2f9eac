"""Harvest: landed listing pages into the store, page by page until they run dry."""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.ingest import (
    NEW,
    label_rows,
    link_changes,
    link_holders,
    merged_rows,
    one_row_per_key,
    stored_matches,
)
from feedloom.schema import FIRST_SEEN, KEY, POST_COLUMNS
from feedloom.session import materialize, new_folder
from feedloom.sources.index import StoreIndex
from feedloom.sources.listings import drop_sticky, stamp_harvest_time

CONTINUE = "continue"


@dataclass(frozen=True)
class StopLimits:
    """When a harvest leaves a community; the defaults are fixed values.

    The page test is "more than", so page ``max_pages + 1`` is still ingested.
    """

    max_pages: int = 10
    min_rows: int = 10
    min_new_percent: float = 20.0


def percent_new(n_rows: Column, n_new: Column) -> Column:
    """Share of new rows in percent; 0 for a page without rows."""
    return F.coalesce(F.lit(100.0) * n_new / F.nullif(n_rows, F.lit(0)), F.lit(0.0))


def harvest_page_stats(rows: DataFrame, is_new: Column) -> DataFrame:
    """Per landed page: rows that are not pinned, how many are new, and percent new."""
    kept = ~F.col("is_sticky")
    return (
        rows.groupBy("community_name", "page_no")
        .agg(F.count_if(kept).alias("n_rows"), F.count_if(kept & is_new).alias("n_new"))
        .withColumn("percent_new", percent_new(F.col("n_rows"), F.col("n_new")))
    )


def stop_reason(limits: StopLimits) -> Column:
    """Why a harvest ends after this page, tested in this order; else ``continue``."""
    return (
        F.when(F.col("page_no") > limits.max_pages, "page limit")
        .when(F.col("n_rows") < limits.min_rows, "too few rows")
        .when(F.col("percent_new") < limits.min_new_percent, "too few new rows")
        .otherwise(CONTINUE)
    )


def harvest_stop_rule(stats: DataFrame, limits: StopLimits = StopLimits()) -> DataFrame:
    """The pages a harvest ingests: up to and with the first one that stops it.

    No page after ``max_pages + 1`` can be reached, so those are dropped first
    and each community's window is a handful of rows. Nor can one after a missing
    page: a community ends at its first gap, and one without page 1 has no pages.
    """
    reachable = stats.where(F.col("page_no") <= limits.max_pages + 1)
    flagged = reachable.withColumn("stop_reason", stop_reason(limits))
    in_order = Window.partitionBy("community_name").orderBy("page_no")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max(F.col("stop_reason") != CONTINUE).over(earlier)
    return (
        flagged.withColumns(
            {"stopped": F.coalesce(stopped, F.lit(False)), "nth": F.row_number().over(in_order)}
        )
        .where(~F.col("stopped") & (F.col("page_no") == F.col("nth")))
        .drop("stopped", "nth")
    )


@dataclass(frozen=True)
class Harvest:
    """``labelled``: every ingested row with ``page_no`` and ``store_result``;
    ``pages``: the ingested pages; ``changed``: rows to put into the store by key."""

    labelled: DataFrame
    pages: DataFrame
    changed: DataFrame

    def applied_to(self, store: DataFrame) -> DataFrame:
        """The store after the harvest."""
        rest = store.select(*POST_COLUMNS).join(self.changed.select(*KEY), KEY, "left_anti")
        return rest.unionByName(self.changed)


def harvest_run(
    store: DataFrame,
    landed: DataFrame,
    run_ts: int,
    rules: DataFrame | None = None,
    limits: StopLimits = StopLimits(),
    index: StoreIndex | None = None,
) -> Harvest:
    """Ingest landed pages (post columns, ``page_no``, ``pos``) of all communities.

    What a page adds decides whether the next is taken, and a link one community
    posts blocks it for the others, page by page and in order of community and position.

    Where no post is on two pages, this is worked out for all pages at once: rows are
    labelled as if every community went on as far as it could, which gives the
    pages where they stop, and again up to those, until nothing changes. What is
    found for the pages up to one depends on those alone, so a result that doesn't
    change is the page-by-page one; every pass settles one more page at least, and two
    or three mostly settle all. A post on several pages depends on its own earlier
    label too; then pages are taken in rounds, page k of every community still
    going in round k. There are at most ``max_pages + 1`` rounds. Passes and rounds
    only read stored tables, so plans do not grow.

    The store is read before them, for the rows that share a key or a link
    with the landed ones; given its ``index``, only that is read. A community ends at its
    first missing page; rows without a page number, or with one below 1, are refused.
    """
    folder = new_folder(store.sparkSession, "harvest")
    if rules is not None:
        harvested = rules.select(F.col("community").alias("community_name")).distinct()
        landed = landed.join(harvested, "community_name", "left_semi")
    landed = landed.where(F.coalesce("page_no", F.lit(0)) <= limits.max_pages + 1)
    rows = materialize(
        stamp_harvest_time(landed, run_ts).withColumns(
            {"chunk": F.col("community_name"), "seq": F.col("pos").cast("long")}
        ),
        f"{folder}/rows",
        partition_by="page_no",
    )
    if index:
        known = materialize(index.known(rows), f"{folder}/known")
        held = materialize(index.holders(rows), f"{folder}/held")
    else:
        known = materialize(stored_matches(store, rows), f"{folder}/known")
        held = link_holders(known)
    known = known.select(*KEY, "url", *FIRST_SEEN)
    sizes = harvest_page_stats(rows, F.lit(False)).select("community_name", "page_no", "n_rows")
    sizes = materialize(sizes, f"{folder}/sizes")
    if not sizes.where(F.coalesce("page_no", F.lit(0)) < 1).isEmpty():
        raise ValueError("landed pages are numbered from 1")

    pages_of = drop_sticky(rows).groupBy(*KEY).agg(F.min("page_no").alias("first"), F.max("page_no").alias("last"))
    label = _by_passes if pages_of.where("first <> last").isEmpty() else _by_rounds
    labelled = label(rows, known, held, sizes, limits, folder)

    pages = harvest_stop_rule(_page_stats(sizes, labelled, "left"), limits)
    last = F.max_by(F.struct(*[c for c in POST_COLUMNS if c not in KEY]), "page_no")
    stored = merged_rows(labelled, "page_no")
    changed = stored.groupBy(*KEY).agg(last.alias("v")).select(*KEY, "v.*")
    return Harvest(labelled, pages, changed.select(*POST_COLUMNS))


def _by_passes(
    rows: DataFrame, known: DataFrame, held: DataFrame, sizes: DataFrame, limits: StopLimits, folder: str
) -> DataFrame:
    """Labelled rows of the ingested pages, if no post is on two pages."""
    ordered = drop_sticky(rows).withColumn("chunk", F.struct("page_no", "community_name"))
    slim = ordered.select(*KEY, "url", "page_no", "community_name", "chunk", "seq")
    slim = materialize(slim, f"{folder}/slim")
    # At first, every row may be new.
    all_new = sizes.withColumn("n_new", F.col("n_rows"))
    last = _last_pages(all_new.withColumn("percent_new", percent_new(F.col("n_rows"), F.col("n_new"))), limits)
    last = materialize(last, f"{folder}/last-0")
    for n in range(1, limits.max_pages + 3):
        taken = one_row_per_key(_up_to(slim, last))
        labels = materialize(label_rows(taken, known, held), f"{folder}/pass-{n}")
        found = _last_pages(_page_stats(sizes, labels, "left"), limits)
        found = materialize(found, f"{folder}/last-{n}")
        if found.join(last, found.columns, "left_anti").isEmpty():
            break
        last = found
    decided = labels.select(*KEY, "store_result", *[c for c in labels.columns if c.startswith("stored_")])
    return materialize(one_row_per_key(_up_to(ordered, last)).join(decided, KEY), f"{folder}/labelled")


def _last_pages(stats: DataFrame, limits: StopLimits) -> DataFrame:
    """The last page each community goes to."""
    pages = harvest_stop_rule(stats, limits)
    return pages.groupBy("community_name").agg(F.max("page_no").alias("last_page"))


def _up_to(rows: DataFrame, last: DataFrame) -> DataFrame:
    return rows.join(last, "community_name").where("page_no <= last_page").select(*rows.columns)


def _by_rounds(
    rows: DataFrame, known: DataFrame, held: DataFrame, sizes: DataFrame, limits: StopLimits, folder: str
) -> DataFrame:
    """Labelled rows of the ingested pages, page by page."""
    going: DataFrame | None = None
    labelled: DataFrame | None = None
    for page_no in range(1, limits.max_pages + 2):
        page = drop_sticky(rows.where(F.col("page_no") == page_no))
        if going is not None:
            page = page.join(going, "community_name", "left_semi")
        holders = held
        if labelled is not None:
            holders = holders.unionByName(link_changes(labelled))
        batch = label_rows(one_row_per_key(page), _current(known, labelled), holders)
        labelled = _add_round(batch, f"{folder}/labelled", page_no)
        if page_no > limits.max_pages:
            break
        # A community whose page has no rows is not among these and so ends.
        this_round = labelled.where(F.col("page_no") == page_no)
        stats = _page_stats(sizes, this_round, "inner")
        going = stats.where(stop_reason(limits) == CONTINUE).select("community_name")
        going = materialize(going, f"{folder}/going-{page_no}")
        if going.isEmpty():
            break
    return labelled


def _add_round(batch: DataFrame, path: str, page_no: int) -> DataFrame:
    """Store a round's labelled rows; returns those of all rounds so far."""
    batch.drop("page_no").write.mode("overwrite").parquet(f"{path}/page_no={page_no}")
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def _current(known: DataFrame, labelled: DataFrame | None) -> DataFrame:
    """What the store holds under the harvest's keys after these rounds."""
    if labelled is None:
        return known
    stored = merged_rows(labelled, "page_no").select(*known.columns, "page_no")
    versions = known.withColumn("page_no", F.lit(0).cast("long")).unionByName(stored)
    values = ", ".join(c for c in known.columns if c not in KEY)
    newest = F.expr(f"max_by(struct({values}), page_no) as v")
    return versions.groupBy(*KEY).agg(newest).select(*KEY, "v.*")


def _page_stats(sizes: DataFrame, labelled: DataFrame, how: str) -> DataFrame:
    """``harvest_page_stats`` from page sizes and the labels of ingested rows."""
    new = labelled.groupBy("community_name", "page_no").agg(
        F.count_if(F.col("store_result") == NEW).alias("n_new")
    )
    stats = sizes.join(new, ["community_name", "page_no"], how)
    stats = stats.withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return stats.withColumn("percent_new", percent_new(F.col("n_rows"), F.col("n_new")))
