"""Keyed upsert of posts with URL dedup, as set operations.

Row by row the rule is: a known key is updated; otherwise a non-blank URL that
some stored post already holds makes the row a skip; otherwise it is new. Rows
of the same batch count as stored once they are, so order matters. A batch row
carries its place as ``chunk`` (any orderable type) and ``seq`` (a long): rows
are ordered by chunk, then seq, and a chunk is small enough for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.schema import FIRST_SEEN, KEY, POST_COLUMNS
from feedloom.session import materialize, new_folder

NEW, UPDATED, SKIPPED = "NEW", "UPDATED", "SKIPPED"
CHUNK_ROWS = 65_536


def by_sequence(batch: DataFrame, seq: str) -> DataFrame:
    """Place rows by a sequence number that counts through the batch."""
    seq_no = F.col(seq).cast("long")
    size = F.lit(CHUNK_ROWS).cast("long")
    return batch.withColumn("chunk", F.call_function("div", seq_no, size)).withColumn("seq", seq_no)


def one_row_per_key(batch: DataFrame) -> DataFrame:
    """Fold repeats of a key: last row's values at the first row's place.

    Rows are folded on the map side first, so a key repeated very often costs
    no more than others.
    """
    place = F.struct("chunk", "seq")
    values = [c for c in batch.columns if c not in [*KEY, "chunk", "seq"]]
    return (
        batch.groupBy(*KEY)
        .agg(F.max_by(F.struct(*values), place).alias("v"), F.min(place).alias("p"))
        .select(*KEY, "v.*", "p.*")
    )


# A null URL fails this test as a blank one does, and Parquet readers can apply it.
LINKED = "url <> ''"


def known_by_key(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Batch rows whose key is stored."""
    return batch.join(store.select(*KEY), KEY, "left_semi")


def unknown_by_key(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Batch rows whose key is not stored."""
    return batch.join(store.select(*KEY), KEY, "left_anti")


def known_by_url(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Batch rows whose URL some stored post holds; a blank URL is never looked up.

    Both sides leave out blank URLs first, or linkless posts would all meet in
    one task.
    """
    held = store.where(LINKED).select("url").distinct()
    return batch.where(LINKED).join(held, "url", "left_semi")


def stored_matches(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows that share a key or a link with the batch: all that ingest looks up.

    In the semi joins a small batch is the broadcast side and the store is not
    shuffled; with a large one Spark may split links that most posts share.
    """
    slim = store.select(*KEY, "url", *FIRST_SEEN)
    by_key = slim.join(batch.select(*KEY), KEY, "left_semi")
    links = batch.where(LINKED).select("url").distinct()
    by_link = slim.where(LINKED).join(links, "url", "left_semi").select(by_key.columns)
    return by_key.unionByName(by_link).dropDuplicates(KEY)


def ingest_classify(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with ``store_result``, plus what is stored under their key.

    ``stored_url`` and the ``stored_…`` first-seen columns are null for rows
    whose key is not stored. Every key may occur once; see ``one_row_per_key``.

    The matching part of the store is kept as a table, so that the several looks
    at it do not each read the store.
    """
    found = materialize(stored_matches(store, batch), new_folder(store.sparkSession, "found"))
    return label_rows(batch, found, link_holders(found))


def link_holders(stored: DataFrame) -> DataFrame:
    """Stored rows as holders of their links."""
    return stored.where(LINKED).selectExpr("url", "1L as change")


def link_changes(labelled: DataFrame) -> DataFrame:
    """How labelled rows, once stored, change the number of holders of links."""
    changes = labelled.selectExpr(
        """inline(case store_result
          when 'NEW' then array(struct(url as url, 1L as change))
          when 'UPDATED' then array(struct(url as url, 1L as change),
                                    struct(stored_url as url, -1L as change))
        end)"""
    )
    return changes.where(LINKED)


def label_rows(batch: DataFrame, known: DataFrame, holders: DataFrame) -> DataFrame:
    """``ingest_classify`` given what the store says.

    ``known`` has the stored rows under the batch's keys. ``holders`` has rows
    of ``url`` and ``change``, which add up to the number of stored posts with
    the link, for the links of the batch. Both may have more.
    """
    stored = known.selectExpr(
        *KEY, "coalesce(url, '') as stored_url", *[f"{c} as stored_{c}" for c in FIRST_SEEN]
    )
    rows = batch.join(stored, KEY, "left")
    winners = _first_free_candidates(rows, holders)
    result = F.expr(
        f"""case when stored_url is not null then '{UPDATED}'
          when coalesce(url, '') = '' or _wins then '{NEW}' else '{SKIPPED}' end"""
    )
    return rows.join(winners, KEY, "left").withColumn("store_result", result).drop("_wins")


def _first_free_candidates(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """Keys of rows that insert their URL: per URL the first not-yet-stored row at
    whose turn no stored post holds it.

    Each URL's holders are counted over the batch: stored posts before it
    starts, minus one where an update drops the URL, plus one where an update
    takes it. A count, because updates may give several posts the same URL.
    Rows after the first insert find the URL held by it, so there is one per URL.

    A URL that most rows share is no single task: the running count is taken
    inside each chunk first, where of the candidates that see the same count
    only the first matters. What is left per URL is a few rows per chunk, and
    the counts of earlier chunks are added to those.
    """
    in_batch = rows.selectExpr(
        *KEY,
        "chunk",
        "seq",
        """inline(case
          when stored_url is null
            then array(struct(coalesce(url, '') as url, 0L as change, true as candidate))
          when stored_url <> coalesce(url, '')
            then array(struct(coalesce(url, '') as url, 1L as change, false as candidate),
                       struct(stored_url as url, -1L as change, false as candidate))
        end)""",
    )
    at_start = holders.groupBy("url").agg(F.sum("change").alias("change"))
    # Holders at the start have no chunk and so precede every chunk.
    timeline = in_batch.where(LINKED).unionByName(
        at_start.withColumn("candidate", F.lit(False)), allowMissingColumns=True
    )
    in_chunk = "partition by url, chunk order by seq"
    counted = timeline.selectExpr(
        "*",
        f"""case when candidate then coalesce(sum(change) over
          ({in_chunk} rows between unbounded preceding and 1 preceding), 0) end as seen""",
        f"""sum(change) over
          ({in_chunk} rows between unbounded preceding and unbounded following) as chunk_change""",
        f"row_number() over ({in_chunk}) = 1 as head",
    )
    firsts = counted.groupBy("url", "chunk", "seen").agg(
        F.expr(f"min(case when candidate then struct(seq, {', '.join(KEY)}) end) as first"),
        F.expr("max(chunk_change) as chunk_change"),
        # The chunk's change once over all its rows.
        F.expr("sum(case when head then chunk_change else 0 end) as step"),
    )
    held = """sum(step) over (partition by url order by chunk
      range between unbounded preceding and current row) - chunk_change + seen as held"""
    return (
        firsts.selectExpr("*", held)
        .where("held = 0")
        .groupBy("url")
        .agg(F.expr("min(struct(chunk, first)) as win"))
        .selectExpr(*[f"win.first.{k} as {k}" for k in KEY], "true as _wins")
    )


def merged_rows(labelled: DataFrame, *more: str) -> DataFrame:
    """Post rows as stored after the batch: first-seen columns keep their stored values.

    ``more`` names further columns to pass through.
    """
    kept = {c: f"coalesce(stored_{c}, {c}) as {c}" for c in FIRST_SEEN}
    return labelled.where(f"store_result <> '{SKIPPED}'").selectExpr(
        *[kept.get(c, c) for c in [*POST_COLUMNS, *more]]
    )


def ingest_merge(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after the batch.

    Rows whose key is in the batch are exactly those updated, so the rest of the
    store passes through an anti join on keys.
    """
    untouched = store.select(*POST_COLUMNS).join(batch.select(*KEY), KEY, "left_anti")
    return untouched.unionByName(merged_rows(ingest_classify(store, batch)))
