"""Page cursors of a listing that lands in several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from feedloom.session import materialize
from feedloom.sources import files
from feedloom.sources.listings import last_cursors, listing_normalize, page_cursor

_CURSORS = "community_name string, page_no long, cursor string"
_STATE = "community_name string, cursor string"


def cursor_state(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """community_name and cursor as the batch finds them: where finished earlier batches have ended."""
    earlier = [b for b in files.finished(spark, f"{root}/state", "batch_id") if b < batch_id]
    if not earlier:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).parquet(f"{root}/state/batch_id={earlier[-1]}")


def read_cursors(spark: SparkSession, root: str) -> DataFrame:
    """Cursors of all pages of all finished batches."""
    newest = max(files.finished(spark, f"{root}/state", "batch_id"), default=-1)
    done = [b for b in files.finished(spark, f"{root}/cursors", "batch_id") if b <= newest]
    paths = [f"{root}/cursors/batch_id={b}" for b in done]
    return spark.read.schema(_CURSORS).parquet(*paths) if paths else spark.createDataFrame([], _CURSORS)


def cursor_stream(listings: DataFrame, root: str, checkpoint: str, keep: int = 10) -> StreamingQuery:
    """Take what has landed and go on with each community's cursor where earlier batches left it.

    A batch stores its pages' cursors, and then where every community now ends, under its own
    number. One that is replayed starts from the batch before it and replaces both.
    All but the newest ``keep`` states are removed.
    """

    def follow(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = cursor_state(spark, root, batch_id)
        cursors = page_cursor(listing_normalize(batch), before)
        cursors = materialize(cursors, f"{root}/cursors/batch_id={batch_id}")
        materialize(last_cursors(cursors, before), f"{root}/state/batch_id={batch_id}")
        for old in files.numbers(spark, f"{root}/state", "batch_id")[:-keep]:
            files.remove(spark, f"{root}/state/batch_id={old}")

    writer = listings.writeStream.foreachBatch(follow).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
