"""Running totals over groups too large for one task.

A plain window sorts a whole group in one task. Here a group is cut into
ordered chunks: chunk totals are pre-aggregated on the map side, a window over
those few totals carries them forward, and the rest is a window inside each
chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import materialize, new_folder


def carry_in(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    per_chunk: Column,
    over_chunks: Callable[[Column], Column],
    name: str,
) -> DataFrame:
    """Add ``name``: an aggregate of all earlier chunks of the row's group.

    ``per_chunk`` aggregates one chunk, ``over_chunks`` combines those results.
    Rows with a null chunk come before all others, feed the totals and are not
    returned.
    """
    totals = df.groupBy(*keys, chunk).agg(per_chunk.alias(name))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn(name, over_chunks(F.col(name)).over(earlier))
    return df.join(carried, [*keys, chunk])


def row_numbers(
    df: DataFrame, keys: list[str], chunk: str, order: list[Column], name: str
) -> DataFrame:
    """Add ``name``: the row's number in its group by ``chunk``, then ``order``."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    before = carry_in(df, keys, chunk, F.count(F.lit(1)), F.sum, name)
    return before.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.row_number().over(inside))


def numbers_in_order(df: DataFrame, key: str, order: list[Column | str], name: str) -> DataFrame:
    """Add ``name``: the row's number in its group by ``order``, whatever the group's size.

    Rows are dealt out by ranges of group and order, whose bounds Spark takes from a sample
    of them, so a large group or many equal first columns are many tasks. A row's number is
    its place in its range plus the rows of its group in ranges before.
    """
    spark = df.sparkSession
    columns = [F.col(key), *order]
    df = materialize(df, new_folder(spark, "to-number"))  # the sample is a look of its own
    sorted_ranges = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    at = F.monotonically_increasing_id()  # the task above, the row below 33 bits
    parts = {"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}
    placed = materialize(sorted_ranges.withColumns(parts), new_folder(spark, "ranges"))
    sizes = placed.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("head"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("head") + 1
    shifts = materialize(sizes.select(key, "_range", shift.alias("_shift")), new_folder(spark, "shifts"))
    numbered = placed.join(shifts, [key, "_range"]).withColumn(name, F.col("_at") + F.col("_shift"))
    return numbered.select(*df.columns, name)
