"""Top rows per group, without gathering a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.schema import KEY

SALTS = 64


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: Column, bound: int, rank: str
) -> DataFrame:
    """Keep the first ``limit`` rows of each group by ``order``, numbered in ``rank``.

    ``limit`` may vary from group to group; ``bound`` is a number no limit
    exceeds. Stating it as a literal lets Spark drop rows beyond it before the
    shuffle. Spark does so only up to a configured bound; above that, each group
    is first cut down in salted parts, which spreads a hot group over tasks.
    """
    spark = df.sparkSession
    early = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if bound > early:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= bound)
        df = df.drop(rank, "_salt")
    group = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(group)).where(F.col(rank) <= bound)
    return ranked.where(F.col(rank) <= limit)
