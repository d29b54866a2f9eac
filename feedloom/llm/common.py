"""What the operators of this package share: tables, batches, fixed-seed mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.session import materialize, new_folder

#: Rows in an Arrow batch. Texts are long, so the default of 10,000 rows is too much
#: for a Python worker; inside a batch texts are worked on in chunks of CHUNK_BYTES.
BATCH_ROWS = 500
CHUNK_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small enough for a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there."""
    return materialize(df, new_folder(df.sparkSession, label), compression=compression)
