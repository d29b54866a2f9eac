"""Names in folders of whatever store holds the tables, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _path(spark, path)
    return files.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if it is not there."""
    files, place = _path(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def numbers(spark: SparkSession, folder: str, column: str) -> list[int]:
    """The values of a partition column that has whole numbers, in order."""
    mark = f"{column}="
    return sorted(int(n.removeprefix(mark)) for n in names(spark, folder) if n.startswith(mark))


def finished(spark: SparkSession, folder: str, column: str) -> list[int]:
    """Those of ``numbers`` whose folder a finished job has written."""
    return [n for n in numbers(spark, folder, column) if exists(spark, f"{folder}/{column}={n}/_SUCCESS")]


def remove(spark: SparkSession, path: str) -> None:
    files, place = _path(spark, path)
    files.delete(place, True)
