"""The post store: Parquet snapshots partitioned by the date a post was stored.

Each version holds new files for the dates it changed, and a manifest that says
for every date which version's files are current. The manifest is written last,
so a version that did not finish is never read. A version is only written again by
who wrote it, and only while it is the newest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.timeops import stored_date
from feedloom.operators.ingest import ingest_classify, merged_rows
from feedloom.schema import KEY, POST_COLUMNS, POSTS
from feedloom.session import materialize, new_folder
from feedloom.sources import files
from feedloom.sources.index import create_index, expire_index, open_index

_MANIFEST = T.StructType(
    [
        T.StructField("stored_date", T.DateType()),
        T.StructField("data_version", T.LongType()),
        T.StructField("writer", T.StringType()),
        T.StructField("version", T.LongType()),
    ]
)
_STORED = T.StructType([*POSTS.fields, T.StructField("stored_date", T.DateType())])
_WITH_VERSION = T.StructType([*_STORED.fields, T.StructField("version", T.LongType())])


def posts_scan(
    posts: DataFrame, where: str, args: dict | None = None, order_by: str | None = None
) -> DataFrame:
    """Posts that meet an SQL predicate with named parameters, optionally ordered.

    ``posts_scan(posts, "score >= :least", {"least": 10}, "time_created")``
    """
    order = f" order by {order_by}" if order_by else ""
    columns = ", ".join(POST_COLUMNS)
    query = f"select {columns} from {{posts}} where {where}{order}"
    return posts.sparkSession.sql(query, args=args or {}, posts=posts)


def write_partitions(posts: DataFrame, path: str) -> None:
    """Write posts under ``stored_date=…`` folders.

    Rebalancing splits a day that holds most rows into several files and keeps
    small days from being scattered over many.
    """
    dated = posts.select(*POST_COLUMNS, stored_date(F.col("time_stored")).alias("stored_date"))
    spread = dated.hint("rebalance", "stored_date")
    spread.write.mode("overwrite").partitionBy("stored_date").parquet(path)


def posts_sink(
    posts: DataFrame, root: str, version: int | None = None, index_buckets: int | None = None
) -> None:
    """Store posts as a complete version, by default the one after the newest.

    With ``index_buckets`` the store gets an index (``sources.index``), which later
    versions keep up and merges look rows up in.
    """
    if version is None:
        version = (newest_version(posts.sparkSession, root) or 0) + 1
    refuse_overwrite(posts.sparkSession, root, version, "sink")
    write_partitions(posts, _data(root, version))
    spark = posts.sparkSession
    dates = spark.read.schema(_STORED).parquet(_data(root, version)).select("stored_date").distinct()
    dates = dates.withColumn("data_version", F.lit(version).cast("long"))
    if index_buckets:
        whole = spark.read.schema(_STORED).parquet(_data(root, version))
        create_index(whole, root, version, index_buckets)
    _commit(dates, root, version, "sink")


def read_posts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The store as of ``version`` (the newest by default), with ``stored_date``."""
    _must_exist(spark, root)
    wanted = newest_version(spark, root) if version is None else version
    if wanted is None:
        return spark.createDataFrame([], _STORED)
    if not files.exists(spark, f"{root}/manifest/version={wanted}/_SUCCESS"):
        raise ValueError(f"no version {version} in {root}")
    current = _manifests(spark, root, wanted).collect()  # one row per stored day
    folders = [f"{_data(root, r.data_version)}/stored_date={r.stored_date}" for r in current]
    if not folders:
        return spark.createDataFrame([], _STORED)
    reader = spark.read.schema(_WITH_VERSION).option("basePath", f"{root}/data")
    return reader.parquet(*folders).drop("version")


def posts_before(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The store as the writer of ``version`` finds it."""
    _must_exist(spark, root)
    before = version_before(spark, root, version)
    if before is None:
        return spark.createDataFrame([], _STORED)
    return read_posts(spark, root, before)


def merge_posts(
    spark: SparkSession, root: str, batch: DataFrame, version: int, writer: str | None = None
) -> DataFrame:
    """Upsert a batch into the store as ``version``; returns the labelled batch.

    Rows are looked up in the store's index if it has one, else in its posts. Only the days that hold an updated row or get a new one are rewritten. A replay
    by the same ``writer`` replaces the version it wrote before.
    """
    refuse_overwrite(spark, root, version, writer)
    store = posts_before(spark, root, version)
    index = open_index(spark, root, version_before(spark, root, version))
    labelled = index.classify(batch) if index else ingest_classify(store, batch)
    labelled = materialize(labelled, new_folder(spark, "ingest"))
    changed = merged_rows(labelled)
    store_changed(spark, store, changed, root, version, writer)
    return labelled


def store_changed(
    spark: SparkSession,
    store: DataFrame,
    changed: DataFrame,
    root: str,
    version: int,
    writer: str | None = None,
    oldest: int | None = None,
) -> None:
    """Write ``version`` = store with ``changed`` rows put in by key, and its index if there is one.

    The index may forget the scores of posts first stored before ``oldest``.
    """
    refuse_overwrite(spark, root, version, writer)
    touched = [
        row[0] for row in changed.select(stored_date(F.col("time_stored"))).distinct().collect()
    ]  # days, so few
    rest = store.where(F.col("stored_date").isin(touched)).select(*POST_COLUMNS)
    rest = rest.join(changed.select(*KEY), KEY, "left_anti")
    write_partitions(rest.unionByName(changed), _data(root, version))
    last = version_before(spark, root, version)
    index = open_index(spark, root, last)
    if index:
        index.extended(changed, version, oldest)
    changed.select("community_name").distinct().write.mode("overwrite").parquet(f"{root}/changes/version={version}")
    new = spark.createDataFrame([(day, version) for day in touched], "stored_date date, data_version long")
    if last is not None:
        old = _manifests(spark, root, last).select("stored_date", "data_version")
        new = old.where(~F.col("stored_date").isin(touched)).unionByName(new)
    _commit(new, root, version, writer)


def changed_communities(spark: SparkSession, root: str, since: int, until: int) -> DataFrame:
    """community_name of the posts that versions after ``since`` up to ``until`` have put in."""
    parts = [v for v in files.numbers(spark, f"{root}/changes", "version") if since < v <= until]
    if not parts:
        return spark.createDataFrame([], "community_name string")
    paths = [f"{root}/changes/version={v}" for v in parts]
    return spark.read.schema("community_name string").parquet(*paths).distinct()


def expire_versions(spark: SparkSession, root: str, keep: int) -> None:
    """Remove all but the newest ``keep`` versions, and the files that only others read.

    Manifests go first, so nothing that is still named is missing its files; a job that
    reads an older version must be done by then. If this is cut off, the next call removes
    the rest. What a harvest's ledger says of the versions goes with them.
    """
    every = files.finished(spark, f"{root}/manifest", "version")
    kept = set(every[-max(keep, 1) :])
    if not kept:
        return
    for version in files.numbers(spark, f"{root}/manifest", "version"):
        if version < min(kept):
            files.remove(spark, f"{root}/manifest/version={version}")
    named = _manifests(spark, root).select("data_version", "stored_date").distinct().collect()  # days
    reached = {(r.data_version, f"stored_date={r.stored_date}") for r in named}
    for version in files.numbers(spark, f"{root}/data", "version"):
        if version >= min(kept) and version not in kept:
            continue  # being written
        folder = _data(root, version)
        days = [n for n in files.names(spark, folder) if n.startswith("stored_date=")]
        gone = [day for day in days if (version, day) not in reached]
        if len(gone) == len(days) and version not in kept:
            files.remove(spark, folder)
        else:
            for day in gone:
                files.remove(spark, f"{folder}/{day}")
    for name in ("changes", "ledger"):
        for version in files.numbers(spark, f"{root}/{name}", "version"):
            if version < min(kept):
                files.remove(spark, f"{root}/{name}/version={version}")
    expire_index(spark, root, min(kept))


def _data(root: str, version: int) -> str:
    return f"{root}/data/version={version}"


def _must_exist(spark: SparkSession, root: str) -> None:
    if not files.exists(spark, f"{root}/manifest"):
        raise ValueError(f"no store in {root}")


def oldest_version(spark: SparkSession, root: str) -> int | None:
    """The oldest version that is kept."""
    return next(iter(files.finished(spark, f"{root}/manifest", "version")), None)


def newest_version(spark: SparkSession, root: str) -> int | None:
    """The newest version of the store; None if there is none."""
    return next(reversed(files.finished(spark, f"{root}/manifest", "version")), None)


def next_version(spark: SparkSession, root: str, writer: str) -> int:
    """The version that ``writer`` has written before, else the one after the newest."""
    newest = newest_version(spark, root)
    if newest is None:
        return 1
    own = _manifests(spark, root).where(F.col("writer") == writer).agg(F.max("version")).first()[0]
    return own or newest + 1


def refuse_overwrite(spark: SparkSession, root: str, version: int, writer: str | None) -> None:
    """Raise if writing ``version`` would replace files that the store may still read."""
    newest = newest_version(spark, root)
    if newest is None:
        return
    named = (F.col("data_version") == version) & (F.col("version") != version)
    others = (F.col("version") == version) & ~F.col("writer").eqNullSafe(F.lit(writer))
    if version < newest or not _manifests(spark, root).where(named | others).isEmpty():
        raise ValueError(f"version {version} of {root} is in use; the newest is {newest}")


def _commit(manifest: DataFrame, root: str, version: int, writer: str | None) -> None:
    manifest = manifest.withColumn("writer", F.lit(writer).cast("string"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def _manifests(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The days of all versions that are kept, or of one."""
    reader = spark.read.schema(_MANIFEST).option("basePath", f"{root}/manifest")
    return reader.parquet(f"{root}/manifest" + ("" if version is None else f"/version={version}"))


def version_before(spark: SparkSession, root: str, version: int) -> int | None:
    """The newest version below ``version``; None if there is none."""
    older = [v for v in files.finished(spark, f"{root}/manifest", "version") if v < version]
    return older[-1] if older else None
