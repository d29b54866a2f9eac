"""Index of the post store: what a merge looks up, without reading posts.

Three slim tables go with a store. ``keys`` has what is stored under each key, in
buckets by a hash of the key. ``links`` counts the posts that hold each link, in
buckets by a hash of the link, so a link that most posts share is one row. ``scores``
counts active posts by community, second stored and score, in folders by date.

A merge adds a part to each table: the keys it changed with their new values, and the
changes of counts, with -1 for what an updated post had before. A reader takes the newest
row of a key and the sum of a count's changes. After ``MAX_PARTS`` parts, a merge writes
whole tables anew instead, as one part. A manifest names the parts of each version; it is
written before the store's own, so a version of the store that can be read has its index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.timeops import stored_date
from feedloom.operators.ingest import LINKED, label_rows
from feedloom.schema import FIRST_SEEN, KEY, POSTS
from feedloom.session import materialize, new_folder
from feedloom.sources import files

#: Buckets of a new index, and parts before tables are written anew.
BUCKETS = 64
MAX_PARTS = 8

# What the index knows of a post.
VALUES = ["url", *FIRST_SEEN, "score", "is_active"]
_PART = T.StructField("version", T.LongType())
_BUCKET = T.StructField("bucket", T.IntegerType())
_KEYS = T.StructType([*(POSTS[c] for c in [*KEY, *VALUES]), _PART, _BUCKET])
_LINKS = T.StructType([POSTS["url"], T.StructField("change", T.LongType()), _PART, _BUCKET])
_SCORES = T.StructType(
    [
        *(POSTS[c] for c in ("community_name", "time_stored", "score")),
        T.StructField("change", T.LongType()),
        _PART,
        T.StructField("stored_date", T.DateType()),
    ]
)
_MANIFEST = "part long, buckets int"


def _bucket(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def indexed(posts: DataFrame) -> DataFrame:
    """The columns that the index keeps of posts."""
    return posts.select(*KEY, *VALUES)


@dataclass(frozen=True)
class StoreIndex:
    """The index of one version of the store at ``root``: its parts, oldest first."""

    spark: SparkSession
    root: str
    buckets: int
    parts: tuple[int, ...]

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        folder = f"{self.root}/index/{name}"
        paths = [f"{folder}/version={part}" for part in self.parts]
        reader = self.spark.read.schema(schema).option("basePath", folder)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _in_buckets(self, name: str, schema: T.StructType, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The table's rows under the keys of ``rows``; only their buckets' folders are read."""
        wanted = rows.select(*keys).distinct()
        hit = wanted.select(_bucket(keys, self.buckets).alias("bucket")).distinct()
        hit = [r["bucket"] for r in hit.collect()]  # as many as there are buckets at most
        table = self._table(name, schema).where(F.col("bucket").isin(hit))
        return table.join(wanted, keys, "left_semi")

    def known(self, batch: DataFrame) -> DataFrame:
        """What is stored under the keys of ``batch``: key and ``VALUES``."""
        return _newest(self._in_buckets("keys", _KEYS, batch, KEY))

    def holders(self, batch: DataFrame) -> DataFrame:
        """Numbers of stored posts with the links of ``batch``: url and change."""
        return _summed(self._in_buckets("links", _LINKS, batch.where(LINKED), ["url"]), ["url"])

    def known_by_key(self, batch: DataFrame) -> DataFrame:
        """``operators.ingest.known_by_key`` by the index."""
        return batch.join(self.known(batch).select(*KEY), KEY, "left_semi")

    def known_by_url(self, batch: DataFrame) -> DataFrame:
        """``operators.ingest.known_by_url`` by the index."""
        return batch.where(LINKED).join(self.holders(batch).select("url"), "url", "left_semi")

    def classify(self, batch: DataFrame) -> DataFrame:
        """``operators.ingest.ingest_classify`` by the index: no post is read."""
        found = materialize(self.known(batch), new_folder(self.spark, "known"))
        return label_rows(batch, found, self.holders(batch))

    def score_counts(self, since: int) -> DataFrame:
        """community, score and n: active posts first stored at or after ``since``."""
        oldest = F.lit(since).cast("long")
        recent = self._table("scores", _SCORES).where(
            (F.col("stored_date") >= stored_date(oldest)) & (F.col("time_stored") >= oldest)
        )
        counts = recent.groupBy(F.col("community_name").alias("community"), "score")
        return counts.agg(F.sum("change").alias("n")).where("n <> 0")

    def communities_between(self, first: int, end: int) -> DataFrame:
        """community_name of active posts first stored from ``first`` on and before ``end``."""
        found = self._table("scores", _SCORES).where(F.col("time_stored").between(first, end - 1))
        counts = found.groupBy("community_name", "time_stored", "score").agg(F.sum("change").alias("n"))
        return counts.where("n <> 0").select("community_name").distinct()

    # Writing

    def extended(self, changed: DataFrame, version: int, oldest: int | None = None) -> StoreIndex:
        """The index after the store has taken ``changed`` rows in as ``version``.

        ``changed`` has post columns, a row for each key. When tables are written anew,
        scores of posts stored before ``oldest`` are left out for good.
        """
        if self.parts:
            old = materialize(self.known(changed), new_folder(self.spark, "index-old"))
        else:
            old = self.spark.createDataFrame([], _KEYS).select(*KEY, *VALUES)
        parts = tuple(p for p in self.parts if p != version)
        if len(parts) < MAX_PARTS:
            tables = _changes(changed, old)
            parts = (*parts, version)
        else:
            tables = self._whole(_changes(changed, old), oldest)
            parts = (version,)
        _write(self.root, version, self.buckets, *tables)
        rows = [(p, self.buckets) for p in parts]
        manifest = self.spark.createDataFrame(rows, "part long, buckets int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/index/manifest/version={version}")
        return StoreIndex(self.spark, self.root, self.buckets, parts)

    def _whole(self, changes: tuple[DataFrame, ...], oldest: int | None) -> tuple[DataFrame, ...]:
        """All parts and the changes to come, as one part."""
        keys, links, scores = changes
        last = F.lit(2**62).cast("long")
        keys = _newest(self._table("keys", _KEYS).drop("bucket").unionByName(keys.withColumn("version", last)))
        links = _summed(self._table("links", _LINKS).select("url", "change").unionByName(links), ["url"])
        by = ["community_name", "time_stored", "score"]
        kept = self._table("scores", _SCORES).select(*by, "change").unionByName(scores)
        if oldest is not None:
            kept = kept.where(F.col("time_stored") >= oldest)
        return keys, links, _summed(kept, by)


def _newest(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*VALUES), "version").alias("v")
    return rows.groupBy(*KEY).agg(newest).select(*KEY, "v.*")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("change").alias("change")).where("change <> 0")


def _changes(changed: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows of keys, and changes of the counts of links and scores."""
    now = indexed(changed)
    before = [F.col(c).alias(f"old_{c}") for c in VALUES]
    both = now.join(old.select(*KEY, *before, F.lit(True).alias("known")), KEY, "left")
    links = both.selectExpr(
        """inline(array(struct(url as url, 1L as change),
                        struct(old_url as url, if(known, -1L, 0L) as change)))"""
    )
    values = "community_name as community_name, time_stored as time_stored, score as score"
    olds = "old_community_name as community_name, old_time_stored as time_stored, old_score as score"
    scores = both.selectExpr(
        f"""inline(array(struct({values}, if(is_active, 1L, 0L) as change),
                         struct({olds}, if(known and old_is_active, -1L, 0L) as change)))"""
    )
    by = ["community_name", "time_stored", "score"]
    return now, _summed(links.where(LINKED), ["url"]), _summed(scores, by)


def _write(root: str, version: int, buckets: int, keys: DataFrame, links: DataFrame, scores: DataFrame) -> None:
    by_date = stored_date(F.col("time_stored"))
    for name, rows, column, value in (
        ("keys", keys, "bucket", _bucket(KEY, buckets)),
        ("links", links, "bucket", _bucket(["url"], buckets)),
        ("scores", scores, "stored_date", by_date),
    ):
        spread = rows.withColumn(column, value).hint("rebalance", column)
        spread.write.mode("overwrite").partitionBy(column).parquet(f"{root}/index/{name}/version={version}")


def create_index(posts: DataFrame, root: str, version: int, buckets: int = BUCKETS) -> StoreIndex:
    """Index a whole store, as it is in ``version``."""
    spark = posts.sparkSession
    empty = StoreIndex(spark, root, buckets, ())
    return empty.extended(posts, version)


def open_index(spark: SparkSession, root: str, version: int | None) -> StoreIndex | None:
    """The index of a version of the store; None if it has none."""
    folder = f"{root}/index/manifest/version={version}"
    if version is None or not files.exists(spark, f"{folder}/_SUCCESS"):
        return None
    rows = sorted((r["part"], r["buckets"]) for r in spark.read.schema(_MANIFEST).parquet(folder).collect())
    return StoreIndex(spark, root, rows[0][1], tuple(part for part, _ in rows))


def expire_index(spark: SparkSession, root: str, oldest: int) -> None:
    """Remove the index of versions before ``oldest``, and the parts that only those read."""
    folder = f"{root}/index/manifest"
    for version in files.numbers(spark, folder, "version"):
        if version < oldest:
            files.remove(spark, f"{folder}/version={version}")
    reached = set()
    for version in files.finished(spark, folder, "version"):
        reached |= set(open_index(spark, root, version).parts)
    for name in ("keys", "links", "scores"):
        for part in files.numbers(spark, f"{root}/index/{name}", "version"):
            if part < oldest and part not in reached:
                files.remove(spark, f"{root}/index/{name}/version={part}")
