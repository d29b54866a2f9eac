"""The store's index against recounts of the store, over random merges."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.ingest import by_sequence
from feedloom.operators.scores import community_thresholds
from feedloom.operators.rules import size_rules
from feedloom.plans.harvest import harvest_run
from feedloom.schema import FIRST_SEEN, POST_COLUMNS, POSTS
from feedloom.sources import index, posts
from feedloom.workload import adaptors


def random_rows(rng, n, seen):
    """Posts of which some are known, over few links and communities."""
    rows, ids = [], set()
    for _ in range(n):
        i = rng.randrange(seen + n)
        if i in ids:
            continue
        ids.add(i)
        url = rng.choice(["", None, "a", "b", "c", f"own{i}", f"own{rng.randrange(seen + n)}"])
        rows.append((f"p{i}", f"c{i % 3}", f"name{i % 3}", "t", "/p", 5, 86_400 * rng.randrange(4) + i, rng.random() < 0.7, False,
                     rng.randrange(-3, 6), "x", url))
    return rows


def stored_row_by_row(store, rows):
    """What one writer does: update a known key, skip a link that a post holds, else insert."""
    for row in rows:
        key = row["id"], row["community_id"]
        if key in store:
            old = store[key]
            store[key] = {**row, **{c: old[c] for c in FIRST_SEEN}}
        elif not row["url"] or all(r["url"] != row["url"] for r in store.values()):
            store[key] = row


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def recounted(store):
    links = store.where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("change"))
    scores = store.where("is_active").groupBy("community_name", "time_stored", "score").agg(F.count(F.lit(1)).alias("n"))
    return {r.url: r.change for r in links.collect()}, {tuple(r[:3]): r.n for r in scores.collect()}


def test_random_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MAX_PARTS", 5)
    rng = random.Random(8)
    root = str(tmp_path / "store")
    first = spark.createDataFrame(random_rows(rng, 40, 0), POSTS)
    posts.posts_sink(first, root, version=1, index_buckets=3)
    plain = {(r.id, r.community_id): r.asDict() for r in first.collect()}
    shape = T.StructType([*POSTS.fields, T.StructField("n", T.IntegerType())])
    for version in range(2, 22):
        rows = random_rows(rng, 25, 40)
        batch = by_sequence(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], shape), "n")
        posts.merge_posts(spark, root, batch, version)
        stored_row_by_row(plain, [dict(zip(POSTS.fieldNames(), r, strict=True)) for r in rows])
        if version == 9:
            at_nine = Counter(r["url"] for r in plain.values() if r["url"])
    found = index.open_index(spark, root, 21)
    assert len(found.parts) <= 5
    store = posts.read_posts(spark, root).select(*POST_COLUMNS)
    assert sorted(map(tuple, store.collect()), key=str) == sorted((tuple(r.values()) for r in plain.values()), key=str)
    links, scores = recounted(store)
    assert {r.url: r.change for r in found.holders(store).collect()} == links
    assert sorted_rows(found.known(store)) == sorted_rows(index.indexed(store))
    summed = found._table("scores", index._SCORES).groupBy("community_name", "time_stored", "score").agg(F.sum("change").alias("n"))
    assert {tuple(r[:3]): r.n for r in summed.where("n <> 0").collect()} == scores
    # an old version still has its index
    old = index.open_index(spark, root, 9)
    assert {r.url: r.change for r in old.holders(posts.read_posts(spark, root, 9)).collect()} == at_nine


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = random_rows(random.Random(1), 300, 0)
    posts.posts_sink(spark.createDataFrame(rows, POSTS), root, version=1, index_buckets=32)
    found = index.open_index(spark, root, 1)
    batch = spark.createDataFrame(rows[:2], POSTS)
    for part, table in ((found.known(batch), "keys"), (found.holders(batch.withColumn("url", F.lit("a"))), "links")):
        files = part.inputFiles()
        assert files and all(f"/index/{table}/" in f for f in files) and len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 32
        scan = part._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket#[^\]]* (IN|=) ", scan) and "/data/" not in scan
    assert found.known(batch).count() == 2
    assert found.holders(batch.withColumn("url", F.lit("a"))).first()["change"] == sum(r[-1] == "a" for r in rows)


def test_thresholds_read_no_post(spark, tmp_path, make_posts):
    root = str(tmp_path / "store")
    rng = random.Random(3)
    rows = [{"id": f"p{i}", "score": rng.randrange(50), "time_stored": 1000 + i * 9000, "is_active": i % 4 > 0} for i in range(90)]
    store = make_posts(rows)
    posts.posts_sink(store, root, version=1, index_buckets=2)
    since = 300_000
    counts = index.open_index(spark, root, 1).score_counts(since)
    sized = size_rules(adaptors.rules(spark, [("f", "F", "", 30, 5, "funny", 0, 0)]))
    recent = store.where((F.col("time_stored") >= since) & F.col("is_active"))
    want = community_thresholds(recent, sized).collect()
    nothing = store.limit(0)
    assert community_thresholds(nothing, sized, counts).collect() == want and want[0].min_score > 0


def test_old_scores_expire_when_tables_are_written_anew(spark, tmp_path, make_posts):
    root = str(tmp_path / "store")
    store = make_posts([{"id": f"p{i}", "time_stored": 100_000 * i} for i in range(6)])
    made = index.create_index(store, root, 1, 2)
    changed = make_posts([{"id": "p5", "time_stored": 500_000, "score": 9}])
    parts = index.StoreIndex(spark, root, 2, made.parts * index.MAX_PARTS)
    whole = parts.extended(changed, 2, oldest=300_000)
    assert whole.parts == (2,)
    assert {(r.score, r.n) for r in index.open_index(spark, root, 2).score_counts(0).collect()} >= {(9, 1)}
    assert whole._table("scores", index._SCORES).agg(F.min("time_stored")).first()[0] == 300_000


@pytest.mark.parametrize("buckets", [None, 4])
def test_harvest_by_the_index(spark, tmp_path, make_posts, buckets):
    """A harvest gives the same rows whether it looks posts up in the store or in its index."""
    root = str(tmp_path / "store")
    store = make_posts([{"id": f"p{i}", "url": f"u{i % 5}", "time_stored": 10} for i in range(20)])
    posts.posts_sink(store, root, version=1, index_buckets=4)
    landed = make_posts([{"id": f"p{i}", "url": f"u{i % 12}", "score": 7} for i in range(10, 40)])
    landed = landed.withColumns({"page_no": F.lit(1).cast("long"), "pos": F.expr("cast(substr(id, 2) as bigint)")})
    found = index.open_index(spark, root, 1) if buckets else None
    result = harvest_run(posts.read_posts(spark, root), landed, 99, index=found)
    labels = {(r.id, r.store_result) for r in result.labelled.collect()}
    assert {r[0] for r in labels if r[1] == "NEW"} == {"p20", "p21"} and len(labels) == 30
    assert result.changed.count() == 12
