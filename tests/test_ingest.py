import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators.ingest import (
    by_sequence,
    ingest_classify,
    ingest_merge,
    known_by_key,
    known_by_url,
    one_row_per_key,
    unknown_by_key,
)
from feedloom.schema import POST_COLUMNS

FIRST = {
    "id": "first", "name": "t3_first", "time_created": 700, "time_stored": 720,
    "permalink": "/r/birds/first", "score": 31, "title": "A heron",
    "url": "https://pics.example.org/heron.png", "community_name": "birds", "community_id": "c7",
}


def batch_of(posts):
    return by_sequence(posts.withColumn("n", F.monotonically_increasing_id()), "n").drop("n")


def labels(store, posts):
    return [r.store_result for r in ingest_classify(store, batch_of(posts)).collect()]


def test_upsert_sequence(make_posts):
    store = make_posts([])
    assert labels(store, make_posts([FIRST])) == ["NEW"]
    store = ingest_merge(store, batch_of(make_posts([FIRST])))

    better = {**FIRST, "score": 64, "time_created": 1, "time_stored": 2, "community_name": "x"}
    assert labels(store, make_posts([better])) == ["UPDATED"]
    store = ingest_merge(store, batch_of(make_posts([better])))

    other = {**FIRST, "id": "second", "community_id": "c8"}
    assert labels(store, make_posts([other])) == ["SKIPPED"]
    store = ingest_merge(store, batch_of(make_posts([other])))

    moved = {**other, "time_created": 900, "url": "https://pics.example.org/wren.png"}
    assert labels(store, make_posts([moved])) == ["NEW"]
    store = ingest_merge(store, batch_of(make_posts([moved])))

    rows = store.orderBy("time_created").collect()
    assert [(r.id, r.score, r.time_created, r.time_stored, r.community_name) for r in rows] == [
        ("first", 64, 700, 720, "birds"),
        ("second", 31, 900, 720, "birds"),
    ]


def sequential(store, batch):
    """Row by row, as one writer would."""
    held = dict(store)
    out = {}
    for key, url in batch:
        if key in held:
            out[key] = "UPDATED"
        elif url and url in held.values():
            out[key] = "SKIPPED"
            continue
        else:
            out[key] = "NEW"
        held[key] = url
    return out, held


@pytest.mark.parametrize("chunk_rows", [1, 3, 1_000])
def test_equals_row_by_row_on_random_batches(spark, make_posts, monkeypatch, chunk_rows):
    """Many little cases at once: their ids and links share no names."""
    monkeypatch.setattr("feedloom.operators.ingest.CHUNK_ROWS", chunk_rows)
    rng = random.Random(chunk_rows)
    stored, batch, want, left = [], [], {}, {}
    seq = 0
    for case in range(150):
        urls = ["", *[f"u{case}-{n}" for n in range(rng.randint(1, 4))]]
        keys = [f"k{case}-{n}" for n in range(12)]
        store = [(k, rng.choice(urls)) for k in keys if rng.random() < 0.4]
        rows = [(k, rng.choice(urls)) for k in rng.sample(keys, rng.randint(0, 12))]
        labelled, held = sequential(store, rows)
        want |= labelled
        left |= held
        stored += store
        for k, u in rows:
            batch.append((k, u, seq))
            seq += 1
    posts = make_posts([{"id": k, "url": u} for k, u in stored])
    order = spark.createDataFrame([(k, n) for k, _, n in batch], "id string, n long")
    rows = make_posts([{"id": k, "url": u} for k, u, _ in batch]).join(order, "id")
    rows = by_sequence(rows, "n")
    got = {r.id: r.store_result for r in ingest_classify(posts, rows).collect()}
    assert got == want
    assert {r.id: r.url for r in ingest_merge(posts, rows).collect()} == left


def test_a_link_most_rows_share_is_inserted_once(spark, make_posts, monkeypatch):
    monkeypatch.setattr("feedloom.operators.ingest.CHUNK_ROWS", 100)
    n = 3_000
    posts = spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        *[F.lit(make_default).alias(c) for c, make_default in (
            ("community_id", "c"), ("community_name", "c"), ("name", "n"), ("permalink", "p"))],
        F.lit(1).cast("long").alias("time_created"),
        F.lit(1).cast("long").alias("time_stored"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_sticky"),
        F.lit(1).cast("long").alias("score"),
        F.lit("t").alias("title"),
        F.expr("if(id % 3 = 0, 'own' || id, 'hot')").alias("url"),
        F.col("id").alias("n"),
    )
    # The holder lets go of the link in the middle of the batch.
    store = make_posts([{"id": "1500", "community_id": "c", "url": "hot"}])
    got = ingest_classify(store, by_sequence(posts, "n"))
    counts = {r.store_result: r["count"] for r in got.groupBy("store_result").count().collect()}
    assert counts == {"NEW": 1_000, "UPDATED": 1, "SKIPPED": 1_999}
    assert got.where("url = 'hot' and store_result = 'NEW'").first().id == "1501"


def test_repeats_of_a_key_fold(make_posts, spark):
    posts = make_posts([{"id": "a", "score": n} for n in range(3)] + [{"id": "b", "score": 9}])
    rows = by_sequence(posts.withColumn("n", F.col("score")), "n").drop("n")
    folded = {r.id: (r.score, r.seq) for r in one_row_per_key(rows).collect()}
    assert folded == {"a": (2, 0), "b": (9, 9)}


def test_known(make_posts):
    store = make_posts([{"id": "1", "url": "u"}, {"id": "2"}])
    batch = make_posts([{"id": "1", "url": "x"}, {"id": "3", "url": "u"}, {"id": "4"}])
    assert [r.id for r in known_by_key(batch, store).collect()] == ["1"]
    assert sorted(r.id for r in unknown_by_key(batch, store).collect()) == ["3", "4"]
    assert [r.id for r in known_by_url(batch, store).collect()] == ["3"]


def test_merge_keeps_the_post_schema(make_posts):
    merged = ingest_merge(make_posts([FIRST]), batch_of(make_posts([{"id": "2"}])))
    assert merged.columns == POST_COLUMNS
