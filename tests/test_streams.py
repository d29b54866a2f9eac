"""Streams and snapshots: broken communities, expiry, cursors over batches, changed feeds."""

import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.operators.ingest import by_sequence
from feedloom.operators.status import feed_status, read_log
from feedloom.plans.feeds import build_all_feeds
from feedloom.schema import FEED_ITEMS
from feedloom.sources import index
from feedloom.sources.listings import last_cursors, listing_normalize, page_cursor, stream_listings
from feedloom.sources.posts import expire_versions, merge_posts, posts_sink, read_posts
from feedloom.streaming.cursors import cursor_stream, read_cursors
from feedloom.streaming.harvest import community_outcomes, harvest_stream, read_ledger
from feedloom.streaming.snapshots import current_feeds, newest_snapshots, refresh_changed_feeds

DAY = 86_400
NOW = 10 * DAY + 50_000


def listing(n, page, pos, community="Funny", **more):
    return {
        "id": str(n), "community_id": "c" + community, "community": community, "name": f"t3_{n}",
        "permalink": f"/{n}", "created_utc": 5.0, "deleted": False, "stickied": False,
        "score": n, "title": f"t{n}", "url": f"u{n}", "page_no": page, "pos": pos, **more,
    }


@pytest.mark.parametrize("stop_rule", [False, True])
def test_a_broken_community_fails_alone(spark, make_posts, tmp_path, stop_rule):
    root, landing, log = str(tmp_path / "store"), tmp_path / "landing", str(tmp_path / "log")
    landing.mkdir()
    posts_sink(make_posts([]), root, version=0, index_buckets=2)
    rules = spark.createDataFrame(
        [("a", "funny"), ("b", "funny"), ("b", "gifs"), ("c", "empty")], "feed string, community string"
    )
    rows = [listing(i, 1, i + 1) for i in range(12)] + [listing(50 + i, 1, i + 1, "Gifs") for i in range(12)]
    rows += [listing(70, None, 3, "Gifs"), listing(80, 1, 1, "Empty", title=None), listing(90, 1, 1, "Other")]
    (landing / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken")
    harvest_stream(
        stream_listings(spark, str(landing)), root, str(tmp_path / "progress"), run_ts=lambda batch_id: 100,
        rules=rules, log=log, once=True, stop_rule=stop_rule, keep_versions=5,
    ).awaitTermination()
    assert {r.community_name for r in read_posts(spark, root).collect()} == {"funny"}
    feeds = rules.select("feed").distinct()
    status = {r.feed: r.status for r in feed_status(feeds, read_log(spark, log), 700).collect()}
    assert status == {"a": "IDLE", "b": "ERROR", "c": "ERROR"}
    ledger = {r.community_name: r for r in read_ledger(spark, root).collect()}
    assert (ledger["funny"].status, ledger["funny"].n_new, ledger["funny"].last_page) == ("IDLE", 12, 1)
    assert (ledger["gifs"].status, ledger["gifs"].reason, ledger["gifs"].n_new) == ("ERROR", "a row without a place", None)
    assert (ledger["empty"].reason, ledger["empty"].n_rejected) == ("no row can be a post", 1) and len(ledger) == 3
    assert community_outcomes(stream_rows(spark, [])).isEmpty()


def stream_rows(spark, rows):
    from feedloom.schema import LISTING

    return spark.createDataFrame([[r[c] for c in LISTING.fieldNames()] for r in rows], LISTING)


def files_under(root):
    return sum(len(f) for _, _, f in os.walk(root))


def test_merges_with_expiry_stay_small(spark, make_posts, tmp_path, monkeypatch):
    """Files and what opening the store reads don't grow with the number of merges."""
    monkeypatch.setattr(index, "MAX_PARTS", 2)
    root, plain = str(tmp_path / "store"), str(tmp_path / "plain")
    first = make_posts([{"id": f"p{i}", "url": f"u{i}", "time_stored": DAY * (i % 3)} for i in range(9)])
    sizes = []
    posts_sink(first, root, version=1, index_buckets=2)
    posts_sink(first, plain, version=1)
    for version in range(2, 11):
        batch = make_posts(
            [{"id": f"p{version}", "score": version, "url": f"u{version}"}, {"id": f"n{version}", "url": "u3", "time_stored": DAY}]
        ).withColumn("n", F.monotonically_increasing_id())
        merge_posts(spark, root, by_sequence(batch, "n"), version)
        expire_versions(spark, root, keep=2)
        sizes.append(files_under(root))
        merge_posts(spark, plain, by_sequence(batch, "n"), version)  # of this nothing expires
    assert max(sizes[5:]) <= max(sizes[:5]) + 4
    assert len(os.listdir(f"{root}/data")) < len(os.listdir(f"{plain}/data")) == 10
    assert sorted(map(str, read_posts(spark, root).collect())) == sorted(map(str, read_posts(spark, plain).collect()))
    assert read_posts(spark, root, 9).count() == read_posts(spark, plain, 9).count()
    with pytest.raises(ValueError):
        read_posts(spark, root, 8)
    store = read_posts(spark, root)
    kept = index.open_index(spark, root, 10).known(store)
    assert sorted(map(str, kept.collect())) == sorted(map(str, index.indexed(store).collect()))
    with pytest.raises(ValueError):
        read_posts(spark, str(tmp_path / "nowhere"))


def test_cursors_over_batches(spark, tmp_path):
    """Three batches, the last of them replayed, give what one run over all pages gives."""
    root, landing, progress = str(tmp_path / "root"), tmp_path / "landing", tmp_path / "progress"
    landing.mkdir()
    pages = {
        0: [listing(1, 1, 1), listing(2, 1, 2), listing(3, 1, 1, "Gifs"), listing(4, 2, 1, "Gifs")],
        1: [listing(5, 2, 1, stickied=True), listing(6, 3, 1), listing(7, 1, 1, "New", stickied=True)],
        2: [listing(8, 4, 1, stickied=True), listing(9, 3, 1, "Gifs", stickied=True), listing(10, 2, 1, "New")],
    }
    for number, rows in pages.items():
        (landing / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))
        cursor_stream(stream_listings(spark, str(landing)), root, str(progress)).awaitTermination()
    want = page_cursor(listing_normalize(stream_rows(spark, sum(pages.values(), [])))).collect()
    assert sorted(map(tuple, read_cursors(spark, root).collect())) == sorted(map(tuple, want))
    for name in ("2", ".2.crc"):  # the last batch was not committed, so it comes again
        os.remove(progress / "commits" / name)
    cursor_stream(stream_listings(spark, str(landing)), root, str(progress)).awaitTermination()
    assert sorted(map(tuple, read_cursors(spark, root).collect())) == sorted(map(tuple, want))
    ends = last_cursors(read_cursors(spark, root), spark.createDataFrame([("old", "x")], "community_name string, cursor string"))
    assert {tuple(r) for r in ends.collect()} == {("funny", "t3_6"), ("gifs", "t3_4"), ("new", "t3_10"), ("old", "x")}


@pytest.mark.parametrize("buckets", [None, 2])
def test_only_changed_feeds_are_rebuilt(spark, make_posts, tmp_path, buckets):
    store, root = str(tmp_path / "store"), str(tmp_path / "feeds")
    rows = [("f", "text", "funny", 50.0, 5), ("g", "text", "gifs", 50.0, 5), ("h", "text", "old", 100.0, 5)]
    rules = spark.createDataFrame(rows, "feed string, media string, community string, percentile double, max_daily long")
    posts = [
        {"id": f"{c}{i}", "community_name": c, "score": i, "time_stored": NOW - 1000 * i, "url": f"{c}{i}"}
        for c in ("funny", "gifs", "old") for i in range(6)
    ]
    posts.append({"id": "leaves", "community_name": "old", "score": 99, "time_stored": NOW - 7 * DAY + 1800})
    posts_sink(make_posts(posts), store, version=1, index_buckets=buckets)

    def refresh(now):
        return refresh_changed_feeds(spark, root, store, rules, now)

    def same_as_full(now):
        columns = [c for c in FEED_ITEMS.fieldNames() if c != "media"]
        got = current_feeds(spark, root).select(*columns)
        full = build_all_feeds(read_posts(spark, store), rules, now).select(*columns)
        return sorted(map(str, got.collect())) == sorted(map(str, full.collect()))

    assert refresh(NOW) == ["f", "g", "h"] and same_as_full(NOW)
    assert refresh(NOW + 60) == []
    batch = make_posts([{"id": "gifs3", "community_name": "gifs", "score": 50, "url": "gifs3"}])
    merge_posts(spark, store, by_sequence(batch.withColumn("n", F.lit(0)), "n"), 2)
    assert refresh(NOW + 120) == ["g"] and same_as_full(NOW + 120)
    assert {r.feed: r.snapshot_ts for r in newest_snapshots(spark, root).collect()} == {"f": NOW, "g": NOW + 120, "h": NOW}
    assert refresh(NOW + 3600) == ["h"] and same_as_full(NOW + 3600)  # a post has left the week
    assert refresh(NOW + DAY) == ["f", "g", "h"] and same_as_full(NOW + DAY)
