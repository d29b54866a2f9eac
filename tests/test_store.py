import json
import os
from types import SimpleNamespace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from feedloom.functions.timeops import DAY_SECONDS
from feedloom.operators.filters import active_only, retention_window
from feedloom.operators.ingest import by_sequence
from feedloom.operators.status import feed_status, read_log
from feedloom.schema import POST_COLUMNS
from feedloom.session import shared_dir
from feedloom.sources.listings import stream_listings
from feedloom.sources.posts import merge_posts, posts_scan, posts_sink, read_posts
from feedloom.streaming.harvest import harvest_stream


def placed(posts):
    return by_sequence(posts.withColumn("n", F.col("id").cast("long")), "n").drop("n")


def day(n):
    return n * DAY_SECONDS + 5


@pytest.fixture
def store(spark, make_posts, tmp_path):
    root = str(tmp_path / "store")
    posts = make_posts(
        [{"id": str(n), "time_stored": day(n), "url": f"u{n}", "community_id": "c"} for n in range(5)]
    )
    posts_sink(posts, root, version=0)
    return root


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_scan_takes_parameters(spark, make_posts):
    posts = make_posts([{"id": str(n), "score": 10 - n, "title": "it's; --"} for n in range(4)])
    rows = posts_scan(posts, "score >= :least and title = :title", {"least": 8, "title": "it's; --"}, "score")
    assert [r.score for r in rows.collect()] == [8, 9, 10]
    assert rows.columns == POST_COLUMNS


def test_merge_rewrites_only_the_days_it_touches(spark, store, make_posts):
    batch = make_posts(
        [
            {"id": "1", "community_id": "c", "time_stored": day(9), "score": 50, "url": "u1"},
            {"id": "7", "community_id": "c", "time_stored": day(9), "url": "fresh"},
            {"id": "8", "community_id": "c", "time_stored": day(9), "url": "u2"},
        ]
    )
    labelled = merge_posts(spark, store, placed(batch), version=1)
    assert {r.id: r.store_result for r in labelled.collect()} == {
        "1": "UPDATED", "7": "NEW", "8": "SKIPPED"
    }
    rows = by_id(read_posts(spark, store))
    assert sorted(rows) == ["0", "1", "2", "3", "4", "7"]
    assert (rows["1"].score, rows["1"].time_stored) == (50, day(1))
    folders = [d for d in os.listdir(f"{store}/data/version=1") if d.startswith("stored")]
    assert sorted(folders) == ["stored_date=1970-01-02", "stored_date=1970-01-10"]
    assert len(by_id(read_posts(spark, store, 0))) == 5


def test_a_replayed_version_replaces_itself(spark, store, make_posts):
    batch = placed(make_posts([{"id": "7", "community_id": "c", "time_stored": day(9)}]))
    for _ in range(2):
        labelled = merge_posts(spark, store, batch, version=1)
        assert [r.store_result for r in labelled.collect()] == ["NEW"]
    assert sorted(by_id(read_posts(spark, store))) == ["0", "1", "2", "3", "4", "7"]


def test_a_version_without_a_manifest_is_not_read(spark, store, make_posts):
    from feedloom.sources.posts import write_partitions

    write_partitions(make_posts([{"id": "x"}]), f"{store}/data/version=1")
    assert sorted(by_id(read_posts(spark, store))) == ["0", "1", "2", "3", "4"]


def test_an_empty_store(spark, make_posts, tmp_path):
    root = str(tmp_path / "empty")
    posts_sink(make_posts([]), root, version=0)
    assert read_posts(spark, root).count() == 0
    merge_posts(spark, root, placed(make_posts([{"id": "1"}])), version=1)
    assert read_posts(spark, root).count() == 1


def test_reads_prune_days_and_push_predicates(spark, store):
    now = day(4) + 7 * DAY_SECONDS - DAY_SECONDS  # the window starts within day 3
    recent = active_only(retention_window(read_posts(spark, store), now)).select("id", "score")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stored_date" in plan
    assert "GreaterThanOrEqual(time_stored," in plan
    assert "EqualTo(is_active,true)" in plan or "is_active" in plan.split("PushedFilters")[1]
    assert "title" not in plan.split("ReadSchema")[1]
    assert sorted(by_id(recent)) == ["3", "4"]


def test_the_shared_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured and "shared" in configured


@pytest.mark.parametrize("master, allowed", [("local[8]", True), ("yarn", False)])
def test_only_a_local_run_may_go_without_it(master, allowed):
    conf = SimpleNamespace(get=lambda key, default: default)
    unset = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    if allowed:
        assert os.path.isdir(shared_dir(unset))
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(unset)


def listing(n, page, pos, **more):
    base = {
        "id": str(n), "community_id": "c", "community": "Funny", "name": f"t3_{n}",
        "permalink": f"/{n}", "created_utc": 5.0, "deleted": False, "stickied": False,
        "score": n, "title": f"t{n}", "url": f"u{n}", "page_no": page, "pos": pos,
    }
    return {**base, **more}


@pytest.mark.parametrize("stop_rule", [False, True])
def test_stream_equals_batches(spark, make_posts, tmp_path, stop_rule):
    root, landing = str(tmp_path / "store"), tmp_path / "landing"
    landing.mkdir()
    posts_sink(make_posts([]), root, version=0)
    drops = [
        [listing(n, 1 + n // 20, n % 20) for n in range(60)],
        # Few of the first page are new, so a harvest goes no further.
        [listing(n, 1 + (n - 45) // 20, n, score=900) for n in range(45, 85)],
    ]
    for number, rows in enumerate(drops):
        (landing / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))
        harvest_stream(
            stream_listings(spark, str(landing)),
            root,
            str(tmp_path / "progress"),
            run_ts=lambda batch_id: 1_000 + batch_id,
            stop_rule=stop_rule,
            once=True,
        ).awaitTermination()
    rows = by_id(read_posts(spark, root))
    assert len(rows) == 85
    assert {r.time_stored for r in rows.values() if int(r.id) < 60} == {1_000}
    assert rows["45"].score == 900 and rows["44"].score == 44


def test_a_failed_batch_shows_until_its_replay(spark, make_posts, tmp_path):
    root, landing, log = str(tmp_path / "store"), tmp_path / "landing", str(tmp_path / "log")
    landing.mkdir()
    rules = spark.createDataFrame([("f", "funny"), ("f", "gifs")], "feed string, community string")
    other = listing(2, 1, 2, community="elsewhere")
    (landing / "a.json").write_text("\n".join(map(json.dumps, [listing(1, 1, 1), other])))

    def status():
        return feed_status(rules.select("feed").distinct(), read_log(spark, log), 700).first()

    def run():
        harvest_stream(
            stream_listings(spark, str(landing)), root, str(tmp_path / "progress"),
            run_ts=lambda batch_id: 100, rules=rules, log=log, once=True,
        ).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()  # there is no store yet
    assert status().status_text == "Error"
    posts_sink(make_posts([]), root, version=0)
    run()
    assert (status().status_text, status().last_harvest) == ("00:10 ago", 100)
    assert list(by_id(read_posts(spark, root))) == ["1"]


def test_default_sink_then_merge_keeps_all(spark, tmp_path, make_posts):
    from feedloom.sources.posts import next_version

    root = str(tmp_path / "store")
    posts_sink(make_posts([{"id": "a"}, {"id": "b"}]), root)
    batch = make_posts([{"id": "c"}]).withColumns({"seq": F.lit(0).cast("long"), "chunk": F.lit(1)})
    with pytest.raises(ValueError):
        merge_posts(spark, root, batch, 1)
    assert next_version(spark, root, "w#0") == 2
    for _ in range(2):  # a replay changes nothing
        merge_posts(spark, root, batch, next_version(spark, root, "w#0"), "w#0")
        assert {r.id for r in read_posts(spark, root).collect()} == {"a", "b", "c"}
    assert next_version(spark, root, "other#0") == 3
    with pytest.raises(ValueError):
        read_posts(spark, root, 9)
