import pytest
from pyspark.sql import functions as F

from feedloom.operators.filters import feed_scan_cap
from feedloom.operators.rules import feed_membership, size_rules
from feedloom.plans.feeds import build_all_feeds, build_feed
from feedloom.streaming.snapshots import current_feeds, newest_snapshots, refresh_feeds
from feedloom.workload import adaptors as a

SF = "/root/testdata/sf0.001"
RULES = "feed string, media string, community string, percentile double, max_daily long"
NOW = 7 * 86_400 + 50_000


@pytest.fixture
def rules(spark):
    rows = [("f", "text", "funny", 50.0, 2), ("g", "image", "funny", 100.0, 9), ("g", "image", "b", 0.0, 9)]
    return spark.createDataFrame(rows, RULES)


@pytest.fixture
def posts(make_posts):
    return make_posts(
        [
            {"id": str(n), "score": n, "time_stored": NOW - n, "url": "https://x.org/a.png" if n % 2 else ""}
            for n in range(-1, 6)
        ]
    )


def shown(df):
    rows = df.orderBy("feed", "display_rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r.feed, []).append(r.id)
    return out


def test_feeds(posts, rules):
    # Half of seven scores is offset 3, score 2; the daily cap keeps the best two.
    assert shown(build_all_feeds(posts, rules, NOW)) == {"f": ["4", "5"], "g": ["1", "3", "5"]}
    assert shown(build_feed(posts, rules, "g", NOW)) == {"g": ["1", "3", "5"]}
    assert shown(build_feed(posts, rules, "nobody", NOW)) == {}


def test_feed_cap(posts, rules):
    assert shown(build_all_feeds(posts, rules, NOW, scan_cap=2))["f"] == ["2", "3"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feed_plan(spark):
    """Posts meet rules in broadcast joins, old events are skipped by the reader,
    and daily caps cut groups before they are shuffled."""
    built = build_all_feeds(a.week_posts(spark, SF), a.rules(spark), a.NOW)
    plan = plan_of(built)
    assert "GreaterThanOrEqual(ts,2024-01-23" in plan
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
    assert "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_many_rules_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("feedloom.operators.rules.MAX_BROADCAST_BYTES", 2)
    sized = size_rules(a.rules(spark))
    assert not sized.small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = build_all_feeds(a.week_posts(spark, SF), a.rules(spark), a.NOW)
        assert "Broadcast" not in plan_of(built)
        big = shown(built)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    assert big == shown(build_all_feeds(a.week_posts(spark, SF), a.rules(spark), a.NOW))


def test_scan_cap_shuffles_no_texts(spark):
    """All rows share a stored second, as after a harvest: only slim rows are numbered."""
    posts = a.posts_ev(spark, SF).withColumn("time_stored", F.lit(a.NOW).cast("long"))
    sized = size_rules(a.rules(spark))
    members = feed_membership(posts, sized.rows)
    capped = feed_scan_cap(members, sized, 20)
    numbered = plan_of(capped).split("Window ")[1:]
    assert numbered and not any("title" in part or "permalink" in part for part in numbered)
    rows = capped.select("feed", "id").collect()
    want = {}
    for r in members.select("feed", "id").collect():
        want.setdefault(r.feed, []).append(r.id)
    got = {f: sorted(r.id for r in rows if r.feed == f) for f in want}
    assert got == {f: sorted(ids)[:20] for f, ids in want.items()}


def test_only_newest_snapshots_are_read(spark, posts, rules, tmp_path):
    for now in (NOW, NOW + 7_200):
        refresh_feeds(spark, str(tmp_path), posts, rules, now)
    plan = plan_of(current_feeds(spark, str(tmp_path)))
    assert "PartitionFilters" in plan
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert str(NOW + 7_200) in filters and f"{NOW}," not in filters and f"{NOW})" not in filters


def test_snapshots_are_rebuilt_when_stale(spark, posts, rules, tmp_path):
    root = str(tmp_path)

    def built():
        return {r.feed: r.snapshot_ts for r in newest_snapshots(spark, root).collect()}

    refresh_feeds(spark, root, posts, rules.where("feed = 'f'"), NOW)
    assert built() == {"f": NOW}
    # At exactly one hour a snapshot still holds; the other feed is built anew.
    refresh_feeds(spark, root, posts, rules, NOW + 3_600)
    assert built() == {"f": NOW, "g": NOW + 3_600}
    refresh_feeds(spark, root, posts, rules, NOW + 3_600)
    assert shown(current_feeds(spark, root)) == {"f": ["4", "5"], "g": ["1", "3", "5"]}
    more = posts.withColumn("score", F.col("score") * -1)
    refresh_feeds(spark, root, more, rules, NOW + 3_601)
    assert built() == {"f": NOW + 3_601, "g": NOW + 3_600}
    assert shown(current_feeds(spark, root))["f"] == ["-1", "0"]


def test_a_feed_without_items_counts_as_built(spark, make_posts, rules, tmp_path):
    refresh_feeds(spark, str(tmp_path), make_posts([]), rules, NOW)
    assert newest_snapshots(spark, str(tmp_path)).count() == 2
