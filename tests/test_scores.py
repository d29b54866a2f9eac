import random

import pytest

from feedloom.operators.filters import community_score_filter, feed_scan_cap
from feedloom.operators.rules import SizedRules, size_rules
from feedloom.operators.scores import active_count, community_thresholds, score_at_percentile
from feedloom.plans.feeds import recent_posts

RULE = "feed string, community string, percentile double, max_daily long"


def ladder(*communities):
    return [
        {"id": f"{c}-{i}", "community_id": "id-" + c, "community_name": c, "score": 3 * i}
        for c in communities
        for i in range(1, 61)
    ]


def at(df, percentiles):
    found = score_at_percentile(df, percentiles).collect()
    return {(r.community, r.percentile): r.min_score for r in found}


def test_score_ladder(make_posts):
    found = at(make_posts(ladder("funny")), [70, 50, 30, 101, 0])
    assert found == {
        ("funny", 70.0): 54, ("funny", 50.0): 90, ("funny", 30.0): 126,
        ("funny", 101.0): 0, ("funny", 0.0): 180,
    }


def reference_score(scores, p):
    """Score at zero-based offset int(P * n / 100), best first."""
    if p >= 100 or not scores:
        return 0
    ordered = sorted(scores, reverse=True)
    return ordered[min(int(p * len(ordered) / 100.0), len(ordered) - 1)]


def test_random_scores_of_any_size(make_posts):
    rng = random.Random(7)
    scores = {
        "small": [rng.randint(-5, 5) for _ in range(57)],
        "wide": [rng.randint(-(2**31), 2**31 - 1) for _ in range(200)],
        "huge": [rng.randint(-(2**62), 2**62) for _ in range(40)],
        "one": [-3],
    }
    rows = [
        {"id": f"{c}{i}", "community_name": c, "score": s}
        for c, values in scores.items()
        for i, s in enumerate(values)
    ]
    percentiles = [0.0, 0.1, 1.0, 29.0, 33.3, 50.0, 57.0, 99.0, 99.99, 100.0]
    found = at(make_posts(rows), percentiles)
    assert found == {
        (c, p): reference_score(values, p) for c, values in scores.items() for p in percentiles
    }


def test_min_scores_per_community(spark, make_posts):
    posts = make_posts(ladder("funny", "gifs", "pics"))
    bars = spark.createDataFrame(
        [("f", "funny", 177), ("f", "gifs", 180)], "feed string, community string, min_score long"
    )
    rows = community_score_filter(posts, bars, SizedRules(bars, True, 0)).collect()
    assert sorted(r.community_name for r in rows) == ["funny", "funny", "gifs"]


@pytest.mark.parametrize("small", [True, False])
def test_thresholds_with_and_without_broadcast(spark, make_posts, small):
    rules = spark.createDataFrame(
        [("a", "funny", 50.0, 1), ("b", "funny", 30.0, 1), ("b", "empty", 50.0, 1), ("b", "gifs", 100.0, 1)],
        RULE,
    )
    found = community_thresholds(make_posts(ladder("funny", "gifs")), SizedRules(rules, small, 1))
    assert {(r.feed, r.community): r.min_score for r in found.collect()} == {
        ("a", "funny"): 90, ("b", "funny"): 126, ("b", "empty"): 0, ("b", "gifs"): 0,
    }


def test_of_repeated_rules_the_last_counts(spark):
    """By document, feed and place in the feed, in whatever order the rows come."""
    rows = [
        ("a", "x", 30.0, 3, "d1", 2, 2),
        ("a", "x", 20.0, 9, "d2", 1, 2),
        ("a", "x", 10.0, 1, "d2", 1, 1),
        ("a", "y", 5.0, 4, "d1", 1, 1),
    ]
    places = RULE + ", document string, feed_no long, community_no long"
    for given in (rows, rows[::-1]):
        sized = size_rules(spark.createDataFrame(given, places))
        got = {(r.community, r.percentile, r.max_daily) for r in sized.rows.collect()}
        assert got == {("x", 20.0, 9), ("y", 5.0, 4)}
    with pytest.raises(ValueError, match="repeated rules"):
        size_rules(spark.createDataFrame([r[:4] for r in rows], RULE))


def test_one_community_in_many_feeds(spark, make_posts):
    posts = make_posts([{"id": str(i), "score": i} for i in range(100)])
    rules = spark.createDataFrame([(f"f{i}", "funny", float(i % 5 * 20), 1) for i in range(500)], RULE)
    found = community_thresholds(posts, size_rules(rules)).collect()
    assert len(found) == 500
    assert {(r.percentile, r.min_score) for r in found} == {(p, 99 - p) for p in (0, 20, 40, 60, 80)}


def test_counts_include_silent_communities(spark, make_posts):
    now = 7 * 86_400 + 100
    posts = make_posts(
        [
            {"id": "1", "time_stored": 100},
            {"id": "2", "time_stored": 99},
            {"id": "3", "time_stored": 100, "is_active": False},
        ]
    )
    rules = spark.createDataFrame([("f", "funny", 1.0, 1), ("f", "none", 1.0, 1)], RULE)
    counts = active_count(recent_posts(posts, now), rules)
    assert {r.community: r.active_posts for r in counts.collect()} == {"funny": 1, "none": 0}


@pytest.mark.parametrize("cap", [1, 7, 1_500, 5_000])
def test_scan_cap_keeps_the_newest(spark, cap):
    rng = random.Random(cap)
    rows = [
        (feed, str(i), "c", rng.choice([5, 5, 5, rng.randint(0, 50)]))
        for feed in ("a", "b")
        for i in range(2_000 if feed == "a" else 30)
    ]
    df = spark.createDataFrame(rows, "feed string, id string, community_id string, time_stored long")
    kept = feed_scan_cap(df, SizedRules(df, True, 0), cap)
    want = set()
    for feed in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == feed), key=lambda r: (-r[3], r[1]))
        want |= {r[:2] for r in mine[:cap]}
    got = [(r.feed, r.id) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
