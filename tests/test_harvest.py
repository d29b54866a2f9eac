import random

import pytest
from pyspark.sql import functions as F

from feedloom.plans import harvest
from feedloom.plans.harvest import StopLimits, harvest_page_stats, harvest_run, harvest_stop_rule
from feedloom.sources.listings import (
    drop_sticky,
    listing_normalize,
    page_cursor,
    read_listings,
    stamp_harvest_time,
)
from feedloom.sources.registry import load_posts, register_source, source_names

STATS = "community_name string, page_no long, n_rows long, n_new long"


def stop(spark, pages, limits=StopLimits()):
    from feedloom.plans.harvest import percent_new

    df = spark.createDataFrame([("c", i, *p) for i, p in enumerate(pages, 1)], STATS)
    df = df.withColumn("percent_new", percent_new(F.col("n_rows"), F.col("n_new")))
    rows = harvest_stop_rule(df, limits).orderBy("page_no").collect()
    return [(r.page_no, r.stop_reason) for r in rows]


def test_stop_reasons(spark):
    go = "continue"
    assert stop(spark, [(100, 90), (100, 20), (100, 19), (100, 90)]) == [
        (1, go), (2, go), (3, "too few new rows")
    ]
    assert stop(spark, [(10, 10), (9, 9), (100, 100)]) == [(1, go), (2, "too few rows")]
    assert stop(spark, [(0, 0), (100, 100)]) == [(1, "too few rows")]
    # More than ten pages end it, so the eleventh is still taken.
    assert stop(spark, [(100, 100)] * 13)[-2:] == [(10, go), (11, "page limit")]
    assert stop(spark, [(100, 100)] * 4, StopLimits(max_pages=2))[-1] == (3, "page limit")
    # The page limit is tested before the number of rows.
    assert stop(spark, [(100, 100)] * 10 + [(0, 0)])[-1] == (11, "page limit")


def test_page_stats_leave_out_pinned_rows(spark):
    rows = [("c", 1, False, True), ("c", 1, True, True), ("c", 1, False, False), ("c", 2, True, True)]
    df = spark.createDataFrame(rows, "community_name string, page_no long, is_sticky boolean, new boolean")
    stats = {r.page_no: (r.n_rows, r.n_new, r.percent_new) for r in harvest_page_stats(df, F.col("new")).collect()}
    assert stats == {1: (2, 1, 50.0), 2: (0, 0, 0.0)}


@pytest.mark.parametrize("pages_per_chunk", [1, 2, 1_000])
def test_cursor(spark, monkeypatch, pages_per_chunk):
    monkeypatch.setattr("feedloom.sources.listings.PAGES_PER_CHUNK", pages_per_chunk)
    rows = [
        ("c", 1, 1, "a", True), ("c", 2, 1, "b", False), ("c", 2, 2, "d", False),
        ("c", 2, 3, "e", True), ("c", 3, 1, "f", True), ("c", 4, 1, "g", True),
        ("c", 5, 1, "h", False), ("k", 1, 1, "i", False),
    ]
    df = spark.createDataFrame(
        rows, "community_name string, page_no long, pos long, name string, is_sticky boolean"
    )
    got = {(r.community_name, r.page_no): r.cursor for r in page_cursor(df).collect()}
    assert got == {
        ("c", 1): "", ("c", 2): "d", ("c", 3): "d", ("c", 4): "d", ("c", 5): "h", ("k", 1): "i"
    }


LINES = [
    '{"id":"1","community_id":"c1","community":"FunNy","name":"t3_1","permalink":"/1",'
    '"created_utc":12.0,"deleted":true,"stickied":false,"score":-4,"title":"x","url":"u",'
    '"page_no":1,"pos":2}',
    '{"id":"2","community_id":"c1","community":"funny","name":"t3_2","permalink":"/2",'
    '"created_utc":13.5,"score":4,"title":"y","stickied":true,"page_no":1,"pos":1}',
]


def test_landed_rows_are_normalized(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES))
    posts = listing_normalize(read_listings(spark, str(tmp_path)))
    one, two = posts.orderBy("id").collect()
    assert (one.community_name, one.is_active, one.is_sticky, one.time_created, one.time_stored) == (
        "funny", False, False, 12, 12,
    )
    assert (two.is_active, two.is_sticky, two.url, two.time_created) == (True, True, "", 13)
    kept = stamp_harvest_time(drop_sticky(posts), 99).collect()
    assert [(r.id, r.time_stored, r.time_created) for r in kept] == [("1", 99, 12)]


def test_sources_by_name(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES))
    assert "listing" in source_names()
    assert load_posts(spark, "listing", path=str(tmp_path)).count() == 2
    register_source("broken", lambda spark: spark.range(1))
    with pytest.raises(ValueError, match="community_id"):
        load_posts(spark, "broken")


def one_writer(store, pages, run_ts, limits):
    """Rounds of pages, communities by name, row by row."""
    held = {key: dict(row) for key, row in store.items()}
    urls = lambda: {r["url"] for r in held.values()}
    labels, reasons = [], {}
    going = {c for c, _ in pages}
    for k in range(1, limits.max_pages + 2):
        for c in sorted(going):
            listed = [r for r in pages.get((c, k), []) if not r["is_sticky"]]
            # A repeated key: last values at the first place.
            folded = {}
            for r in listed:
                folded[(r["id"], r["community_id"])] = r
            new = 0
            for key, r in folded.items():
                row = {**r, "time_stored": run_ts}
                if key in held:
                    old = held[key]
                    held[key] = {**row, **{f: old[f] for f in ("time_stored", "time_created", "community_name")}}
                    labels.append((k, key, "UPDATED"))
                elif row["url"] and row["url"] in urls():
                    labels.append((k, key, "SKIPPED"))
                else:
                    held[key] = row
                    labels.append((k, key, "NEW"))
                    new += 1
            if (c, k) in pages:
                if k > limits.max_pages:
                    reasons[c] = (k, "page limit")
                elif len(listed) < limits.min_rows:
                    reasons[c] = (k, "too few rows")
                elif 100.0 * new / len(listed) < limits.min_new_percent:
                    reasons[c] = (k, "too few new rows")
        going -= set(reasons)
        going = {c for c in going if (c, k + 1) in pages}
    return sorted(labels), reasons, held


@pytest.mark.parametrize("seed, repeats", [(1, True), (2, True), (3, False), (4, False), (5, False)])
def test_harvest_equals_one_writer(spark, make_posts, monkeypatch, seed, repeats):
    """Posts that pages repeat are taken in rounds, others for all pages at once."""
    monkeypatch.setattr(harvest, "_by_passes" if repeats else "_by_rounds", None)
    rng = random.Random(seed)
    limits = StopLimits(max_pages=4, min_rows=3, min_new_percent=30.0)
    urls = [""] * 3 + [f"u{i}" for i in range(60)]

    def post(c, n):
        return {
            "id": f"{c}{n}", "community_id": "id-" + c, "community_name": c, "score": rng.randint(0, 99),
            "time_created": rng.randint(0, 9), "is_sticky": rng.random() < 0.1, "url": rng.choice(urls),
            "title": f"t{rng.randint(0, 9)}",
        }

    communities = [f"c{i}" for i in range(8)]
    store = {}
    for c in communities:
        for n in rng.sample(range(60), 10):
            r = {**post(c, n), "time_stored": 5}
            store[(r["id"], r["community_id"])] = r
    pages = {}
    for c in communities:
        for k in range(1, rng.randint(2, 8)):
            size = 0 if rng.random() < 0.05 else rng.randint(2, 9)
            own = range(60) if repeats else range(7 * k - 7, 7 * k)
            listed = [post(c, rng.choice(own)) for _ in range(size)]
            if listed:
                pages[(c, k)] = listed
    # Pages are landed without gaps.
    for c in communities:
        k = 1
        while (c, k) in pages:
            k += 1
        for later in [p for p in pages if p[0] == c and p[1] > k]:
            del pages[later]

    flat = [(r, c, k, i) for (c, k), listed in pages.items() for i, r in enumerate(listed, 1)]
    places = spark.createDataFrame([(i, k, p) for i, (_, _, k, p) in enumerate(flat)], "n long, page_no long, pos long")
    posts = make_posts([{**r, "name": str(i)} for i, (r, *_) in enumerate(flat)])
    landed = posts.join(places, posts.name == places.n.cast("string")).drop("n")

    result = harvest_run(make_posts([*store.values()]), landed, 77, limits=limits)
    labels, reasons, held = one_writer(store, pages, 77, limits)
    got = [(r.page_no, (r.id, r.community_id), r.store_result) for r in result.labelled.collect()]
    assert sorted(got) == labels
    stops = result.pages.where("stop_reason <> 'continue'").collect()
    assert {r.community_name: (r.page_no, r.stop_reason) for r in stops} == reasons
    after = result.applied_to(make_posts([*store.values()])).collect()
    fields = ("url", "score", "title", "time_created", "time_stored", "community_name")
    assert {(r.id, r.community_id): tuple(r[f] for f in fields) for r in after} == {
        key: tuple(r[f] for f in fields) for key, r in held.items()
    }


def test_a_community_ends_at_its_first_gap(spark, make_posts):
    places = [("a", 1), ("a", 3), ("b", 2), ("c", 1), ("c", 2)]
    posts = make_posts(
        [{"id": f"{c}{k}-{i}", "community_name": c, "name": str(k)} for c, k in places for i in range(20)]
    )
    landed = posts.withColumns(
        {"page_no": F.col("name").cast("long"), "pos": F.split("id", "-")[1].cast("long")}
    )
    result = harvest_run(make_posts([]), landed, 7)
    taken = {(r.community_name, r.page_no) for r in result.labelled.collect()}
    assert taken == {("a", 1), ("c", 1), ("c", 2)}
    assert {(r.community_name, r.page_no) for r in result.pages.collect()} == taken


def test_pages_are_numbered_from_one(spark, make_posts):
    landed = make_posts([{"id": "1"}]).withColumns(
        {"page_no": F.lit(0).cast("long"), "pos": F.lit(1).cast("long")}
    )
    with pytest.raises(ValueError, match="numbered from 1"):
        harvest_run(make_posts([]), landed, 7)


def test_only_communities_of_rules_are_harvested(spark, make_posts):
    posts = make_posts([{"id": str(i), "community_name": c} for i, c in enumerate("ab")])
    landed = posts.withColumns({"page_no": F.lit(1).cast("long"), "pos": F.lit(1).cast("long")})
    rules = spark.createDataFrame([("f", "a")], "feed string, community string")
    result = harvest_run(make_posts([]), landed, 7, rules)
    assert [r.id for r in result.changed.collect()] == ["0"]
