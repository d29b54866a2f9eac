import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions.text import page_link, preview
from feedloom.operators import filters
from feedloom.operators.ranking import (
    display_order,
    feed_pages,
    feed_summary,
    max_daily_posts,
    page_manifest,
    rank_order,
    read_page,
    requested_page,
    write_pages,
)
from feedloom.operators.rules import size_rules
from feedloom.workload import adaptors

CAPS = {"ants": 4, "wasps": 1, "moths": 3}
ROWS = {
    ("wasps", 0): [6, 9], ("wasps", 3): [-2], ("moths", 0): [7, 7, 5, 8, 1],
    ("moths", 1): [4], ("ants", 2): [1, 3, 2], ("ants", 0): [11],
}


@pytest.fixture
def aged(spark):
    rows = [
        ("f", community, age, f"{community}{age}{i}", "c", score, CAPS[community])
        for (community, age), scores in ROWS.items()
        for i, score in enumerate(scores)
    ]
    return spark.createDataFrame(
        rows,
        "feed string, community_name string, age_in_days long, id string, community_id string,"
        " score long, max_daily long",
    )


@pytest.mark.parametrize("bound", [5, 5_000])
def test_daily_cap(aged, bound):
    kept = rank_order(max_daily_posts(aged, bound)).orderBy("rank").collect()
    assert [(r.community_name, r.age_in_days, r.score) for r in kept] == [
        ("ants", 0, 11), ("ants", 2, 3), ("ants", 2, 2), ("ants", 2, 1), ("moths", 0, 8), ("moths", 0, 7),
        ("moths", 0, 7), ("moths", 1, 4), ("wasps", 0, 9), ("wasps", 3, -2),
    ]


def test_a_cap_of_zero_drops_all(aged):
    assert max_daily_posts(aged.withColumn("max_daily", F.lit(0)), 0).count() == 0


@pytest.fixture
def items(spark):
    rows = [("f", f"{i:02}", "c", 1000 - i // 2) for i in range(25)]
    rows += [("g", f"{i:02}", "c", i) for i in range(10)]
    return spark.createDataFrame(
        rows, "feed string, id string, community_id string, time_stored long"
    )


def test_display_order_and_pages(spark, items, tmp_path):
    pages = feed_pages(display_order(items))
    write_pages(pages, str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    assert [r.id for r in read_page(stored, "f", "").collect()] == [f"{i:02}" for i in range(10)]
    # The last page is shown whether partial or full.
    assert [r.id for r in read_page(stored, "f", "3").collect()] == [f"{i:02}" for i in range(20, 25)]
    assert [r.id for r in read_page(stored, "g", "x").collect()] == [f"{i:02}" for i in range(9, -1, -1)]
    assert read_page(stored, "g", "2").count() == 0


def test_requested_page():
    assert [requested_page(t) for t in ("", "0", "7", "abc", "5000")] == [1, 1, 7, 1, 5000]
    for bad in ("-1", "5001"):
        with pytest.raises(ValueError):
            requested_page(bad)


def test_manifest_and_summary(items):
    ordered = display_order(items)
    rows = page_manifest(feed_pages(ordered)).orderBy("feed", "page_no").collect()
    assert [(r.feed, r.page_no, r.items) for r in rows] == [
        ("f", 1, 10), ("f", 2, 10), ("f", 3, 5), ("g", 1, 10)
    ]
    assert (rows[0].previous_link, rows[0].next_link) == (None, "/reddit/?feed=f&page=2")
    assert (rows[2].previous_link, rows[2].next_link) == ("/reddit/?feed=f&page=2", None)
    assert (rows[0].newest, rows[0].oldest) == (1000, 996)
    assert {r.feed: (r.items, r.pages) for r in feed_summary(ordered).collect()} == {
        "f": (25, 3), "g": (10, 1)
    }


def test_links_escape_names(spark):
    link = page_link(F.lit("a b*~é&"), F.lit(2))
    got = spark.range(1).select(link.alias("l")).first().l
    assert got == "/reddit/?feed=a+b%2A~%C3%A9%26&page=2"


def test_preview_counts_characters(spark):
    df = spark.createDataFrame([("héllo wörld",), ("héllo",)], "t string")
    assert [r.p for r in df.select(preview(F.col("t"), 5).alias("p")).collect()] == ["héllo...", "héllo"]


def test_a_large_feed_is_numbered_in_ranges(spark):
    """A million rows of one feed, most of them of one second; no window takes a whole feed."""
    n = 1_000_000
    rows = spark.range(n).select(
        F.when(F.col("id") < 10, "few").otherwise("many").alias("feed"),
        F.lpad(F.col("id").cast("string"), 7, "0").alias("id"),
        F.lit("c").alias("community_id"),
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(n).alias("time_stored"),
    ).repartition(8, F.xxhash64("id"))
    numbered = display_order(rows)
    window = Window.partitionBy("feed").orderBy(F.desc("time_stored"), "id", "community_id")
    both = numbered.withColumn("want", F.row_number().over(window))
    assert both.where("display_rank <> want").isEmpty() and numbered.columns == [*rows.columns, "display_rank"]
    assert numbered.agg(F.count_distinct("feed", "display_rank")).first()[0] == n
    assert "Window" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert display_order(rows.limit(0)).isEmpty()


def test_rank_order_does_not_depend_on_the_bound(aged):
    assert sorted(map(str, rank_order(aged).collect())) == sorted(map(str, rank_order(aged, most=50).collect()))


@pytest.mark.parametrize("cap", [1, 7, 60, 93, 400])
def test_scan_cap_inside_a_crowded_second(spark, monkeypatch, cap):
    """Beginnings of ids narrow the second down; ids that share them all stay in."""
    monkeypatch.setattr(filters, "CROWDED", 5)
    ids = [f"{i * 7 % 300}" for i in range(90)] + ["same"] * 30 + ["x" * 70 + str(i) for i in range(20)]
    rows = [(f, i, f"c{k}", 50 + (k % 9 == 0)) for f in ("f", "g") for k, i in enumerate(ids)]
    rows += [("small", "1", "c", 3)]
    posts = spark.createDataFrame(rows, "feed string, id string, community_id string, time_stored long")
    sized = size_rules(adaptors.rules(spark))
    got = {tuple(r) for r in filters.feed_scan_cap(posts, sized, cap).collect()}
    want = set()
    for feed in ("f", "g", "small"):
        of = sorted((r for r in rows if r[0] == feed), key=lambda r: (-r[3], r[1], r[2]))
        want |= set(of[:cap])
    assert got == want
