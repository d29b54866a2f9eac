import json

import pytest

from feedloom.operators.rules import (
    account_rule_violations,
    duplicate_communities,
    duplicate_feed_names,
    feed_menu,
    feed_membership,
    feed_rule_violations,
    resolve_feed_rules,
    rule_lookup_join,
    zero_percentile_excluded,
)
from feedloom.operators.status import feed_listing, feed_status
from feedloom.sources.rules import (
    account_rules_source,
    feed_rules_source,
    feeds_of,
    read_account_documents,
    read_feed_documents,
)

# One feed that sets everything, one whose communities lean on it, one that sets nothing.
FEEDS = {
    "document": "gardens",
    "feeds": [
        {
            "name": "herbs", "description": "Kitchen herbs", "media": "image", "percentile": 41.5,
            "max_daily_posts": 8,
            "communities": [{"name": "Basil", "percentile": 12.25, "max_daily_posts": 3}, {"name": "thyme"}],
        },
        {
            "name": "trees", "description": "Old trees", "percentile": 66.0,
            "communities": [
                {"name": "oak", "max_daily_posts": 17}, {"name": "elm", "percentile": 5.0},
                {"name": "ash", "percentile": 9.0, "max_daily_posts": -1},
            ],
        },
        {"name": "weeds", "description": "Weeds", "max_daily_posts": -6, "communities": [{"name": "nettle"}]},
        {"name": "moss", "description": "Moss", "media": "text", "communities": [{"name": "peat"}]},
    ],
}

ACCOUNTS = {
    "document": "gardens",
    "feeds": [
        {
            "name": "growers", "description": "Growers",
            "filters": [
                {"account": "nursery_9", "filtertype": "retweets", "percentile": 3, "max_daily_posts": 1},
                {"account": "seed-bank", "filtertype": "original", "percentile": 99.5, "max_daily_posts": 60},
            ],
        }
    ],
}


@pytest.fixture
def load(spark, tmp_path):
    def load(document, reader=read_feed_documents, rows=feed_rules_source):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(document, indent=2))
        return rows(reader(spark, str(path), multiline=True))

    return load


def test_defaults_cascade(load):
    rows = resolve_feed_rules(load(FEEDS)).orderBy("feed_no", "community_no").collect()
    assert [(r.feed, r.media, r.community, r.percentile, r.max_daily) for r in rows] == [
        ("herbs", "image", "basil", 12.25, 3),
        ("herbs", "image", "thyme", 41.5, 8),
        ("trees", "text", "oak", 66.0, 17),
        ("trees", "text", "elm", 5.0, 100),
        ("trees", "text", "ash", 9.0, 0),
        ("weeds", "text", "nettle", 80.0, 0),
        ("moss", "text", "peat", 80.0, 100),
    ]


def test_sound_rules_have_no_violations(load):
    feeds, accounts = load(FEEDS), load(ACCOUNTS, read_account_documents, account_rules_source)
    assert feed_rule_violations(resolve_feed_rules(feeds)).count() == 0
    assert account_rule_violations(accounts).count() == 0
    menus = feeds_of(feeds, "community"), feeds_of(accounts, "account")
    assert duplicate_feed_names(*menus).count() == 0
    assert duplicate_communities(resolve_feed_rules(feeds)).count() == 0
    assert [(r.source, r.feed) for r in feed_menu(*menus).collect()] == [
        ("account", "growers"), ("community", "herbs"), ("community", "moss"), ("community", "trees"),
        ("community", "weeds"),
    ]


def test_every_broken_rule_is_reported(load):
    broken = {
        "document": "d",
        "feeds": [
            {"name": "", "description": "", "media": "video", "communities": []},
            {
                "name": "two words", "description": "x",
                "communities": [
                    {"name": "", "percentile": -1.0}, {"name": "a", "percentile": 101.0},
                    {"name": "A", "max_daily_posts": -3},
                ],
            },
            {"name": "both\n", "description": "x", "communities": [{"name": "b"}]},
            {"name": "both", "description": "x", "communities": [{"name": "c"}]},
        ],
    }
    rows = resolve_feed_rules(load(broken))
    found = {(r.feed_no, r.community_no, r.violation) for r in feed_rule_violations(rows).collect()}
    assert found == {
        (1, 0, "feed name blank"), (1, 0, "feed description blank"), (1, 0, "media type unknown"),
        (2, 1, "feed name has other characters"), (2, 1, "community blank"),
        (2, 1, "percentile outside 0-100"), (2, 2, "percentile outside 0-100"),
        (3, 1, "feed name has other characters"),
    }
    # Unresolved, a negative daily cap is a violation too.
    unresolved = feed_rule_violations(load(broken)).where("violation = 'daily cap negative'")
    assert [(r.feed_no, r.community_no) for r in unresolved.collect()] == [(2, 3)]
    assert [(r.community, r.uses) for r in duplicate_communities(rows).collect()] == [("a", 2)]

    accounts = load(
        {
            "document": "d",
            "feeds": [
                {"name": "both", "description": "", "filters": []},
                {
                    "name": "", "description": "x",
                    "filters": [{"account": "", "filtertype": "likes", "percentile": 101, "max_daily_posts": -1}],
                },
            ],
        },
        read_account_documents,
        account_rules_source,
    )
    found = {(r.feed_no, r.filter_no, r.violation) for r in account_rule_violations(accounts).collect()}
    assert found == {
        (1, 0, "feed description blank"), (2, 1, "feed name blank"), (2, 1, "account blank"),
        (2, 1, "filter type unknown"), (2, 1, "percentile outside 0-100"), (2, 1, "daily cap negative"),
    }
    twice = duplicate_feed_names(feeds_of(rows, "community"), feeds_of(accounts, "account"))
    assert {(r.feed, r.uses) for r in twice.collect()} == {("both", 2), ("", 2)}


def test_joins_with_posts(spark, make_posts):
    rules = spark.createDataFrame(
        [("f", "a", 0.0, 3), ("f", "b", -1.0, 4), ("g", "a", 5.0, 6)],
        "feed string, community string, percentile double, max_daily long",
    )
    posts = make_posts([{"id": c, "community_name": c} for c in "abz"])
    members = feed_membership(posts, rules)
    assert sorted((r.feed, r.id) for r in members.collect()) == [("f", "a"), ("f", "b"), ("g", "a")]
    found = rule_lookup_join(members, zero_percentile_excluded(rules))
    assert {(r.feed, r.id): r.max_daily for r in found.collect()} == {
        ("f", "a"): 0, ("f", "b"): 0, ("g", "a"): 6
    }


def test_status_texts(spark):
    log = [
        ("idle", 1_000, 1, "IDLE"), ("idle", 900, 9, "ERROR"), ("long", 1, 1, "IDLE"),
        ("busy", 5, 1, "IDLE"), ("busy", 5, 2, "HARVESTING"), ("bad", 5, 1, "ERROR"),
        ("odd", 5, 1, "PAUSED"), ("zero", 0, 1, "IDLE"),
    ]
    log = spark.createDataFrame(log, "feed string, ts long, entry_no long, status string")
    feeds = log.select("feed").distinct().union(spark.createDataFrame([("none",)], "feed string"))
    now = 1_000 + 3 * 3_600 + 61
    texts = {r.feed: r.status_text for r in feed_status(feeds, log, now).collect()}
    assert texts == {
        "idle": "03:01 ago", "long": "03:17 ago", "busy": "Harvesting", "bad": "Error",
        "odd": "Error", "zero": "Not harvested yet", "none": "Not harvested yet",
    }
    later = {r.feed: r.status_text for r in feed_status(feeds, log, 1 + 123 * 3_600).collect()}
    assert later["long"] == "123:00 ago"


def test_listing(spark):
    df = spark.sql(
        "select 'f' as feed, 1 as display_rank, '/r/x' as permalink, 'A title' as title, 3 as score,"
        " 0 as age_in_days, 'x' as community_name,"
        " cast(null as struct<url: string, embed: string>) as media"
    )
    row = feed_listing(df, "https://site", 3).first()
    assert (row.link, row.title_preview, row.media_url) == ("https://site/r/x", "A t...", "")
