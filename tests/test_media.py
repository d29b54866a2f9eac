import pytest
from pyspark.sql import functions as F

from feedloom.functions.media import SITE_RULES, SiteRule, media_kind, with_media
from feedloom.operators.media_jobs import domain_share, media_coverage

# The markup that viewers embed, and what becomes of each kind of link.
GIPHY = (
    '<iframe src="https://giphy.com/embed/{}" frameborder="0" scrolling="no" width="100%"'
    ' height="100%" class="giphy-embed" allowFullScreen></iframe>'
)
GFYCAT = (
    '<div style="position:relative;padding-bottom:54%"><iframe src="https://gfycat.com/ifr/{}"'
    ' frameborder="0" scrolling="no" width="100%" height="100%"'
    ' style="position:absolute;top:0;left:0" allowfullscreen></iframe></div>'
)


def url(text):
    return (text, "")


def embed(template, text):
    return ("", template.format(text))


# URL -> (media url, media embed), or None for no media.
CASES = {
    "https://reddit.com/r/foo/comments/xyz": None,
    "https://www.Reddit.com/R/foo/Comments/xyz.jpg": None,
    "https://reddit.com/r/foo/x.jpg": url("https://reddit.com/r/foo/x.jpg"),
    "https://notreddit.com/r/foo/comments/x.png": url("https://notreddit.com/r/foo/comments/x.png"),
    "https://imgur.com/abc.gifv": url("https://i.imgur.com/abc.gifv"),
    "HTTP://u:p@m.imgur.com:81/aB.GIFV?x=1#top": url("http://u:p@i.imgur.com/aB.GIFV?x=1#top"),
    "https://imgur.com/abc": url("https://i.imgur.com/abc.jpg"),
    "https://imgur.com/abc?q#": url("https://i.imgur.com/abc.jpg?q"),
    "https://imgur.com/%61bc": url("https://i.imgur.com/abc.jpg"),
    "https://imgur.com/a+b": None,
    "https://imgur.com/a/abc": None,
    "https://imgur.com/a:l": None,
    "https://imgur.com/abc.png": url("https://imgur.com/abc.png"),
    "https://imgurXcom/abc": None,
    "https://media.giphy.com/media/xyzz/giffy.gif": embed(GIPHY, "xyzz"),
    "https://giphy.com/gifs/foo-bar-baz-xyzz/giffy.gif": embed(GIPHY, "xyzz"),
    "https://giphy.com/gifs/foo--bar": embed(GIPHY, "foo"),
    "https://giphy.com/gifs/foo-bar-": embed(GIPHY, "bar"),
    "https://giphy.com/gifs/-foo": None,
    "https://giphy.com/explore/cats": None,
    "https://gfycat.com/xYzz123": embed(GFYCAT, "xYzz123"),
    "https://gfycat.com//xYzz123": embed(GFYCAT, "xYzz123"),
    "https://gfycat.com/gifs/detail/xYzz123": embed(GFYCAT, "xYzz123"),
    "https://gfycat.com/gifs/detail/": embed(GFYCAT, "gifs"),
    "https://gfycat.com/": None,
    "https://example.org/a.JPEG": url("https://example.org/a.JPEG"),
    "https://example.org/a.gifv#x": url("https://example.org/a.gifv#x"),
    "https://example.org/a.webm?b.txt": url("https://example.org/a.webm?b.txt"),
    "https://example.org/a?b.jpg": None,
    "https://example.org/a.jpg\n": None,
    "https://example.org/a%2Ejpg": url("https://example.org/a%2Ejpg"),
    "https://example.org/%zz.jpg": None,
    "https://exa mple.org/a.jpg": None,
    "ftp://example.org/a.jpg": None,
    "example.org/a.jpg": None,
    "http:/a.jpg": url("http:/a.jpg"),
    "http:a.jpg": None,
    "http": None,
    "": None,
    None: None,
}


def test_site_rules(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    got = {r.url: r.media and (r.media.url, r.media.embed) for r in with_media(df).collect()}
    assert got == CASES


def test_a_long_link_does_not_exhaust_the_matcher(spark):
    long_link = "https://giphy.com/gifs/" + "a-" * 50_000 + "end"
    df = spark.createDataFrame([(long_link,)], "url string")
    assert with_media(df).first().media.embed == GIPHY.format("end")


def test_another_site_is_a_rule_more(spark):
    rule = SiteRule("clips", "clips.example", r"^/it's/(\d+)", url="https://cdn.example/{id}.mp4")
    df = spark.createDataFrame([("https://www.clips.example/it's/42",)], "url string")
    assert with_media(df).first().media is None
    assert with_media(df, [rule, *SITE_RULES]).first().media.url == "https://cdn.example/42.mp4"


@pytest.mark.parametrize(
    "link, kind",
    [
        ("https://x.org/a.mp4", "mp4"),
        ("https://x.org/a.webm", "webm"),
        ("https://x.org/a.MP4", "image"),
        ("https://x.org/a.mp4?a", "image"),
        ("https://gfycat.com/a", "embed"),
        ("https://x.org/a", "none"),
        ("", "none"),
    ],
)
def test_kind(spark, link, kind):
    df = with_media(spark.createDataFrame([(link,)], "url string"))
    assert df.select(media_kind(F.col("media")).alias("k")).first().k == kind


def test_a_filter_on_media_does_not_repeat_the_rules(spark):
    df = spark.createDataFrame([("https://x.org/a.mp4",)], "url string")
    kept = with_media(df).where("media is not null")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("giphy-embed") == with_media(df)._jdf.queryExecution().optimizedPlan().toString().count("giphy-embed")


def test_coverage_and_share(make_posts):
    posts = make_posts(
        [
            {"id": "1", "url": "https://giphy.com/media/a"},
            {"id": "2", "url": "https://media.GIPHY.com:80/media/b"},
            {"id": "3", "url": "https://media.giphy.com/x"},
            {"id": "4", "url": "https://x.org/a.mp4"},
            {"id": "5", "url": ""},
        ]
    )
    row = media_coverage(posts).first()
    assert (row.posts, row.linked, row.embed_posts, row.mp4_posts, row.none_posts) == (5, 4, 2, 1, 2)
    share = {r.host: (r.posts, r.share) for r in domain_share(posts, "giphy.com").collect()}
    assert share == {"giphy.com": (1, 0.2), "media.giphy.com": (2, 0.4)}
