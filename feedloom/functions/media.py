"""Media links: site rules as data, applied in order, first match wins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.links import PARTS, computed_once, with_link_parts


@dataclass(frozen=True)
class SiteRule:
    """One way to show a link.

    ``pattern`` is searched in the decoded path of links under ``domain`` (any
    host if None). ``url`` or ``embed`` is the output template; its ``{names}``
    are link parts, and ``{id}`` is the pattern's first group, or what the SQL
    expression ``refine_id`` makes of it. A rule with neither template handles
    the link as "no media".
    """

    name: str
    domain: str | None
    pattern: str
    url: str | None = None
    embed: str | None = None
    refine_id: str = "{id}"


# Last token of the leading run of tokens joined by single hyphens.
LAST_TOKEN = "substring_index(rtrim('-', substring_index({id}, '--', 1)), '-', -1)"

# Sites, path patterns and the HTML each site asks embedders to use.
SITE_RULES: tuple[SiteRule, ...] = (
    SiteRule("reddit comments", "reddit.com", r"(?i)^/r/[^/]+/comments"),
    SiteRule(
        "imgur gifv",
        "imgur.com",
        r"(?i)\.gifv\z",
        url="{scheme}://{userinfo}i.imgur.com{path}{query}{fragment}",
    ),
    SiteRule(
        "imgur image page",
        "imgur.com",
        r"^(/[A-Za-z0-9]+)\z",
        url="{scheme}://{userinfo}i.imgur.com{id}.jpg{query}{fragment}",
    ),
    SiteRule(
        "giphy media",
        "giphy.com",
        r"^/media/([A-Za-z0-9]+)",
        embed='<iframe src="https://giphy.com/embed/{id}" frameborder="0" scrolling="no"'
        ' width="100%" height="100%" class="giphy-embed" allowFullScreen></iframe>',
    ),
    SiteRule(
        "giphy page",
        "giphy.com",
        r"^/gifs/([A-Za-z0-9][A-Za-z0-9-]*)",
        embed='<iframe src="https://giphy.com/embed/{id}" frameborder="0" scrolling="no"'
        ' width="100%" height="100%" class="giphy-embed" allowFullScreen></iframe>',
        refine_id=LAST_TOKEN,
    ),
    SiteRule(
        "gfycat",
        "gfycat.com",
        r"^/+(?:gifs/detail/)?([A-Za-z0-9]+)",
        embed='<div style="position:relative;padding-bottom:54%">'
        '<iframe src="https://gfycat.com/ifr/{id}" frameborder="0" scrolling="no"'
        ' width="100%" height="100%" style="position:absolute;top:0;left:0" allowfullscreen>'
        "</iframe></div>",
    ),
    SiteRule("media file", None, r"(?i)\.(?:gifv?|png|jpe?g|mp4|webm)\z", url="{raw}"),
)


def _text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _render(template: str | None, found: str) -> str:
    """A template as an SQL expression."""
    if template is None:
        return "''"
    values = {part: "_" + part for part in PARTS} | {"id": found}
    pieces = re.split(r"\{(\w+)\}", template)
    return f"concat({', '.join(values[t] if i % 2 else _text(t) for i, t in enumerate(pieces))})"


def _case(rule: SiteRule) -> str:
    """A rule as a branch of an SQL case."""
    applies = f"_route rlike {_text(rule.pattern)}"
    if rule.domain:
        under = f"endswith(_host, {_text('.' + rule.domain)})"
        applies = f"(_host = {_text(rule.domain)} or {under}) and {applies}"
    if rule.url is None and rule.embed is None:
        return f"when {applies} then null"
    group = f"regexp_extract(_route, {_text(rule.pattern)}, 1)"
    found = rule.refine_id.replace("{id}", group)
    shown = f"'url', {_render(rule.url, found)}, 'embed', {_render(rule.embed, found)}"
    return f"when {applies} then named_struct({shown})"


def with_media(
    df: DataFrame, rules: Sequence[SiteRule] = SITE_RULES, url: str = "url", name: str = "media"
) -> DataFrame:
    """Add nullable struct ``media{url, embed}``; one of the two is blank."""
    chain = F.expr(f"case {' '.join(_case(rule) for rule in rules)} end")
    return with_link_parts(df, url).select(*df.columns, computed_once(chain).alias(name))


def media_kind(media: Column) -> Column:
    """How a page shows the media: embed, mp4, webm, image or none.

    The suffix test is case-sensitive and sees the query, so ``x.MP4`` and
    ``x.mp4?a`` both count as images.
    """
    url = media["url"]
    return (
        F.when(media.isNull(), "none")
        .when(media["embed"] != "", "embed")
        .when(F.endswith(url, F.lit(".mp4")), "mp4")
        .when(F.endswith(url, F.lit(".webm")), "webm")
        .when(url != "", "image")
        .otherwise("none")
    )
