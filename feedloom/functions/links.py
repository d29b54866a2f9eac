"""A post's URL taken apart with native string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ["raw", "scheme", "userinfo", "host", "path", "route", "query", "fragment"]

# Each step builds on the columns of earlier ones, so every part is computed once
# per row. Characters no host name may hold make a link malformed.
_STEPS = [
    {"_raw": "coalesce({url}, '')"},
    {"_body": "substring_index(_raw, '#', 1)"},
    {"_main": "substring_index(_body, '?', 1)"},
    {
        "_scheme": "case when lower(left(_main, 6)) = 'https:' then 'https'"
        " when lower(left(_main, 5)) = 'http:' then 'http' else '' end",
        "_query": "substr(_body, char_length(_main) + 1)",
        "_fragment": "nullif(substr(_raw, char_length(_body) + 1), '#')",
    },
    {"_rest": "if(_scheme = '', '', substr(_main, char_length(_scheme) + 2))"},
    {
        "_authority": "if(startswith(_rest, '//'), substring_index(substr(_rest, 3), '/', 1), '')",
    },
    {
        "_hostport": "substring_index(_authority, '@', -1)",
        "_path": "case when startswith(_rest, '//') then substr(_rest, char_length(_authority) + 3)"
        " when startswith(_rest, '/') then _rest else '' end",
    },
    {
        "_fragment": "coalesce(_fragment, '')",
        "_userinfo": "left(_authority, char_length(_authority) - char_length(_hostport))",
        "_host": "lower(substring_index(_hostport, ':', 1))",
        "_route": r"case when _scheme = '' or _hostport rlike r'[\x00-\x20\\^`{|}\x7f%]' then null"
        r" when {url} rlike r'[\x00-\x1f\x7f]' then null"
        r" when not _hostport rlike r'^(\[[^\]]*\]|[^:]*)(:[0-9]*)?\z' then null"
        " when contains(_path, '%') then try_url_decode(replace(_path, '+', '%2B'))"
        " else _path end",
    },
]


def with_link_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add one column per entry of ``PARTS``, each named with a leading underscore.

    ``path`` is the path as written and ``route`` the percent-decoded path that
    site rules match on. ``route`` is null for anything but a well-formed
    http(s) link, and ``host`` is lower case without user and port.
    """
    keep = df.columns
    for step in _STEPS:
        made = {name: F.expr(sql.replace("{url}", f"`{url}`")) for name, sql in step.items()}
        df = df.withColumns(made)
    return df.select(*keep, *["_" + name for name in PARTS])


def computed_once(col: Column) -> Column:
    """A select item with the value of ``col``, which later filters do not repeat.

    A filter on a computed column is moved below the computation by copying it,
    and copies of columns built in steps multiply. Exploding a one-element array
    leaves rows as they are and stops that.
    """
    return F.explode(F.array(col))


def in_domain(host: Column, domain: str) -> Column:
    """Whether ``host`` is ``domain`` or lies under it."""
    return (host == domain) | F.endswith(host, F.lit("." + domain))
