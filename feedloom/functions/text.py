"""Small string expressions used by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(text: Column, limit: int) -> Column:
    """``text`` cut to ``limit`` characters, with ``...`` where it was cut."""
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(limit)), F.lit("..."))
    )


def query_escape(text: Column) -> Column:
    """Percent-encode a URL query value: only letters, digits and ``-_.~`` stay."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def page_link(feed: Column, page_no: Column, base_path: str = "/reddit/") -> Column:
    """Relative link of one page of a feed, parameters in name order."""
    return F.concat(
        F.lit(base_path + "?feed="), query_escape(feed), F.lit("&page="), page_no.cast("string")
    )
