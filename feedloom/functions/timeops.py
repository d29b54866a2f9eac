"""Day boundaries and ages as column expressions.

Posts carry epoch seconds. Local clock arithmetic names its zone, so results do
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DAY_SECONDS = 86_400
BOUNDARY_HOUR = 3


def day_boundary(now: Column, tz: str = "UTC") -> Column:
    """Epoch second of the next 03:00 on the local clock of ``tz``.

    03:00:00 sharp belongs to the new day, so its boundary is tomorrow's. The
    wall-clock time is rebuilt from its parts because adding three hours to a
    local midnight is an hour off on days the clocks change.
    """
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=now.cast("decimal(18,6)")
    )
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    late = (F.hour(local) >= BOUNDARY_HOUR).cast("int")
    day = F.date_add(local.cast("date"), late)
    at_three = F.make_timestamp(
        F.year(day), F.month(day), F.dayofmonth(day),
        F.lit(BOUNDARY_HOUR), F.lit(0), F.lit(0), F.lit(tz),
    )
    return F.unix_seconds(at_three)


def age_in_days(boundary: Column, time_stored: Column) -> Column:
    """Whole days from ``time_stored`` to ``boundary``; -1 is the day after.

    Days are a fixed 86,400 s and the division truncates toward zero, so an
    exact negative multiple of a day comes out one lower than a floor would.
    """
    delta = boundary - time_stored
    shifted = F.when(delta < 0, delta - DAY_SECONDS).otherwise(delta)
    return F.call_function("div", shifted, F.lit(DAY_SECONDS).cast("long"))


def stored_date(time_stored: Column) -> Column:
    """UTC date of an epoch second: the partition column of the post store."""
    day = F.lit(DAY_SECONDS).cast("long")
    days = F.call_function("div", time_stored - F.pmod(time_stored, day), day)
    return F.date_from_unix_date(days.cast("int"))
