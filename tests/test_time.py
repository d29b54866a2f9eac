from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from feedloom.functions.timeops import age_in_days, day_boundary, stored_date

DAY = 86_400


def boundary(spark, now, tz):
    now_col = F.lit(now).cast("long")
    return spark.range(1).select(day_boundary(now_col, tz).alias("b")).first().b


@pytest.mark.parametrize("now, ahead", [(1623747600, 3600), (1623816000, 6 * 3600)])
def test_boundary_is_the_next_three_in_the_morning(spark, now, ahead):
    assert boundary(spark, now, "America/Los_Angeles") == now + ahead


def test_three_sharp_belongs_to_the_next_day(spark):
    three = 1706670000
    assert boundary(spark, three, "UTC") == three + DAY
    assert boundary(spark, three - 1, "UTC") == three


@pytest.mark.parametrize("day", [(2024, 3, 9), (2024, 3, 10), (2024, 11, 2), (2024, 11, 3)])
@pytest.mark.parametrize("hour", [1, 2, 4, 23])
def test_boundary_on_days_the_clock_changes(spark, day, hour):
    zone = ZoneInfo("America/Los_Angeles")
    now = datetime(*day, hour, 30, tzinfo=zone)
    at = datetime.fromtimestamp(now.timestamp(), zone)  # 02:30 may not exist
    days_on = 1 if at.hour >= 3 else 0
    want = datetime(at.year, at.month, at.day + days_on, 3, tzinfo=zone)
    assert boundary(spark, int(now.timestamp()), str(zone)) == int(want.timestamp())


def test_boundary_does_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert boundary(spark, 1508230800, "America/Los_Angeles") == 1508230800 + 3600
        day = spark.range(1).select(stored_date(F.lit(1706659199).cast("long")).alias("d")).first().d
        assert str(day) == "2024-01-30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_ages(spark):
    b = 1508234400
    want = {
        b: 0, b - 1: 0, b + 1: -1, b - DAY: 1, b - 2 * DAY: 2, b - 3 * DAY: 3,
        b + 1 + DAY: -2, b + 1 + 2 * DAY: -3,
        b + DAY: -2,  # exact negative multiples come out one lower
    }
    df = spark.createDataFrame([(t,) for t in want], "t long")
    rows = df.withColumn("age", age_in_days(F.lit(b).cast("long"), F.col("t"))).collect()
    assert {r.t: r.age for r in rows} == want
