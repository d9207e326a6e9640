"""The start of the look-back window by zone and column type."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampType

from shelfwise.functions.columns import lookback_start


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda name: spark.conf.set("spark.sql.session.timeZone", name)
    spark.conf.set("spark.sql.session.timeZone", before)


def instant(spark, as_of):
    start = lookback_start(as_of, 1, TimestampType())
    return spark.range(1).select(F.unix_timestamp(start).alias("s")).first()["s"]


def test_a_moment_with_a_zone_is_that_instant(spark, zone):
    noon_in_tokyo = datetime(2024, 1, 31, 12, tzinfo=timezone(timedelta(hours=9)))
    want = int(datetime(2024, 1, 30, 3, tzinfo=timezone.utc).timestamp())
    for name in ("UTC", "Asia/Seoul"):
        zone(name)
        assert instant(spark, noon_in_tokyo) == want


def test_a_moment_without_a_zone_is_local_to_the_session(spark, zone):
    for name, hours in (("UTC", 0), ("Asia/Seoul", 9)):
        zone(name)
        want = datetime(2024, 1, 30, 12, tzinfo=timezone(timedelta(hours=hours))).timestamp()
        assert instant(spark, datetime(2024, 1, 31, 12)) == int(want)


def test_dates_are_midnights(spark):
    def first(as_of):
        return spark.range(1).select(lookback_start(as_of, 1, DateType()).alias("d")).first()["d"]

    assert first(datetime(2024, 1, 31)) == date(2024, 1, 30)
    assert first(datetime(2024, 1, 31, 12)) == date(2024, 1, 31)
