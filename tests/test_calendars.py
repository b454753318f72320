from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from causalframe.calendars import Days, OffsetCalendar, TimeOfDayCalendar, UnionCalendar, missing_points
from causalframe.time import UTC, TimeOfDay, TimeRange, timestamp, utc_wall

ZONES = ["UTC", "Europe/London", "America/New_York", "Pacific/Pago_Pago"]


def points(calendar, spark, time_range):
    return [r.ts for r in calendar.to_df(spark, time_range).orderBy("ts").collect()]


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("mask", ["1111100", "1001000", "0000110", "0000100"])
def test_latest_point_is_last_of_index(spark, zone, mask):
    c = TimeOfDayCalendar(TimeOfDay.from_str(f"15:45 {zone}"), Days(mask))
    for as_of in (timestamp("2022-04-28 15:45:00"), timestamp("2022-05-01 03:00:00 [America/New_York]")):
        found = points(c, spark, TimeRange(as_of - timedelta(days=14), as_of))
        assert found[-1] == utc_wall(c.latest_point_before(as_of))


def test_strictly_before_and_holidays(spark):
    tod = TimeOfDay.from_str("12:00")
    c = TimeOfDayCalendar(tod)
    noon = datetime(2022, 5, 3, 12, tzinfo=UTC)
    assert c.latest_point_before(noon) == noon - timedelta(days=1)
    assert c.latest_point_before(noon + timedelta(microseconds=1)) == noon
    off = TimeOfDayCalendar(tod, Days(holidays=frozenset({date(2022, 5, 2)})))
    assert utc_wall(off.latest_point_before(noon)) == datetime(2022, 4, 29, 12)
    assert datetime(2022, 5, 2, 12) not in points(off, spark, TimeRange(datetime(2022, 4, 28), datetime(2022, 5, 6)))
    with pytest.raises(ValueError, match="within"):
        TimeOfDayCalendar(tod, maximum_interval=timedelta(hours=3)).latest_point_before(noon - timedelta(hours=1))


def test_offsets(spark):
    c = OffsetCalendar(timedelta(minutes=5))
    as_of = datetime(2022, 5, 1, 10, 5, tzinfo=UTC)
    assert c.latest_point_before(as_of) == as_of - timedelta(minutes=5)
    found = points(c, spark, TimeRange(as_of, as_of + timedelta(minutes=20)))
    assert found == [utc_wall(as_of) + timedelta(minutes=5 * i) for i in range(4)]
    kolkata = datetime(2022, 5, 1, 12, 33, tzinfo=ZoneInfo("Asia/Kolkata"))
    assert OffsetCalendar(timedelta(hours=1)).latest_point_before(kolkata).hour == 12
    with pytest.raises(ValueError):
        OffsetCalendar(timedelta(minutes=7))


def test_points_do_not_depend_on_the_session_zone(spark):
    r = TimeRange(datetime(2022, 3, 26), datetime(2022, 3, 28))
    before = points(OffsetCalendar(timedelta(hours=6)), spark, r)
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        assert points(OffsetCalendar(timedelta(hours=6)), spark, r) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_union_is_flat(spark):
    a, b, c = (OffsetCalendar(timedelta(hours=h)) for h in (1, 2, 3))
    u = UnionCalendar.merge([UnionCalendar.merge([a, b]), c])
    assert u.calendars == frozenset({a, b, c})
    assert UnionCalendar.merge([a, a]) == a
    r = TimeRange(datetime(2022, 1, 1), datetime(2022, 1, 1, 6))
    assert points(u, spark, r) == points(a, spark, r)
    assert u.latest_point_before(r.end) == a.latest_point_before(r.end)


def test_missing_points(spark):
    c = OffsetCalendar(timedelta(hours=1)).to_df(spark, TimeRange(datetime(2022, 1, 1), datetime(2022, 1, 1, 3)))
    data = spark.sql("select timestamp_ntz '2022-01-01 01:00:00' as t")
    assert [r.ts.hour for r in missing_points(c, data, "t").orderBy("ts").collect()] == [0, 2]
