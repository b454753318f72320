from datetime import date, datetime, timedelta

import pytest

from causalframe.time import RESOLUTION, UTC, TimeOfDay, TimeRange, timestamp, utc_wall


def test_timestamps():
    assert timestamp("2024-01-05") == datetime(2024, 1, 5, tzinfo=UTC)
    ny = timestamp("2024-07-01 09:30:00 [America/New_York]")
    assert utc_wall(ny) == datetime(2024, 7, 1, 13, 30)
    assert timestamp(datetime(2024, 1, 1)).tzinfo is UTC
    with pytest.raises(ValueError):
        timestamp(5)


def test_range_bounds_and_text():
    r = TimeRange(timestamp("2024-01-01"), timestamp("2024-01-02 [America/New_York]"))
    assert TimeRange.from_string(repr(r)) == r
    assert r.start in r and r.end not in r
    with pytest.raises(ValueError):
        TimeRange(timestamp("2024-01-02"), timestamp("2024-01-02"))
    with pytest.raises(ValueError):
        TimeRange.from_string("TimeRange(1, 2)")


def day(n):
    return datetime(2024, 1, n, tzinfo=UTC)


@pytest.mark.parametrize(
    "other, meets, inside",
    [((3, 5), True, True), ((2, 4), True, True), ((4, 6), True, True), ((6, 8), False, False), ((7, 9), False, False), ((1, 9), True, False), ((1, 3), True, False), ((5, 8), True, False)],
)
def test_interval_algebra(other, meets, inside):
    base, o = TimeRange(day(2), day(6)), TimeRange(day(other[0]), day(other[1]))
    assert base.intersects(o) is meets and o.intersects(base) is meets
    assert base.contains(o) is inside
    if meets:
        assert base.union(o) == TimeRange(min(base.start, o.start), max(base.end, o.end)) == o.union(base)
        assert base.intersection(o) == TimeRange(max(base.start, o.start), min(base.end, o.end))
    else:
        for f in (base.union, base.intersection):
            with pytest.raises(ValueError):
                f(o)


def test_range_of_data(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 10:00:00' as ts union all select timestamp_ntz '2024-01-03'")
    r = TimeRange.of(df, "ts")
    assert r == TimeRange(datetime(2024, 1, 1, 10), datetime(2024, 1, 3) + RESOLUTION)
    assert r.view(df, "ts").count() == 2
    assert TimeRange(None, datetime(2024, 1, 3)).view(df, "ts").count() == 1
    with pytest.raises(ValueError):
        TimeRange.of(df.where("false"), "ts")


@pytest.mark.parametrize("text", ["15:45", "15:45:01", "15:45:01.25 Europe/London"])
def test_time_of_day_text(text):
    t = TimeOfDay.from_str(text)
    assert TimeOfDay.from_str(repr(t)) == t


def test_time_of_day_daylight_saving():
    t = TimeOfDay.from_str("02:30 America/New_York")
    assert t.on(date(2024, 3, 9)).utcoffset() == timedelta(hours=-5)
    for bad in (date(2024, 3, 10),):
        with pytest.raises(ValueError, match="does not exist"):
            t.on(bad)
    with pytest.raises(ValueError, match="ambiguous"):
        TimeOfDay.from_str("01:30 America/New_York").on(date(2024, 11, 3))
    with pytest.raises(ValueError):
        TimeOfDay.from_str("25h")


def test_intervals_of_rows_are_ranges(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from causalframe.time import Interval, TimeRange, utc_wall

    moments = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(4)]
    spans = [(a, b) for a in moments for b in moments if a < b]
    rows = [(*a, *b) for a in spans for b in spans]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, d timestamp_ntz")
    x, y = Interval(F.col("a"), F.col("b")), Interval(F.col("c"), F.col("d"))
    both, either = x.intersection(y), x.union(y)
    found = df.select("*", x.intersects(y).alias("i"), x.contains(y).alias("k"), x.holds(y.start).alias("h"), both.start.alias("s"), both.end.alias("e"), either.start.alias("t"), either.end.alias("f")).collect()
    assert len(found) == len(rows)
    for r in found:
        p, q = TimeRange(r.a, r.b), TimeRange(r.c, r.d)
        meet = p.intersects(q)
        assert (r.i, r.k, r.h) == (meet, p.contains(q), q.start in p)
        want = [utc_wall(v) for v in (p.intersection(q).start, p.intersection(q).end, p.union(q).start, p.union(q).end)] if meet else [None] * 4
        assert [r.s, r.e, r.t, r.f] == want
