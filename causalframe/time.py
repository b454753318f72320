"""Time values on the driver: timestamps, half-open ranges, times of day.

Columns hold TIMESTAMP_NTZ in UTC wall time at microsecond resolution; the values
here carry their zone and turn into such literals when they meet a column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UTC = ZoneInfo("UTC")
RESOLUTION = timedelta(microseconds=1)
#: Stand-ins for an open start and end.
FIRST = datetime(1677, 9, 21, 0, 12, 43, 145225, tzinfo=UTC)
LAST = datetime(2262, 4, 11, 23, 47, 16, 854775, tzinfo=UTC)

_ZONED = re.compile(r"^\s*(?P<body>[^\[\]]+?)\s*(?:\[(?P<zone>[^\[\]]+)\])?\s*$")


def timestamp(value: str | datetime | date) -> datetime:
    """An aware datetime. Naive input is UTC; text may end in a zone name in brackets."""
    if isinstance(value, str):
        m = _ZONED.match(value)
        if not m:
            raise ValueError(f"not a timestamp: {value!r}")
        found = datetime.fromisoformat(m["body"])
        zone = ZoneInfo(m["zone"]) if m["zone"] else UTC
        if m["zone"] and found.tzinfo:
            return found.astimezone(zone)
        return found if found.tzinfo else found.replace(tzinfo=zone)
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    raise ValueError(f"a timestamp is made of text or a datetime, not {type(value).__name__}")


def utc_wall(value: datetime) -> datetime:
    """Naive UTC wall time, as stored in columns."""
    return value.astimezone(UTC).replace(tzinfo=None)


def literal(value: datetime) -> Column:
    return F.lit(utc_wall(value).isoformat(sep=" ")).cast("timestamp_ntz")


def _shown(value: datetime) -> str:
    zone = getattr(value.tzinfo, "key", None)
    return f"{value.replace(tzinfo=None).isoformat(sep=' ')} [{zone}]" if zone else value.isoformat(sep=" ")


@dataclass(frozen=True)
class TimeRange:
    """[start, end): None stands for the first or last timestamp."""

    start: datetime = None
    end: datetime = None

    def __post_init__(self):
        object.__setattr__(self, "start", FIRST if self.start is None else timestamp(self.start))
        object.__setattr__(self, "end", LAST if self.end is None else timestamp(self.end))
        if self.start >= self.end:
            raise ValueError(f"a range ends after its start, not {self.start} .. {self.end}")

    def predicate(self, column: str | Column) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return (c >= literal(self.start)) & (c < literal(self.end))

    def view(self, df: DataFrame, time_col: str, day_col: str | None = None) -> DataFrame:
        """Rows in the range. With day_col (a date partition of the table) that column is
        bounded too, since bounds on the time do not prune partitions by themselves."""
        found = df.where(self.predicate(time_col))
        if day_col:
            last = utc_wall(self.end) - RESOLUTION
            found = found.where(F.col(day_col).between(F.lit(utc_wall(self.start).date()), F.lit(last.date())))
        return found

    @staticmethod
    def of(df: DataFrame, time_col: str) -> TimeRange:
        """From the first to just after the last timestamp."""
        low, high = df.agg(F.min(time_col), F.max(time_col)).first()
        if low is None:
            raise ValueError("no rows: the range of nothing is undefined")
        return TimeRange(timestamp(low), timestamp(high) + RESOLUTION)

    def intersects(self, other: TimeRange) -> bool:
        return self.start < other.end and other.start < self.end

    def contains(self, other: TimeRange) -> bool:
        return self.start <= other.start and other.end <= self.end

    def union(self, other: TimeRange) -> TimeRange:
        self._must_meet(other)
        return TimeRange(min(self.start, other.start), max(self.end, other.end))

    def intersection(self, other: TimeRange) -> TimeRange:
        self._must_meet(other)
        return TimeRange(max(self.start, other.start), min(self.end, other.end))

    def _must_meet(self, other: TimeRange) -> None:
        if not self.intersects(other):
            raise ValueError(f"{self} and {other} do not overlap")

    def __contains__(self, moment: datetime) -> bool:
        return self.start <= moment < self.end

    def __repr__(self) -> str:
        return f"TimeRange('{_shown(self.start)}', '{_shown(self.end)}')"

    @staticmethod
    def from_string(text: str) -> TimeRange:
        m = re.fullmatch(r"TimeRange\('([^']*)',\s*'([^']*)'\)", text.strip())
        if not m:
            raise ValueError(f"not a time range: {text!r}")
        return TimeRange(timestamp(m[1]), timestamp(m[2]))


@dataclass(frozen=True)
class Interval:
    """A half-open range of a row, in two columns; `TimeRange` for tables of ranges."""

    start: Column
    end: Column

    @staticmethod
    def spanned(column: str | Column) -> Interval:
        """The range of a group's times: aggregates."""
        return Interval(F.min(column), F.max(column) + F.expr("INTERVAL '0.000001' SECOND"))

    def intersects(self, other: Interval) -> Column:
        return (self.start < other.end) & (other.start < self.end)

    def contains(self, other: Interval) -> Column:
        return (self.start <= other.start) & (other.end <= self.end)

    def holds(self, moment: Column) -> Column:
        return (self.start <= moment) & (moment < self.end)

    def union(self, other: Interval) -> Interval:
        """The range from the first start to the last end; null unless they meet."""
        return self._met(other, F.least(self.start, other.start), F.greatest(self.end, other.end))

    def intersection(self, other: Interval) -> Interval:
        return self._met(other, F.greatest(self.start, other.start), F.least(self.end, other.end))

    def _met(self, other: Interval, start: Column, end: Column) -> Interval:
        meets = self.intersects(other)
        return Interval(F.when(meets, start), F.when(meets, end))


@dataclass(frozen=True)
class TimeOfDay:
    """A wall time in a zone."""

    time: time
    zone: str = "UTC"

    @staticmethod
    def from_str(text: str) -> TimeOfDay:
        body, _, zone = text.strip().partition(" ")
        if not re.fullmatch(r"\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?", body):
            raise ValueError(f"not a time of day: {text!r}")
        hour, minute, *rest = body.split(":")
        seconds, _, fraction = (rest[0] if rest else "0").partition(".")
        zone = zone.strip().strip("[]") or "UTC"
        ZoneInfo(zone)
        return TimeOfDay(time(int(hour), int(minute), int(seconds), int(fraction.ljust(6, "0")) if fraction else 0), zone)

    def on(self, day: date) -> datetime:
        """The moment on a day. Wall times that the zone skips or has twice are errors."""
        wall = datetime.combine(day, self.time, ZoneInfo(self.zone))
        if wall.astimezone(UTC).astimezone(wall.tzinfo).replace(tzinfo=None) != wall.replace(tzinfo=None):
            raise ValueError(f"{wall.replace(tzinfo=None)} does not exist in {self.zone}")
        if wall.utcoffset() != wall.replace(fold=1).utcoffset():
            raise ValueError(f"{wall.replace(tzinfo=None)} is ambiguous in {self.zone}")
        return wall

    def column(self, day: Column) -> Column:
        """The UTC wall time on a day column."""
        seconds = F.lit(self.time.second + self.time.microsecond / 1e6).cast("decimal(16,6)")
        wall = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(self.time.hour), F.lit(self.time.minute), seconds)
        return F.convert_timezone(F.lit(self.zone), F.lit("UTC"), wall)

    def __repr__(self) -> str:
        return f"{self.time.isoformat()} [{self.zone}]"
