"""Calendars: the timestamps at which a series is expected to have a row."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.time import RESOLUTION, UTC, TimeOfDay, TimeRange, utc_wall


class Calendar(ABC):
    """latest_point_before is a value of the driver; to_df gives all points of a range,
    made on the executors, in column ts."""

    @abstractmethod
    def latest_point_before(self, as_of: datetime) -> datetime:
        """The last point strictly before as_of."""

    @abstractmethod
    def to_df(self, spark: SparkSession, time_range: TimeRange) -> DataFrame: ...


@dataclass(frozen=True)
class Days:
    """Days by a mask from Monday on, without holidays."""

    weekmask: str = "1111100"
    holidays: frozenset[date] = frozenset()

    def __post_init__(self):
        if len(self.weekmask) != 7 or set(self.weekmask) - {"0", "1"} or "1" not in self.weekmask:
            raise ValueError(f"a week mask has seven digits 0 or 1 and one 1 at least: {self.weekmask!r}")
        object.__setattr__(self, "holidays", frozenset(self.holidays))

    def __contains__(self, day: date) -> bool:
        return self.weekmask[day.weekday()] == "1" and day not in self.holidays


@dataclass(frozen=True)
class TimeOfDayCalendar(Calendar):
    """A time of day on every day of `days`."""

    time_of_day: TimeOfDay
    days: Days = field(default_factory=Days)
    maximum_interval: timedelta = timedelta(days=7)

    def latest_point_before(self, as_of: datetime) -> datetime:
        day = as_of.astimezone(ZoneInfo(self.time_of_day.zone)).date()
        first = (as_of - self.maximum_interval).astimezone(UTC)
        for back in range(self.maximum_interval.days + 3):
            now = day - timedelta(days=back)
            if now in self.days and first <= (point := self.time_of_day.on(now)) < as_of:
                return point
        raise ValueError(f"no point of the calendar lies within {self.maximum_interval} before {as_of}")

    def to_df(self, spark: SparkSession, time_range: TimeRange) -> DataFrame:
        zone = ZoneInfo(self.time_of_day.zone)
        # Two days on either side cover any shift between the zone and UTC.
        first = time_range.start.astimezone(zone).date() - timedelta(days=2)
        n = (time_range.end.astimezone(zone).date() + timedelta(days=2) - first).days + 1
        days = spark.range(n).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
        days = days.where(F.substring(F.lit(self.days.weekmask), 1, 7).substr(F.weekday("day") + 1, F.lit(1)) == "1")
        if self.days.holidays:
            off = spark.createDataFrame([(d,) for d in sorted(self.days.holidays)], "day date")
            days = days.join(off, "day", "left_anti")
        points = days.select(self.time_of_day.column(F.col("day")).alias("ts"))
        return points.where(time_range.predicate("ts"))


@dataclass(frozen=True)
class OffsetCalendar(Calendar):
    """Every multiple of an offset that divides the day, counted from local midnight."""

    offset: timedelta

    def __post_init__(self):
        if self.offset <= timedelta(0) or timedelta(days=1) % self.offset:
            raise ValueError(f"an offset divides one day evenly, {self.offset} does not")

    def latest_point_before(self, as_of: datetime) -> datetime:
        before = as_of.astimezone(UTC) - RESOLUTION
        local = before.astimezone(as_of.tzinfo)
        midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
        return midnight + (local - midnight) // self.offset * self.offset

    def to_df(self, spark: SparkSession, time_range: TimeRange) -> DataFrame:
        first = self.latest_point_before(time_range.start) + self.offset
        n = max(0, -((first - time_range.end) // self.offset))
        step = int(self.offset / timedelta(microseconds=1))
        start = utc_wall(first)
        # A range of ids is split over tasks, unlike one exploded sequence.
        base = int((start - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        moment = F.timestamp_micros(F.lit(base) + F.col("id") * step)
        return spark.range(n).select(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), _ntz(moment)).alias("ts")).where(time_range.predicate("ts"))


def _ntz(moment):
    """A timestamp as UTC wall time, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


@dataclass(frozen=True)
class UnionCalendar(Calendar):
    """All points of several calendars."""

    calendars: frozenset[Calendar]

    def __post_init__(self):
        object.__setattr__(self, "calendars", frozenset(self.calendars))

    @staticmethod
    def merge(calendars: Iterable[Calendar]) -> Calendar:
        """A union without unions in it; one calendar stays itself."""
        flat = set()
        for c in calendars:
            flat |= c.calendars if isinstance(c, UnionCalendar) else {c}
        if not flat:
            raise ValueError("a union of no calendars")
        return next(iter(flat)) if len(flat) == 1 else UnionCalendar(frozenset(flat))

    def latest_point_before(self, as_of: datetime) -> datetime:
        return max(c.latest_point_before(as_of) for c in self.calendars)

    def to_df(self, spark: SparkSession, time_range: TimeRange) -> DataFrame:
        found = None
        for c in self.calendars:
            points = c.to_df(spark, time_range)
            found = points if found is None else found.union(points)
        return found.distinct()


def missing_points(points: DataFrame, data: DataFrame, time_col: str = "ts") -> DataFrame:
    """Expected points without a row of data."""
    return points.join(data.select(F.col(time_col).alias("ts")).distinct(), "ts", "left_anti")
