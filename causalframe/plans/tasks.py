"""Tasks: functions from lazy DataFrames to a lazy DataFrame, with where their output goes
and when it is complete. A run builds one plan and has one action, the write."""

from __future__ import annotations

import inspect
import logging
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame

from causalframe.calendars import Calendar
from causalframe.functions.hashing import Frozen, freeze
from causalframe.sources.dataset import Metadata
from causalframe.sources.store import Store
from causalframe.time import TimeRange

Lookback = timedelta | Callable


class Checker(ABC):
    @abstractmethod
    def is_complete(self, metadata: Metadata, target: TimeRange) -> bool: ...


@dataclass(frozen=True)
class CalendarChecker(Checker):
    """Complete if there is data from the calendar's last point before the target's end on."""

    calendar: Calendar

    def is_complete(self, metadata, target):
        if not metadata.exists():
            return False
        expected = TimeRange(self.calendar.latest_point_before(target.end), target.end)
        return expected.intersects(metadata.data_time_range())


@dataclass(frozen=True)
class IrregularChecker(Checker):
    """Complete if the declared range reaches the target's end, whatever data there is."""

    def is_complete(self, metadata, target):
        if not metadata.exists():
            return False
        declared = metadata.declared_time_range()
        if not declared.intersects(target):
            raise ValueError(f"the declared range {declared} and the target {target} do not overlap")
        return declared.end >= target.end


@dataclass(frozen=True)
class Dependency:
    """A task whose output another reads, from `lookback` before its own range on. A lookback is
    a timedelta or a function from the range's start to an earlier time (a calendar's, say)."""

    task: Task
    lookback: Lookback | None = None
    inherit_frequency: bool | None = None

    def read(self, downstream: TimeRange | None = None, default_lookback: Lookback | None = None) -> DataFrame | None:
        if not self.task.time_series or downstream is None:
            return self.task.output.read()
        back = self.lookback if self.lookback is not None else default_lookback
        start = downstream.start
        if callable(back):
            start = back(start)
        elif back is not None:
            start = start - back
        return self.task.output.read(TimeRange(start, downstream.end))


@dataclass(frozen=True, eq=False)
class Task(ABC):
    """Equal tasks have equal outputs."""

    name: str
    function: Callable[..., DataFrame]
    store: Store
    version: str = "no_version"
    namespace: str | None = None
    scalars: Mapping[str, Any] = field(default_factory=Frozen)
    dependencies: Mapping[str, Dependency] = field(default_factory=Frozen)

    time_series = False

    def __post_init__(self):
        object.__setattr__(self, "scalars", freeze(self.scalars))
        object.__setattr__(self, "dependencies", Frozen(self.dependencies))
        # The function must take exactly these arguments.
        inspect.signature(self.function).bind(**self.scalars, **self.dependencies)

    @cached_property
    def output(self) -> Metadata:
        full = self.name if self.namespace is None else f"{self.namespace}.{self.name}"
        params = {k: v for k, v in self.scalars.items() if k != "time_range"}
        parents = {k: d.task.output for k, d in self.dependencies.items()}
        return Metadata(full, params, parents, self.version, not self.time_series, getattr(self, "time_col", None), self.store)

    def __eq__(self, other):
        return self.output == other.output if isinstance(other, Task) else NotImplemented

    def __hash__(self):
        return hash(self.output)

    @abstractmethod
    def complete(self) -> bool: ...

    @abstractmethod
    def run(self) -> None: ...


@dataclass(frozen=True, eq=False)
class StaticTask(Task):
    """Reads its dependencies whole and replaces its output."""

    def complete(self):
        return self.output.exists()

    def run(self):
        inputs = {k: _there(k, d.read()) for k, d in self.dependencies.items()}
        self.output.replace(self.function(**self.scalars, **inputs), None)


@dataclass(frozen=True, eq=False)
class TimeSeriesTask(Task):
    """Reads its dependencies from a lookback before its range on, clips what the function
    gives to the range, and appends it. With narrow, only what is newer than the output's last row is
    computed; the lookback must then cover all that a row depends on."""

    time_range: TimeRange = None
    checker: Checker = None
    time_col: str = "ts"
    default_lookback: Lookback | None = None
    narrow: bool = False

    time_series = True

    def complete(self):
        return self.checker.is_complete(self.output, self.time_range)

    def run(self):
        target = self.time_range
        if self.narrow and self.output.exists():
            done = self.output.data_time_range()
            if target.start < done.end < target.end:
                target = TimeRange(done.end, target.end)
        inputs = {k: _there(k, d.read(target, self.default_lookback)) for k, d in self.dependencies.items()}
        scalars = dict(self.scalars)
        if "time_range" in scalars and scalars["time_range"] == self.time_range:
            scalars["time_range"] = target
        found = self.function(**scalars, **inputs)
        self.output.append(target.view(found, self.time_col), self.time_range)
        if not self.complete():
            raise ValueError(f"{self.output.name} ran and wrote its output, but its checker does not find it complete")
        logging.getLogger(__name__).info("%s is complete", self.output.name)


def _there(name: str, data: DataFrame | None) -> DataFrame:
    if data is None:
        raise ValueError(f"dependency {name} has no data")
    return data
