"""A context makes tasks and fills in what they leave open: version, store, range and
completion checker follow from their dependencies and from defaults."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from causalframe.calendars import UnionCalendar
from causalframe.plans.tasks import CalendarChecker, Checker, Dependency, IrregularChecker, Lookback, StaticTask, Task, TimeSeriesTask
from causalframe.sources.store import Store
from causalframe.time import TimeRange


class _Open:
    def __repr__(self):
        return "<inferred>"


INFER = _Open()


@dataclass(frozen=True)
class Defaults:
    """A checker is left out on purpose: it belongs to the leaf tasks."""

    version: str = INFER
    store: Store = INFER
    time_range: TimeRange = INFER


def infer_checker(dependencies: Mapping[str, Dependency]) -> Checker:
    """That of the dependencies that say they pass theirs on; if none says so, of all that do
    not refuse. Calendars are merged; a mixture with irregular ones is an error."""
    series = {k: d for k, d in dependencies.items() if d.task.time_series}
    chosen = {k for k, d in series.items() if d.inherit_frequency} or {k for k, d in series.items() if d.inherit_frequency is None}
    checkers = {k: series[k].task.checker for k in sorted(chosen)}
    if not checkers:
        raise ValueError("no dependency to take a completion checker from; give one")
    distinct = list(dict.fromkeys(checkers.values()))
    if len(distinct) == 1:
        return distinct[0]
    if all(isinstance(c, CalendarChecker) for c in distinct):
        return CalendarChecker(UnionCalendar.merge(c.calendar for c in distinct))
    regular = sorted(k for k, c in checkers.items() if isinstance(c, CalendarChecker))
    raise ValueError(f"completion checkers do not go together: {regular} follow calendars, {sorted(set(checkers) - set(regular))} do not; give one or set inherit_frequency")


def _known(dependencies: Mapping[str, Dependency], default, name: str) -> list:
    values = list(dict.fromkeys(getattr(d.task, name) for d in dependencies.values()))
    if default is not INFER and default not in values:
        values.append(default)
    if not values:
        raise ValueError(f"neither a dependency nor a default has a value for {name}; give one")
    return values


def infer_range(dependencies: Mapping[str, Dependency], default) -> TimeRange:
    """What all dependencies' ranges and the default have in common."""
    ranges = _known({k: d for k, d in dependencies.items() if d.task.time_series}, default, "time_range")
    return TimeRange(max(r.start for r in ranges), min(r.end for r in ranges))


def infer_one(dependencies: Mapping[str, Dependency], default, name: str):
    """The one value that is not the default, if there is one: so a branch of a graph differs
    from the rest by setting a value once."""
    values = _known(dependencies, default, name)
    others = [v for v in values if default is INFER or v != default]
    if len(others) > 1:
        raise ValueError(f"more than one value for {name} among the dependencies: {others}")
    return others[0] if others else values[0]


@dataclass(frozen=True)
class GraphContext:
    defaults: Defaults = Defaults()
    namespace: str | None = None

    def extend_namespace(self, namespace: str) -> GraphContext:
        return replace(self, namespace=namespace if self.namespace is None else f"{self.namespace}.{namespace}")

    def time_series_task(
        self,
        name: str,
        function: Callable[..., DataFrame],
        *,
        version: str = INFER,
        store: Store = INFER,
        time_range: TimeRange = INFER,
        time_col: str = "ts",
        default_lookback: Lookback | None = None,
        checker: Checker = INFER,
        narrow: bool = False,
        **arguments,
    ) -> TimeSeriesTask:
        """Tasks and Dependencies among the arguments are dependencies, the rest scalars. A
        function that has a parameter time_range (or another of the above) is given it."""
        scalars, dependencies = split_arguments(arguments)
        own = {
            "version": version if version is not INFER else infer_one(dependencies, self.defaults.version, "version"),
            "store": store if store is not INFER else infer_one(dependencies, self.defaults.store, "store"),
            "time_range": time_range if time_range is not INFER else infer_range(dependencies, self.defaults.time_range),
            "checker": checker if checker is not INFER else infer_checker(dependencies),
            "time_col": time_col,
            "default_lookback": default_lookback,
        }
        scalars |= _declared(function, {"name": name, **own}, arguments)
        return TimeSeriesTask(name=name, function=function, namespace=self.namespace, scalars=scalars, dependencies=dependencies, narrow=narrow, **own)

    def static_task(self, name: str, function: Callable[..., DataFrame], *, version: str = INFER, store: Store = INFER, **arguments) -> StaticTask:
        scalars, dependencies = split_arguments(arguments)
        own = {
            "version": version if version is not INFER else infer_one(dependencies, self.defaults.version, "version"),
            "store": store if store is not INFER else infer_one(dependencies, self.defaults.store, "store"),
        }
        scalars |= _declared(function, {"name": name, **own}, arguments)
        return StaticTask(name=name, function=function, namespace=self.namespace, scalars=scalars, dependencies=dependencies, **own)


def _declared(function: Callable, own: dict, given: dict) -> dict:
    return {k: own[k] for k in inspect.signature(function).parameters if k in own and k not in given}


def split_arguments(arguments: Mapping) -> tuple[dict, dict]:
    """Scalars and dependencies."""
    scalars, dependencies = {}, {}
    for k, v in arguments.items():
        if isinstance(v, Dependency):
            dependencies[k] = v
        elif isinstance(v, Task):
            dependencies[k] = Dependency(v)
        else:
            scalars[k] = v
    return scalars, dependencies
