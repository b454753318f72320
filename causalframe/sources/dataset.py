"""Datasets and what identifies them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from causalframe.functions.hashing import Frozen, normalize, stable_hash
from causalframe.time import TimeRange

if TYPE_CHECKING:
    from causalframe.sources.store import Store


@dataclass(frozen=True, eq=False)
class Metadata:
    """Name, version, parameters and predecessors: the identity of a dataset is a hash of
    all of these, predecessors by their names and own hashes. Where it is kept is not part of it."""

    name: str
    params: Frozen = field(default_factory=Frozen)
    predecessors: Frozen = field(default_factory=Frozen)
    version: str = "no_version"
    static: bool = False
    time_col: str | None = "ts"
    store: Store | None = field(default=None, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "params", normalize(self.params))
        object.__setattr__(self, "predecessors", Frozen(self.predecessors))
        if self.static:
            object.__setattr__(self, "time_col", None)
        elif not self.time_col:
            raise ValueError("a time series has a time column")
        parts = [self.name, self.static, self.time_col, self.version, self.params]
        parts += [(k, self.predecessors[k].hash) for k in sorted(self.predecessors)]
        object.__setattr__(self, "hash", stable_hash(parts))

    def __hash__(self):
        return self.hash

    def __eq__(self, other):
        return isinstance(other, Metadata) and self.hash == other.hash and self.name == other.name and self.version == other.version

    def parameter(self, name: str):
        """A parameter, or one of name, version, static, time_col; a dotted name looks in predecessors."""
        head, _, rest = name.partition(".")
        if rest:
            if head not in self.predecessors:
                raise ValueError(f"{self.name} has no predecessor {head!r}")
            return self.predecessors[head].parameter(rest)
        if head in self.params:
            return self.params[head]
        if head in ("name", "version", "static", "time_col"):
            return getattr(self, head)
        raise ValueError(f"{self.name} has no parameter {head!r}")

    def is_immediate_predecessor(self, other: Metadata) -> bool:
        """Whether this is a direct predecessor of other."""
        return self in other.predecessors.values()

    # What the store does, for this dataset.
    def exists(self) -> bool:
        return self.store.exists(self)

    def read(self, time_range: TimeRange | None = None) -> DataFrame | None:
        return self.store.read(self, time_range)

    def get_dataset(self, time_range: TimeRange | None = None) -> Dataset | None:
        return self.store.get_dataset(self, time_range)

    def data_time_range(self) -> TimeRange | None:
        return self.store.data_time_range(self)

    def declared_time_range(self) -> TimeRange | None:
        return self.store.declared_time_range(self)

    def replace(self, data: DataFrame, declared: TimeRange | None) -> bool:
        return self.store.replace(Dataset(self, data, declared))

    def idempotent_insert(self, data: DataFrame, declared: TimeRange | None) -> bool:
        return self.store.idempotent_insert(Dataset(self, data, declared))

    def append(self, data: DataFrame, declared: TimeRange) -> bool:
        return self.store.append(Dataset(self, data, declared))

    def merge(self, data: DataFrame, declared: TimeRange) -> bool:
        return self.store.merge(Dataset(self, data, declared))


@dataclass(frozen=True)
class Dataset:
    """Metadata, lazy data, and the range for which the data was declared complete."""

    metadata: Metadata
    data: DataFrame
    declared: TimeRange | None = None

    def __post_init__(self):
        if self.metadata.static and self.declared is not None:
            raise ValueError("a static dataset has no time range")
        if not self.metadata.static and self.declared is None:
            raise ValueError("a time series has a declared time range")
        if not self.metadata.static and self.metadata.time_col not in self.data.columns:
            raise ValueError(f"no time column {self.metadata.time_col}")

    def data_range(self) -> TimeRange:
        """One job; an error without rows."""
        return TimeRange.of(self.data, self.metadata.time_col)

    def update(self, data: DataFrame, declared: TimeRange | None) -> Dataset:
        return Dataset(self.metadata, data, declared)

    def replace_store(self, store: Store) -> Dataset:
        return replace(self, metadata=replace(self.metadata, store=store))

    @staticmethod
    def build(name: str, data: DataFrame, params=None, predecessors=None, version: str = "no_version", static: bool = False, time_col: str = "ts", declared: TimeRange | None = None, store: Store | None = None) -> Dataset:
        """A dataset whose declared range is that of its data unless given."""
        metadata = Metadata(name, params or {}, predecessors or {}, version, static, time_col, store)
        if not static and declared is None:
            declared = TimeRange.of(data, time_col)
        return Dataset(metadata, data, declared)
