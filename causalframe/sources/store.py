"""Stores: where datasets live, and the catalog that knows them.

`MemoryStore` keeps lazy DataFrames in a dictionary. `ParquetStore` keeps, under a root
that any file system of Spark's may hold, one folder for each dataset: immutable
snapshots of Parquet partitioned by day, and a catalog record (JSON) that names the
snapshots in use. A write first makes its files, then replaces the record, so readers
see the state before or after and never between. Appending adds a snapshot and leaves
history alone; merging adds one with the days that it changes and hides those days in
the others. Past `MOST_SNAPSHOTS` they are written anew as one. What a write replaces is
deleted by the write after it, so that frames read before stay good until then. There is
one writer for a dataset.

`DocumentStore` keeps the records in a document database instead, and the rows as above.
"""

from __future__ import annotations

import json
import re
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causalframe.functions.hashing import unfreeze
from causalframe.operators.reshape import combine_first
from causalframe.sources.dataset import Dataset, Metadata
from causalframe.time import RESOLUTION, TimeRange, timestamp, utc_wall

#: Partition columns of a dataset's rows.
SNAPSHOT, DAY = "_snapshot", "_day"
#: Snapshots of a dataset before they are written anew as one.
MOST_SNAPSHOTS = 50


class Store(ABC):
    """The contract of all stores. Subclasses keep records; what rows are merged how is here."""

    # ---- records
    @abstractmethod
    def lookup(self, metadata: Metadata) -> dict | None:
        """The record of a dataset: metadata, declared, data_range, and what read_record needs."""

    @abstractmethod
    def records(self) -> Iterable[dict]: ...

    @abstractmethod
    def read_record(self, record: dict, time_range: TimeRange | None) -> DataFrame: ...

    @abstractmethod
    def write(self, dataset: Dataset, data_range: TimeRange | None) -> None:
        """The whole dataset anew."""

    @abstractmethod
    def extend(self, dataset: Dataset, record: dict, new: DataFrame, data_range: TimeRange, declared: TimeRange) -> None:
        """Rows after all that are there."""

    @abstractmethod
    def remove(self, metadata: Metadata) -> None: ...

    @abstractmethod
    def state(self) -> dict:
        """What create_store needs to make this store again."""

    # ---- reads
    def exists(self, metadata: Metadata) -> bool:
        return self.lookup(metadata) is not None

    def read(self, metadata: Metadata, time_range: TimeRange | None = None) -> DataFrame | None:
        """Rows in the range, lazily; None if the dataset is not there."""
        if metadata.static and time_range is not None:
            raise ValueError("a static dataset has no time range to read")
        record = self.lookup(metadata)
        return None if record is None else self.read_record(record, time_range)

    def get_dataset(self, metadata: Metadata, time_range: TimeRange | None = None) -> Dataset | None:
        data = self.read(metadata, time_range)
        return None if data is None else Dataset(metadata, data, self.lookup(metadata)["declared"])

    def data_time_range(self, metadata: Metadata) -> TimeRange | None:
        """From the catalog, without reading data."""
        if metadata.static:
            raise ValueError("a static dataset has no time range")
        record = self.lookup(metadata)
        return record and record["data_range"]

    def declared_time_range(self, metadata: Metadata) -> TimeRange | None:
        if metadata.static:
            raise ValueError("a static dataset has no time range")
        record = self.lookup(metadata)
        return record and record["declared"]

    # ---- writes
    def replace(self, dataset: Dataset) -> bool:
        """Overwrites; whether there was something."""
        existed = self.exists(dataset.metadata)
        self.write(dataset, None if dataset.metadata.static else dataset.data_range())
        return existed

    def idempotent_insert(self, dataset: Dataset) -> bool:
        """Writes unless the dataset is there; whether it was."""
        existed = self.exists(dataset.metadata)
        if not existed:
            self.replace(dataset)
        return existed

    def append(self, dataset: Dataset, extend_declared_on_empty: bool = False) -> bool:
        """Adds rows later than all that are there; earlier ones are left out. Without later
        rows nothing changes, unless extend_declared_on_empty."""
        if dataset.metadata.static:
            raise ValueError("a static dataset cannot be appended to")
        record = self.lookup(dataset.metadata)
        if record is None:
            self.replace(dataset)
            return False
        on = dataset.metadata.time_col
        new = dataset.data.where(F.col(on) >= F.lit(utc_wall(record["data_range"].end).isoformat(sep=" ")).cast("timestamp_ntz"))
        low, high = new.agg(F.min(on), F.max(on)).first()
        end = max(record["declared"].end, dataset.declared.end)
        declared = TimeRange(record["declared"].start, end)
        if low is None:
            if extend_declared_on_empty:
                self.redeclare(record, declared)
            return True
        self.extend(dataset, record, new, TimeRange(record["data_range"].start, timestamp(high) + RESOLUTION), declared)
        return True

    @abstractmethod
    def redeclare(self, record: dict, declared: TimeRange) -> None: ...

    def merge(self, dataset: Dataset, keys: list[str] = ()) -> bool:
        """Union of rows and columns, existing values win where they are not null. Declared
        ranges must overlap. keys: the columns that with the time identify a row."""
        if dataset.metadata.static:
            raise ValueError("a static dataset cannot be merged into")
        record = self.lookup(dataset.metadata)
        if record is None:
            self.replace(dataset)
            return False
        declared = record["declared"].union(dataset.declared)
        own = dataset.data_range()
        data_range = TimeRange(min(record["data_range"].start, own.start), max(record["data_range"].end, own.end))
        self.combine(dataset, record, [*keys, dataset.metadata.time_col], data_range, declared)
        return True

    def combine(self, dataset: Dataset, record: dict, by: list[str], data_range: TimeRange, declared: TimeRange) -> None:
        """Existing rows and new ones, met by these columns."""
        both = combine_first(self.read_record(record, None), dataset.data, by)
        self.write(Dataset(dataset.metadata, both, declared), data_range)

    # ---- catalog queries
    def find(self, match: str, version: str | None = None) -> list[str]:
        """Distinct names that a pattern matches from their start, sorted."""
        pattern = re.compile(match)
        return sorted({m.name for m in self.datasets() if pattern.match(m.name) and version in (None, m.version)})

    def datasets(self) -> list[Metadata]:
        return [r["metadata"] for r in self.records()]

    def scan(self, name: str, params: dict | None = None) -> set[Metadata]:
        """Datasets of a name whose parameters (dotted ones of predecessors) have these values."""
        return {m for m in self.datasets() if m.name == name and all(m.parameter(k) == v for k, v in (params or {}).items())}

    def predecessors_of(self, name: str, version: str, hash_: int) -> dict[str, Metadata]:
        for m in self.datasets():
            if (m.name, m.version, m.hash) == (name, version, hash_):
                return dict(m.predecessors)
        raise ValueError(f"no dataset {name} {version} {hash_}")

    def find_successors(self, metadata: Metadata) -> set[Metadata]:
        return {m for m in self.datasets() if metadata.is_immediate_predecessor(m)}

    def delete(self, metadata: Metadata, recursive: bool = False) -> bool:
        """Deletes a dataset; with recursive all that is made of it first. Whether it was there."""
        successors = self.find_successors(metadata)
        if successors and not recursive:
            raise ValueError(f"{metadata.name} has successors: {', '.join(sorted(m.name for m in successors))}")
        for m in successors:
            self.delete(m, recursive=True)
        existed = self.exists(metadata)
        if existed:
            self.remove(metadata)
        return existed

    def catalog(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The catalog as tables: datasets (hash, name, version, static, params) and edges
        (child_hash, name, parent_hash)."""
        found = self.datasets()
        rows = [(m.hash, m.name, m.version, m.static, json.dumps(unfreeze(m.params), sort_keys=True)) for m in found]
        edges = [(m.hash, k, p.hash) for m in found for k, p in m.predecessors.items()]
        return (
            spark.createDataFrame(rows, "hash long, name string, version string, static boolean, params string"),
            spark.createDataFrame(edges, "child_hash long, name string, parent_hash long"),
        )


class MemoryStore(Store):
    """For tests and single sessions: lazy DataFrames by identity."""

    def __init__(self):
        self._records: dict[Metadata, dict] = {}

    def lookup(self, metadata):
        return self._records.get(metadata)

    def records(self):
        return list(self._records.values())

    def read_record(self, record, time_range):
        on = record["metadata"].time_col
        return record["data"] if time_range is None else time_range.view(record["data"], on)

    def write(self, dataset, data_range):
        self._records[dataset.metadata] = {"metadata": dataset.metadata, "declared": dataset.declared, "data_range": data_range, "data": dataset.data}

    def extend(self, dataset, record, new, data_range, declared):
        data = record["data"].unionByName(new, allowMissingColumns=True)
        self._records[dataset.metadata] = {**record, "declared": declared, "data_range": data_range, "data": data}

    def redeclare(self, record, declared):
        record["declared"] = declared

    def remove(self, metadata):
        del self._records[metadata]

    def state(self):
        return {"type": "memory"}


class ParquetStore(Store):
    """Snapshots and records under <root>/<version>/<name>_h<hash>/."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self):
        return {"type": "parquet", "root": self.root}

    def __eq__(self, other):
        return isinstance(other, ParquetStore) and self.root == other.root

    def __hash__(self):
        return hash(self.root)

    # Files go through Hadoop's file systems, so that a root may be in any store.
    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, metadata: Metadata) -> str:
        return f"{self.root}/{metadata.version}/{metadata.name}_h{metadata.hash}"

    def _load(self, path: str) -> dict:
        """A record is a small file: read on the driver, without a Spark job."""
        stream = self._fs(path).open(self._path(path))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, folder: str, record: dict) -> None:
        """Writes the record beside the one in use and renames it over that."""
        fs, new, now = self._fs(folder), self._path(f"{folder}/record.json.{uuid.uuid4().hex}"), self._path(f"{folder}/record.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, now, options)

    def _described(self, m: Metadata) -> dict:
        return {"name": m.name, "version": m.version, "static": m.static, "time_col": m.time_col, "params": unfreeze(m.params), "hash": m.hash, "predecessors": {k: self._described(p) for k, p in m.predecessors.items()}}

    def _metadata(self, d: dict) -> Metadata:
        m = Metadata(d["name"], d["params"], {k: self._metadata(p) for k, p in d["predecessors"].items()}, d["version"], d["static"], d["time_col"], self)
        if m.hash != d["hash"]:
            raise ValueError(f"the record of {m.name} does not match its hash")
        return m

    def _record(self, raw: dict) -> dict:
        ranges = {k: raw[k] and TimeRange.from_string(raw[k]) for k in ("declared", "data_range")}
        return {**raw, **ranges, "metadata": self._metadata(raw["metadata"])}

    def lookup(self, metadata):
        path = f"{self._folder(metadata)}/record.json"
        return self._record(self._load(path)) if self._fs(path).exists(self._path(path)) else None

    def records(self):
        found = self._fs(self.root).globStatus(self._path(f"{self.root}/*/*/record.json"))
        return [self._record(self._load(s.getPath().toString())) for s in (found or [])]

    def _commit(self, metadata: Metadata, snapshots: list[dict], stale: list[str], data_range, declared, schema: str) -> None:
        """snapshots: name, and days that later ones have instead (None: rows without a time)."""
        self._save(self._folder(metadata), {"metadata": self._described(metadata), "snapshots": snapshots, "stale": stale, "data_range": data_range and repr(data_range), "declared": declared and repr(declared), "schema": schema})

    def _write(self, folder: str, data: DataFrame, on: str | None) -> str:
        name = uuid.uuid4().hex
        if on is None:
            data.write.parquet(f"{folder}/{SNAPSHOT}={name}")
        else:
            # Sorted within tasks, so that row groups have narrow bounds of time; a day that
            # holds most rows is still split over several files.
            data.withColumn(DAY, F.to_date(on)).sortWithinPartitions(DAY, on).write.partitionBy(DAY).parquet(f"{folder}/{SNAPSHOT}={name}")
        return name

    def _drop(self, folder: str, names: list[str]) -> None:
        for s in names:
            self._fs(folder).delete(self._path(f"{folder}/{SNAPSHOT}={s}"), True)

    def write(self, dataset, data_range):
        folder, m = self._folder(dataset.metadata), dataset.metadata
        old = self.lookup(m)
        name = self._write(folder, dataset.data, m.time_col)
        stale = [s["name"] for s in old["snapshots"]] if old else []
        self._commit(m, [{"name": name, "without": []}], stale, data_range, dataset.declared, dataset.data.schema.json())
        self._drop(folder, old["stale"] if old else [])

    def _added(self, record: dict, snapshots: list[dict], new: DataFrame, data_range, declared) -> None:
        """One more snapshot; many of them become one."""
        m = record["metadata"]
        folder = self._folder(m)
        schema = self.read_record(record, None).unionByName(new, allowMissingColumns=True).schema.json()
        name = self._write(folder, new, m.time_col)
        snapshots, stale = [*snapshots, {"name": name, "without": []}], []
        if len(snapshots) > MOST_SNAPSHOTS:
            whole = self.read_record({**record, "snapshots": snapshots, "schema": schema}, None)
            stale = [s["name"] for s in snapshots]
            snapshots = [{"name": self._write(folder, whole, m.time_col), "without": []}]
        self._commit(m, snapshots, stale, data_range, declared, schema)
        self._drop(folder, record["stale"])

    def extend(self, dataset, record, new, data_range, declared):
        self._added(record, record["snapshots"], new, data_range, declared)

    def combine(self, dataset, record, by, data_range, declared):
        on = dataset.metadata.time_col
        days = sorted((r[0] for r in dataset.data.select(F.to_date(on)).distinct().collect()), key=str)
        touched = self._days(F.to_date(on), days)
        both = combine_first(self._stored(record, days), dataset.data.where(touched), by)
        hidden = [None if d is None else d.isoformat() for d in days]
        snapshots = [{**s, "without": sorted({*s["without"], *hidden}, key=str)} for s in record["snapshots"]]
        self._added(record, snapshots, both, data_range, declared)

    def redeclare(self, record, declared):
        self._commit(record["metadata"], record["snapshots"], record["stale"], record["data_range"], declared, record["schema"])

    @staticmethod
    def _days(day, days: list):
        """Whether a day column is one of these days (None: null)."""
        known = [d for d in days if d is not None]
        found = day.isin(known) if known else F.lit(False)
        return F.coalesce(found, F.lit(None in days))

    def _stored(self, record: dict, days: list | None = None) -> DataFrame:
        """The rows of a series, or of some days of it, with their day: one scan of all snapshots."""
        folder, m = self._folder(record["metadata"]), record["metadata"]
        schema = StructType.fromJson(json.loads(record["schema"]))
        for name, kind in ((SNAPSHOT, "string"), *(() if m.static else ((DAY, "date"),))):
            schema = schema.add(name, kind) if name not in schema.names else schema
        paths = [f"{folder}/{SNAPSHOT}={s['name']}" for s in record["snapshots"]]
        data = self.spark.read.schema(schema).option("basePath", folder).parquet(*paths)
        for s in record["snapshots"]:
            if s["without"]:
                hidden = self._days(F.col(DAY), [d and date.fromisoformat(d) for d in s["without"]])
                data = data.where((F.col(SNAPSHOT) != s["name"]) | ~hidden)
        data = data.drop(SNAPSHOT)
        return data if days is None else data.where(self._days(F.col(DAY), days)).drop(DAY)

    def read_record(self, record, time_range):
        m, data = record["metadata"], self._stored(record)
        if time_range is not None:
            data = time_range.view(data, m.time_col, DAY)
        return data.drop(DAY)

    def remove(self, metadata):
        folder = self._folder(metadata)
        self._fs(folder).delete(self._path(f"{folder}/record.json"), False)
        self._fs(folder).delete(self._path(folder), True)


class DocumentStore(ParquetStore):
    """Records as documents of a collection, rows as Parquet under a root. `client` makes a
    connection (it can be pickled, so that any process makes its own): an object whose
    client()[database][collection] has find_one, find, replace_one and delete_one, as public
    document databases' drivers have."""

    def __init__(self, spark: SparkSession, root: str, client, database: str = "causalframe", collection: str = "datasets"):
        super().__init__(spark, root)
        self.client, self.database, self.name = client, database, collection

    @property
    def _collection(self):
        return self.client()[self.database][self.name]

    def state(self):
        return {"type": "document", "root": self.root, "client": self.client, "database": self.database, "collection": self.name}

    def _save(self, folder, record):
        self._collection.replace_one({"_id": folder}, {"_id": folder, **json.loads(json.dumps(record))}, upsert=True)

    def lookup(self, metadata):
        found = self._collection.find_one({"_id": self._folder(metadata)})
        return found and self._record({k: v for k, v in found.items() if k != "_id"})

    def records(self):
        return [self._record({k: v for k, v in found.items() if k != "_id"}) for found in self._collection.find({})]

    def remove(self, metadata):
        folder = self._folder(metadata)
        self._collection.delete_one({"_id": folder})
        self._fs(folder).delete(self._path(folder), True)


_KINDS: dict[str, Callable[[dict, SparkSession], Store]] = {
    "memory": lambda state, spark: MemoryStore(),
    "parquet": lambda state, spark: ParquetStore(spark, state["root"]),
    "document": lambda state, spark: DocumentStore(spark, state["root"], state["client"], state["database"], state["collection"]),
}


def register_store(kind: str, make: Callable[[dict, SparkSession], Store]) -> None:
    """Makes create_store know the states of another kind of store."""
    _KINDS[kind] = make


def create_store(state: dict, spark: SparkSession) -> Store:
    if state["type"] not in _KINDS:
        raise ValueError(f"unknown store type {state['type']!r}")
    return _KINDS[state["type"]](state, spark)
