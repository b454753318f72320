from datetime import datetime, timedelta

import pytest

from causalframe.sources.dataset import Dataset, Metadata
from causalframe.sources import store as stores
from causalframe.sources.store import DocumentStore, MemoryStore, ParquetStore, create_store, register_store
from causalframe.time import TimeRange, timestamp

T0 = datetime(2021, 1, 1)


def at(n):
    return timestamp(T0 + timedelta(days=n))


class FakeCollection:
    def __init__(self):
        self.rows = {}

    def find_one(self, query):
        return self.rows.get(query["_id"])

    def find(self, query):
        return list(self.rows.values())

    def replace_one(self, query, row, upsert):
        assert upsert
        self.rows[query["_id"]] = row

    def delete_one(self, query):
        self.rows.pop(query["_id"], None)


class FakeClient:
    """One database, as all connections of a test see it."""

    def __init__(self):
        self.collection = FakeCollection()

    def __call__(self):
        return {"causalframe": {"datasets": self.collection}}


@pytest.fixture(params=["memory", "parquet", "document"])
def store(request, spark, tmp_path):
    root = f"file://{tmp_path}/store"
    return {"memory": MemoryStore, "parquet": lambda: ParquetStore(spark, root), "document": lambda: DocumentStore(spark, root, FakeClient())}[request.param]()


def rows(spark, first, n, value=1.0, columns=("A", "B")):
    data = [(T0 + timedelta(days=first + i), *[value] * len(columns)) for i in range(n)]
    return spark.createDataFrame(data, "ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))


def meta(store, name="leaf", foo=1.0, **more):
    return Metadata(name, {"foo": foo, "bar": "x"}, store=store, **more)


def test_insert_read_replace(spark, store):
    m = meta(store)
    assert not m.exists() and m.read() is None and m.get_dataset() is None and m.data_time_range() is None
    assert m.idempotent_insert(rows(spark, 0, 10), TimeRange(at(0), at(10))) is False
    assert m.idempotent_insert(rows(spark, 5, 1), TimeRange(at(5), at(6))) is True
    assert m.read().count() == 10
    assert m.read(TimeRange(at(2), at(4))).count() == 2
    assert m.read(TimeRange(at(50), at(60))).count() == 0
    assert m.data_time_range() == TimeRange(at(0), at(9) + timedelta(microseconds=1))
    assert m.declared_time_range() == TimeRange(at(0), at(10))
    assert m.replace(rows(spark, 3, 2, 7.0), TimeRange(at(3), at(5))) is True
    assert [r.A for r in m.read().collect()] == [7.0, 7.0]


def test_append_keeps_history(spark, store):
    m = meta(store)
    m.append(rows(spark, 0, 10), TimeRange(at(0), at(10)))
    m.append(rows(spark, 5, 7, 1.1), TimeRange(at(5), at(12)))
    got = [r.A for r in m.read().orderBy("ts").collect()]
    assert got == [1.0] * 10 + [1.1] * 2
    assert m.declared_time_range() == TimeRange(at(0), at(12))
    # Nothing newer: nothing changes, the declared range neither.
    m.append(rows(spark, 0, 3, 9.0), TimeRange(at(0), at(40)))
    assert m.declared_time_range().end == at(12)
    store.append(Dataset(m, rows(spark, 0, 3, 9.0), TimeRange(at(0), at(40))), extend_declared_on_empty=True)
    assert m.declared_time_range().end == at(40)
    m.append(rows(spark, 20, 1, 2.0, ("A", "C")), TimeRange(at(20), at(41)))
    last = m.read().orderBy("ts").collect()[-1]
    assert (last.A, last.B, last.C) == (2.0, None, 2.0)


def test_merge_fills_gaps(spark, store):
    m = meta(store)
    holes = spark.createDataFrame([(T0 + timedelta(days=i), None if i == 1 else 1.0, 1.0) for i in range(4)], "ts timestamp_ntz, A double, B double")
    m.merge(holes, TimeRange(at(0), at(4)))
    assert m.merge(rows(spark, 1, 5, 5.0), TimeRange(at(1), at(6))) is True
    assert [(r.A, r.B) for r in m.read().orderBy("ts").collect()] == [(1.0, 1.0), (5.0, 1.0), (1.0, 1.0), (1.0, 1.0), (5.0, 5.0), (5.0, 5.0)]
    assert m.declared_time_range() == TimeRange(at(0), at(6))
    with pytest.raises(ValueError, match="overlap"):
        m.merge(rows(spark, 6, 1), TimeRange(at(6), at(7)))


def test_static(spark, store):
    m = meta(store, static=True)
    df = spark.range(5)
    assert m.replace(df, None) is False and m.read().count() == 5
    for f in (lambda: m.append(df, None), lambda: m.merge(df, None), lambda: m.read(TimeRange(at(0), at(1))), m.data_time_range, m.declared_time_range):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(ValueError):
        Dataset(m, df, TimeRange(at(0), at(1)))
    with pytest.raises(ValueError):
        Dataset(meta(store), rows(spark, 0, 1), None)


def test_catalog(spark, store):
    leaves = {f: meta(store, foo=f) for f in (1.0, 2.0)}
    children = {f: Metadata("child", {"deep": [{"a": 1}]}, {"foo": leaves[f]}, "v2", store=store) for f in leaves}
    for m in (*leaves.values(), *children.values()):
        m.replace(rows(spark, 0, 2), TimeRange(at(0), at(2)))
    assert store.find(".*") == ["child", "leaf"] and store.find("l") == ["leaf"] and store.find("eaf") == []
    assert store.find(".*", "v2") == ["child"]
    assert store.scan("child", {"foo.foo": 2.0}) == {children[2.0]}
    assert store.scan("leaf") == set(leaves.values())
    with pytest.raises(ValueError):
        store.scan("leaf", {"nothing": 1})
    assert children[1.0].parameter("foo.bar") == "x" and children[1.0].parameter("version") == "v2"
    assert store.find_successors(leaves[1.0]) == {children[1.0]}
    assert store.predecessors_of("child", "v2", children[1.0].hash) == {"foo": leaves[1.0]}
    with pytest.raises(ValueError):
        store.predecessors_of("child", "v2", 1)
    datasets, edges = store.catalog(spark)
    assert datasets.count() == 4 and edges.count() == 2
    with pytest.raises(ValueError, match="successors"):
        store.delete(leaves[1.0])
    assert store.delete(leaves[1.0], recursive=True) is True and store.delete(leaves[1.0]) is False
    assert store.scan("child") == {children[2.0]}


def test_identity():
    a = Metadata("x", {"b": 1, "a": 2})
    assert a == Metadata("x", {"a": 2, "b": 1}) and a.hash == Metadata("x", {"a": 2, "b": 1}).hash
    assert a != Metadata("x", {"a": 2, "b": 1.5})
    p, q = Metadata("p"), Metadata("q")
    assert Metadata("x", {}, {"l": p, "r": q}) != Metadata("x", {}, {"l": q, "r": p})
    with pytest.raises(ValueError):
        Metadata("x", {"bad": None})


def test_state(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path))
    assert create_store(s.state(), spark) == s
    assert isinstance(create_store(MemoryStore().state(), spark), MemoryStore)
    with pytest.raises(ValueError):
        create_store({"type": "other"}, spark)
    register_store("other", lambda state, spark: MemoryStore())
    assert isinstance(create_store({"type": "other"}, spark), MemoryStore)
    client = FakeClient()
    document = DocumentStore(spark, str(tmp_path), client)
    meta(document).replace(rows(spark, 0, 2), TimeRange(at(0), at(2)))
    again = create_store(document.state(), spark)
    assert again.read(meta(again)).count() == 2


def test_merge_writes_the_days_it_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_SNAPSHOTS", 3)
    store = ParquetStore(spark, f"file://{tmp_path}/s")
    m = meta(store)
    m.append(rows(spark, 0, 10), TimeRange(at(0), at(10)))
    before = m.read()
    new = rows(spark, 4, 2, 5.0, ("C",))
    m.merge(new, TimeRange(at(4), at(6)))
    folder = tmp_path / "s" / "no_version"
    (own,) = folder.iterdir()
    names = sorted(p.name for p in own.glob("_snapshot=*"))
    assert sorted(len(list((own / n).glob("_day=*"))) for n in names) == [2, 10]
    # What was read before the merge is still there.
    assert before.count() == 10 and m.read().count() == 10
    assert [(r.A, r.C) for r in m.read(TimeRange(at(3), at(7))).orderBy("ts").collect()] == [(1.0, None), (1.0, 5.0), (1.0, 5.0), (1.0, None)]
    for k in range(8):
        m.merge(rows(spark, 4 + k, 2, 6.0 + k, ("D",)), TimeRange(at(4), at(20)))
        assert len(store.lookup(m)["snapshots"]) <= 3
    got = {r.ts.day - 1: (r.A, r.C, r.D) for r in m.read().collect()}
    assert got[4] == (1.0, 5.0, 6.0) and got[5] == (1.0, 5.0, 6.0) and got[6] == (1.0, None, 7.0) and got[12] == (None, None, 13.0) and len(got) == 13
    for k in range(2):
        m.append(rows(spark, 30 + k, 1), TimeRange(at(0), at(40)))
    assert m.read().count() == 15 and len(list(own.glob("_snapshot=*"))) <= 7


def test_ranges_prune_days(spark, tmp_path):
    m = meta(ParquetStore(spark, f"file://{tmp_path}/s"))
    m.append(rows(spark, 0, 10), TimeRange(at(0), at(10)))
    plan = m.read(TimeRange(at(2), at(4)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan and "PushedFilters: [IsNotNull(ts)" in plan
