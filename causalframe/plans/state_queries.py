"""Queries of what has a state: stores and their catalogs, streams, tasks and graphs.

Datasets of the catalog queries are the regions, the nations made of them, and the
suppliers' balances by nation: their names and parents are in the tables, so SQL can say
what every catalog query finds.
"""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.calendars import Days, OffsetCalendar, TimeOfDayCalendar
from causalframe.functions.hashing import freeze, normalize, positive, stable_hash, unfreeze
from causalframe.operators import reshape
from causalframe.plans.catalogue import _NEW, _OLD, CLOSE, KINDS, NEW_RANGE, _old_new, query, rounded, table
from causalframe.plans.context import Defaults, GraphContext, infer_range, split_arguments
from causalframe.plans.graph import Graph, GraphStatus, MultiThreadedRunner, SingleThreadedRunner
from causalframe.plans.scheduler import ScheduledRunner
from causalframe.plans.tasks import CalendarChecker, Dependency, IrregularChecker
from causalframe.sources.dataset import Dataset, Metadata
from causalframe.sources.scratch import scratch_root
from causalframe.sources.store import MemoryStore, ParquetStore, create_store
from causalframe.streaming.incremental import append_stream, bucketed, merge_stream, ready
from causalframe.time import RESOLUTION, TimeRange, timestamp, utc_wall
from causalframe.timeframe import check_unique, equals


def _rows(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -------------------------------------------------------------------------- stores
def _stored(spark, sf_dir, store=None) -> tuple[Metadata, DataFrame]:
    """The older half of the events in a store, and the newer one."""
    old, new = _old_new(spark, sf_dir)
    first = Dataset.build("events", old, store=store or ParquetStore(spark, scratch_root(spark)))
    first.metadata.store.replace(first)
    return first.metadata, new


_MERGED = f"WITH {_OLD}, {_NEW} SELECT coalesce(o.event_id, n.event_id) AS event_id, coalesce(o.ts, n.ts) AS ts, coalesce(o.value, n.value) AS value, n.event_type FROM old o FULL JOIN new n ON o.event_id = n.event_id AND o.ts = n.ts"


@query(_MERGED)
def store_merge(spark, sf_dir):
    """Existing values win where they are not null; only the days that the new rows have are written."""
    m, new = _stored(spark, sf_dir)
    m.store.merge(Dataset(m, new, NEW_RANGE), ["event_id"])
    return m.read()


@query(_MERGED)
def store_merge_memory(spark, sf_dir):
    m, new = _stored(spark, sf_dir, MemoryStore())
    m.store.merge(Dataset(m, new, NEW_RANGE), ["event_id"])
    return m.read()


@query(f"WITH {_OLD} SELECT event_id, ts, value FROM old")
def store_insert_once(spark, sf_dir):
    """A second insertion changes nothing; the store is made again from its state before the read."""
    m, new = _stored(spark, sf_dir)
    existed = m.idempotent_insert(new, NEW_RANGE)
    again = create_store(m.store.state(), spark)
    return again.read(m) if existed else new


_KIND_RANGES = "r AS (SELECT event_type, min(ts) AS s, max(ts) + INTERVAL 1 MICROSECOND AS e FROM events GROUP BY event_type)"


def _by_kind(spark, sf_dir, store) -> dict[str, Metadata]:
    """A dataset for each type of event."""
    found = {}
    for k in KINDS:
        d = Dataset.build("events", table(spark, sf_dir, "events").where(F.col("event_type") == k), {"kind": k}, store=store)
        store.replace(d)
        found[k] = d.metadata
    return found


@query(f"WITH {_KIND_RANGES} SELECT event_type, s AS data_start, e AS data_end, s AS declared_start, TIMESTAMP '2024-03-01' AS declared_end, true AS there FROM r")
def store_ranges(spark, sf_dir):
    """What the catalog knows of each dataset: ranges of data and of declarations. Nothing newer
    comes with the second declaration, which moves the declared end alone."""
    store, rows = MemoryStore(), []
    for k, m in _by_kind(spark, sf_dir, store).items():
        none = m.read().where("false")
        store.append(Dataset(m, none, TimeRange(None, timestamp("2024-03-01"))), extend_declared_on_empty=True)
        data, declared = m.data_time_range(), m.declared_time_range()
        rows.append((k, *map(utc_wall, (data.start, data.end, declared.start, declared.end)), m.exists()))
    return _rows(spark, rows, "event_type string, data_start timestamp_ntz, data_end timestamp_ntz, declared_start timestamp_ntz, declared_end timestamp_ntz, there boolean")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'")
def store_get_dataset(spark, sf_dir):
    """Slices of several datasets, as datasets."""
    found = _by_kind(spark, sf_dir, MemoryStore())
    part = TimeRange(timestamp("2024-01-08"), timestamp("2024-01-22"))
    return reshape.concat_rows([m.get_dataset(part).data for m in found.values()]).select("event_id", "ts", "event_type")


# ------------------------------------------------------------------------- catalog
def _catalog(spark, sf_dir) -> tuple[MemoryStore, dict, dict]:
    """Regions (5), nations (25) and what is made of each nation's suppliers, all static."""
    store = MemoryStore()
    regions, nations = {}, {}
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        regions[r.r_regionkey] = Metadata("region", {"key": r.r_regionkey, "label": r.r_name}, static=True, store=store)
        regions[r.r_regionkey].replace(table(spark, sf_dir, "region"), None)
    for n in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        nations[n.n_name] = Metadata("nation", {"key": n.n_nationkey, "label": n.n_name}, {"region": regions[n.n_regionkey]}, "v2", True, store=store)
        nations[n.n_name].replace(table(spark, sf_dir, "nation"), None)
        balance = Metadata(f"balance.{n.n_name}", {"tags": [n.n_name, {"of": n.n_nationkey}]}, {"nation": nations[n.n_name]}, "v2", True, store=store)
        balance.replace(table(spark, sf_dir, "supplier").where(F.col("s_nationkey") == n.n_nationkey), None)
    return store, regions, nations


def _labels(metadata) -> list[tuple]:
    return [(m.parameter("label"),) for m in metadata]


@query("SELECT n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def catalog_scan_params(spark, sf_dir):
    """By a parameter of a predecessor."""
    return _rows(spark, _labels(_catalog(spark, sf_dir)[0].scan("nation", {"region.label": "ASIA"})), "label string")


@query("SELECT 'balance.' || n_name AS name FROM nation WHERE n_name LIKE 'A%' OR n_name LIKE 'I%' UNION ALL SELECT 'region'")
def catalog_find(spark, sf_dir):
    """Names that a pattern matches from their start."""
    return _rows(spark, [(n,) for n in _catalog(spark, sf_dir)[0].find(r"balance\.[AI]|reg")], "name string")


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey")
def catalog_find_successors(spark, sf_dir):
    store, regions, _ = _catalog(spark, sf_dir)
    return _rows(spark, [(r.parameter("label"), n.parameter("label")) for r in regions.values() for n in store.find_successors(r)], "region string, nation string")


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey")
def catalog_predecessors(spark, sf_dir):
    store, _, nations = _catalog(spark, sf_dir)
    return _rows(spark, [(store.predecessors_of("nation", "v2", n.hash)["region"].parameter("label"), k) for k, n in nations.items()], "region string, nation string")


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey")
def catalog_successors(spark, sf_dir):
    """The same by a join of the catalog's tables, with parameters out of their JSON."""
    datasets, edges = _catalog(spark, sf_dir)[0].catalog(spark)
    label = F.get_json_object("params", "$.label")
    child = datasets.select(F.col("hash").alias("child_hash"), label.alias("nation"))
    parent = datasets.where("name = 'region'").select(F.col("hash").alias("parent_hash"), label.alias("region"))
    return edges.join(parent, "parent_hash").join(child, "child_hash").select("region", "nation")


@query("SELECT 'region' AS name UNION ALL SELECT 'nation' UNION ALL SELECT 'balance.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def catalog_closure(spark, sf_dir):
    """All that is made of one dataset, itself included: a recursive query over the edges."""
    store, regions, _ = _catalog(spark, sf_dir)
    (top,) = (r for r in regions.values() if r.parameter("label") == "EUROPE")
    datasets, edges = store.catalog(spark)
    datasets.createOrReplaceTempView("cf_datasets")
    edges.createOrReplaceTempView("cf_edges")
    return spark.sql(
        f"""WITH RECURSIVE up(hash) AS (SELECT {top.hash} UNION ALL SELECT e.child_hash FROM cf_edges e JOIN up ON e.parent_hash = up.hash)
        SELECT DISTINCT d.name FROM cf_datasets d LEFT SEMI JOIN up ON d.hash = up.hash"""
    )


@query("SELECT n_name AS label, true AS balance_there FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' UNION ALL SELECT r_name, false FROM region WHERE r_name <> 'AFRICA'")
def catalog_delete(spark, sf_dir):
    """A region goes with all that is made of it; what is left, and whether its balances are."""
    store, regions, _ = _catalog(spark, sf_dir)
    (top,) = (r for r in regions.values() if r.parameter("label") == "AFRICA")
    try:
        store.delete(top)
    except ValueError:
        store.delete(top, recursive=True)
    named = [m for m in store.datasets() if m.name in ("region", "nation")]
    return _rows(spark, [(m.parameter("label"), f"balance.{m.parameter('label')}" in store.find("balance")) for m in named], "label string, balance_there boolean")


@query("""SELECT n_nationkey AS key, '{"key": ' || n_nationkey || ', "list": ["' || n_name || '", [' || n_regionkey || ', 0.5]]}' AS params, true AS same_hash, true AS other_hash FROM nation""")
def frozen_params(spark, sf_dir):
    """Parameters as they are stored and given back; their hash does not depend on order, nor
    on lists or tuples, but on whether a number is whole."""
    rows = []
    for n in table(spark, sf_dir, "nation").collect():
        k = positive(n.n_nationkey + 1, "key") - 1
        given = {"list": [n.n_name, [n.n_regionkey, 0.5]], "key": k}
        kept = normalize(given)
        turned = freeze({"key": k, "list": (n.n_name, (n.n_regionkey, 0.5))})
        rows.append((k, json.dumps(unfreeze(kept), sort_keys=True), stable_hash(kept) == stable_hash(turned) == stable_hash(given), stable_hash({**given, "key": float(k)}) != stable_hash(given)))
    return _rows(spark, rows, "key int, params string, same_hash boolean, other_hash boolean")


# -------------------------------------------------------------------------- ranges
@query(
    f"""WITH {_KIND_RANGES}, p AS (SELECT event_type, s, s + to_microseconds((epoch_us(e) - epoch_us(s)) // 3) AS e FROM r UNION ALL SELECT event_type || '_late', e - to_microseconds((epoch_us(e) - epoch_us(s)) // 2), e FROM r)
SELECT a.event_type AS a, b.event_type AS b, a.s < b.e AND b.s < a.e AS intersects, a.s <= b.s AND b.e <= a.e AS contains, a.s <= b.s AND b.s < a.e AS holds_start,
 CASE WHEN a.s < b.e AND b.s < a.e THEN greatest(a.s, b.s) END AS both_start, CASE WHEN a.s < b.e AND b.s < a.e THEN greatest(a.e, b.e) END AS either_end, true AS text_same FROM p a, p b"""
)
def range_algebra(spark, sf_dir):
    """Ranges of the driver: the first third and the last half of each type's events."""
    spans = {}
    for k in KINDS:
        own = TimeRange.of(table(spark, sf_dir, "events").where(F.col("event_type") == k), "ts")
        # Halves and thirds to the microsecond, rounded down.
        length = (own.end - own.start) // RESOLUTION
        spans[k] = TimeRange(own.start, own.start + timedelta(microseconds=length // 3))
        spans[f"{k}_late"] = TimeRange(own.end - timedelta(microseconds=length // 2), own.end)
    rows = []
    for a, x in spans.items():
        for b, y in spans.items():
            meet = x.intersects(y)
            rows.append((a, b, meet, x.contains(y), y.start in x, utc_wall(x.intersection(y).start) if meet else None, utc_wall(x.union(y).end) if meet else None, TimeRange.from_string(repr(x)) == x))
    return _rows(spark, rows, "a string, b string, intersects boolean, contains boolean, holds_start boolean, both_start timestamp_ntz, either_end timestamp_ntz, text_same boolean")


@query("SELECT 'event_id' AS columns, count(*) = count(DISTINCT event_id) AS is_unique FROM events UNION ALL SELECT 'user_id', count(*) = count(DISTINCT user_id) FROM events UNION ALL SELECT 'user_id, ts, event_id', count(*) = count(DISTINCT (user_id, ts, event_id)) FROM events")
def unique_checks(spark, sf_dir):
    rows = []
    for columns in (["event_id"], ["user_id"], ["user_id", "ts", "event_id"]):
        try:
            check_unique(table(spark, sf_dir, "events"), *columns)
            rows.append((", ".join(columns), True))
        except ValueError:
            rows.append((", ".join(columns), False))
    return _rows(spark, rows, "columns string, is_unique boolean")


@query("SELECT 'itself' AS other, (SELECT count(*) FROM (SELECT * FROM events EXCEPT ALL SELECT * FROM events)) = 0 AS same UNION ALL SELECT 'halved', (SELECT count(*) FROM (SELECT value FROM events EXCEPT ALL SELECT value / 2 FROM events)) = 0 UNION ALL SELECT 'doubled', (SELECT count(*) FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events)) = (SELECT count(*) FROM events)")
def frame_equals(spark, sf_dir):
    """As bags of rows: order does not count, repetitions do."""
    e = table(spark, sf_dir, "events")
    others = {"itself": e.repartition(3, "user_id"), "halved": e.withColumn("value", F.col("value") / 2), "doubled": e.unionByName(e)}
    return _rows(spark, [(k, equals(e, o)) for k, o in others.items()], "other string, same boolean")


@query(
    """WITH d AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2023-12-01', DATE '2024-03-31', INTERVAL 1 DAY) t(d)),
p AS (SELECT timezone('UTC', timezone('America/New_York', d + TIME '15:45:00')) AS ts, d FROM d WHERE isodow(d) <= 5 AND d NOT IN (DATE '2024-01-15')),
e AS (SELECT event_type, max(ts) AS last_ts FROM events GROUP BY event_type)
SELECT event_type, last_ts, (SELECT max(ts) FROM p WHERE ts < last_ts) AS close, time_bucket(INTERVAL 5 MINUTE, last_ts - INTERVAL 1 MICROSECOND) AS five FROM e"""
)
def calendar_latest_points(spark, sf_dir):
    """The last points of two calendars strictly before each type's last event."""
    from datetime import date

    closes, fives = TimeOfDayCalendar(CLOSE, Days(holidays=frozenset({date(2024, 1, 15)}))), OffsetCalendar(timedelta(minutes=5))
    rows = []
    for r in table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last")).collect():
        at = timestamp(r["last"])
        rows.append((r["event_type"], r["last"], *(utc_wall(c.latest_point_before(at)) for c in (closes, fives))))
    return _rows(spark, rows, "event_type string, last_ts timestamp_ntz, close timestamp_ntz, five timestamp_ntz")


# ------------------------------------------------------------------------- streams
def _streamed(spark, sf_dir, make, *options) -> DataFrame:
    """The older half is stored, then all events come as a stream."""
    m, _ = _stored(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "ts", "value", "event_type")
    run = make(stream, m, f"{scratch_root(spark)}/checkpoint", *options).trigger(availableNow=True).start()
    run.awaitTermination()
    return m.read()


@query(f"WITH {_OLD} SELECT event_id, ts, value, NULL::VARCHAR AS event_type FROM old UNION ALL SELECT event_id, ts, value, event_type FROM events WHERE ts > (SELECT max(ts) FROM old)")
def stream_append(spark, sf_dir):
    """Rows of a stream that are later than what is stored; late ones are dropped."""
    return _streamed(spark, sf_dir, append_stream)


@query(f"WITH {_OLD} SELECT e.event_id, e.ts, coalesce(o.value, e.value) AS value, e.event_type FROM events e LEFT JOIN old o ON e.event_id = o.event_id AND e.ts = o.ts")
def stream_merge(spark, sf_dir):
    """Late rows fill what is missing; stored values win."""
    return _streamed(spark, sf_dir, merge_stream, ["event_id"])


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_buckets(spark, sf_dir):
    """Sums by windows of time, as a stream updates them: the last update of each counts."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    sums = bucketed(stream, "at", "6 hours", "1 day", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value"))
    root = scratch_root(spark)
    out = f"{root}/updates"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.option("recursiveFileLookup", "true").parquet(out)
    start = F.to_timestamp_ntz(F.date_format(F.from_utc_timestamp(F.col("window.start"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))
    last = updates.groupBy("event_type", "window").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
    return rounded(last.select("event_type", start.alias("ts"), "n", "total"), "total")


_AS_OF = "(SELECT max(ts) FROM events)"


@query(f"SELECT event_type, max(ts) >= date_trunc('hour', {_AS_OF} - INTERVAL 1 MICROSECOND) AS ready FROM events GROUP BY event_type")
def stream_gate(spark, sf_dir):
    """Which inputs have reached the hour before the last event, so that what reads them may run."""
    e = table(spark, sf_dir, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    hourly = CalendarChecker(OffsetCalendar(timedelta(hours=1)))
    found = _by_kind(spark, sf_dir, MemoryStore())
    return _rows(spark, [(k, ready([m], hourly, timestamp(high), timestamp(low))) for k, m in found.items()], "event_type string, ready boolean")


# --------------------------------------------------------------------------- tasks
def _leaf(spark, sf_dir, kind: str):
    def read(time_range) -> DataFrame:
        return time_range.view(table(spark, sf_dir, "events").where(F.col("event_type") == kind), "ts").select("ts", "event_id", "value")

    return read


JANUARY = TimeRange(timestamp("2024-01-03"), timestamp("2024-01-28"))


def _context(store=None) -> GraphContext:
    return GraphContext(Defaults("v1", store or MemoryStore(), JANUARY)).extend_namespace("events")


def _daily_task(spark, sf_dir, context: GraphContext, kind: str):
    """Events of a type, and their daily sum with a day to look back on."""
    leaf = context.time_series_task(kind, _leaf(spark, sf_dir, kind), checker=IrregularChecker())

    def daily(x: DataFrame) -> DataFrame:
        day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
        return x.groupBy(day.alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    return leaf, context.time_series_task(f"{kind}.daily", daily, x=Dependency(leaf, timedelta(days=1)))


_DAILY = "SELECT event_type, date_trunc('day', ts) AS ts, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28' GROUP BY ALL"


def _run_daily(spark, sf_dir, runner, store=None) -> DataFrame:
    context, out = _context(store), {}
    for k in KINDS:
        out[k] = _daily_task(spark, sf_dir, context, k)[1]
    runner.run(Graph(out.values()))
    return rounded(reshape.concat_rows([t.output.read().withColumn("event_type", F.lit(k)) for k, t in out.items()]), "total")


@query(_DAILY)
def task_output(spark, sf_dir):
    """What a graph of ten tasks writes, one after the other."""
    return _run_daily(spark, sf_dir, SingleThreadedRunner())


@query(_DAILY)
def task_output_threads(spark, sf_dir):
    """The same, independent tasks at once, in Parquet."""
    return _run_daily(spark, sf_dir, MultiThreadedRunner(spark, 4), ParquetStore(spark, scratch_root(spark)))


@query(_DAILY)
def task_output_scheduler(spark, sf_dir):
    """The same, by a scheduler that only knows requirements, completion and runs."""

    def build(tasks) -> None:
        for t in tasks:
            if not t.complete():
                build(t.requires())
                t.run()

    return _run_daily(spark, sf_dir, ScheduledRunner(build))


@query(_DAILY)
def task_increments(spark, sf_dir):
    """Two runs over ranges that overlap give what one over both would."""
    store, out = MemoryStore(), {}
    for part in (TimeRange(JANUARY.start, timestamp("2024-01-15")), TimeRange(timestamp("2024-01-13"), JANUARY.end)):
        context = GraphContext(Defaults("v1", store, part), "events")
        for k in KINDS:
            leaf, out[k] = _daily_task(spark, sf_dir, context, k)
            leaf.run()
            out[k].run()
    return rounded(reshape.concat_rows([t.output.read().withColumn("event_type", F.lit(k)) for k, t in out.items()]), "total")


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' - INTERVAL 36 HOUR AND ts < TIMESTAMP '2024-01-20'")
def task_lookback_read(spark, sf_dir):
    """A dependency is read from its lookback before the reader's range on."""
    leaf = _context().time_series_task("click", _leaf(spark, sf_dir, "click"), checker=IrregularChecker())
    leaf.run()
    return Dependency(leaf, timedelta(hours=36)).read(TimeRange(timestamp("2024-01-10"), timestamp("2024-01-20")))


@query(
    f"""WITH {_KIND_RANGES} SELECT 'events.' || event_type AS task, 'v1' AS version, s AS start_ts, e AS end_ts, 'IrregularChecker' AS checker FROM r
UNION ALL SELECT 'events.all', 'v1', max(s), min(e), 'IrregularChecker' FROM r"""
)
def task_inference(spark, sf_dir):
    """Tasks over each type's own range; what reads them all has their common range, and their checker."""
    e, leaves = table(spark, sf_dir, "events"), {}
    context = GraphContext(Defaults("v1", MemoryStore()), "events")
    for k in KINDS:
        leaves[k] = context.time_series_task(k, _leaf(spark, sf_dir, k), checker=IrregularChecker(), time_range=TimeRange.of(e.where(F.col("event_type") == k), "ts"))
    child = context.time_series_task("all", lambda **inputs: reshape.concat_rows(list(inputs.values())), **leaves)
    scalars, dependencies = split_arguments({**leaves, "scale": 2})
    assert scalars == {"scale": 2} and infer_range(dependencies, JANUARY).start >= child.time_range.start
    rows = [(t.output.name, t.version, utc_wall(t.time_range.start), utc_wall(t.time_range.end), type(t.checker).__name__) for t in (*leaves.values(), child)]
    return _rows(spark, rows, "task string, version string, start_ts timestamp_ntz, end_ts timestamp_ntz, checker string")


def _nation_graph(spark, sf_dir) -> Graph:
    """A static task for each region and, made of it, for each of its nations, and one of all
    nations; regions on A fail."""
    context = GraphContext(Defaults("v1", MemoryStore()))

    def region(label: str) -> DataFrame:
        if label.startswith("A"):
            raise ValueError(f"no data of {label}")
        return table(spark, sf_dir, "region").where(F.col("r_name") == label)

    regions = {r.r_regionkey: context.static_task(r.r_name, region, label=r.r_name) for r in table(spark, sf_dir, "region").collect()}
    nations = [context.static_task(f"{n.n_name}.nation", lambda parent, key: table(spark, sf_dir, "nation").where(F.col("n_nationkey") == key), parent=regions[n.n_regionkey], key=n.n_nationkey) for n in table(spark, sf_dir, "nation").collect()]
    return Graph([*nations, context.static_task("all", lambda **inputs: reshape.concat_rows(list(inputs.values())), **{f"n{i}": t for i, t in enumerate(nations)})])


_STATES = """SELECT r_name AS name, CASE WHEN r_name LIKE 'A%' THEN 'failed' ELSE 'complete' END AS status FROM region
UNION ALL SELECT n_name || '.nation', CASE WHEN r_name LIKE 'A%' THEN 'blocked' ELSE 'complete' END FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'all', CASE WHEN EXISTS (SELECT 1 FROM region WHERE r_name LIKE 'A%') THEN 'blocked' ELSE 'complete' END"""


@query(_STATES)
def task_graph_failures(spark, sf_dir):
    """A failure stops what depends on it and nothing else."""
    return SingleThreadedRunner().run(_nation_graph(spark, sf_dir)).to_df(spark)


@query(_STATES)
def task_graph_failures_threads(spark, sf_dir):
    return MultiThreadedRunner(spark, 4).run(_nation_graph(spark, sf_dir)).to_df(spark)


@query("SELECT n_name || '.nation' AS name, 'waiting' AS status FROM nation UNION ALL SELECT r_name, 'ready' FROM region UNION ALL SELECT 'all', 'waiting'")
def task_graph_status(spark, sf_dir):
    """Before anything ran."""
    return GraphStatus(_nation_graph(spark, sf_dir)).to_df(spark)


@query("SELECT d AS ts, round(pow(1.0001, row_number() OVER (ORDER BY d)), 6) AS value FROM (SELECT timezone('UTC', timezone('America/New_York', CAST(d AS DATE) + TIME '16:00:00')) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5) WHERE d >= TIMESTAMP '2024-01-01' AND d < TIMESTAMP '2024-02-01'")
def task_graph_run(spark, sf_dir):
    """The example graph: closing times, and a price that grows from close to close; a second run adds nothing."""
    from datetime import datetime

    from causalframe.plans.examples import interest_graph

    graph = interest_graph(spark, MemoryStore(), datetime(2024, 1, 1), datetime(2024, 2, 1))
    SingleThreadedRunner().run(graph)
    SingleThreadedRunner().run(graph)
    (sink,) = graph.sinks
    return rounded(sink.output.read().select("ts", "value"), "value", digits=6)
