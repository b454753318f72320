from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from causalframe.calendars import OffsetCalendar, UnionCalendar
from causalframe.plans.context import Defaults, GraphContext
from causalframe.plans.examples import interest_graph
from causalframe.plans.graph import Graph, GraphStatus, MultiThreadedRunner, SingleThreadedRunner
from causalframe.plans.scheduler import ScheduledRunner, outcome, scheduled
from causalframe.plans.tasks import CalendarChecker, Dependency, IrregularChecker
from causalframe.sources.store import MemoryStore, ParquetStore
from causalframe.time import TimeRange, timestamp

DAILY = CalendarChecker(OffsetCalendar(timedelta(days=1)))


def span(a, b):
    return TimeRange(timestamp(datetime(2020, 1, a)), timestamp(datetime(2020, 1, b)))


def context(time_range=None, store=None):
    return GraphContext(Defaults("v1", store or MemoryStore(), time_range or span(2, 6)))


def days(spark):
    def leaf(time_range, value=1.0):
        points = OffsetCalendar(timedelta(days=1)).to_df(spark, TimeRange(time_range.start - timedelta(days=3), time_range.end + timedelta(days=3)))
        return points.withColumn("v", F.lit(value))

    return leaf


def test_increments_equal_the_union(spark):
    store = MemoryStore()
    for r in (span(2, 6), span(5, 11)):
        t = context(r, store).time_series_task("leaf", days(spark), checker=DAILY)
        t.run()
        assert t.complete()
    assert t.output.read().orderBy("ts").toPandas()["ts"].dt.day.tolist() == list(range(2, 11))
    whole = context(span(2, 11)).time_series_task("leaf", days(spark), checker=DAILY)
    whole.run()
    assert t.output.read().exceptAll(whole.output.read()).count() == 0


def test_incomplete_output_is_an_error(spark):
    t = context().time_series_task("leaf", lambda time_range: days(spark)(time_range).where("ts < timestamp_ntz '2020-01-04'"), checker=DAILY)
    with pytest.raises(ValueError, match="complete"):
        t.run()


def test_lookback_and_narrowing(spark):
    store, seen = MemoryStore(), []

    def roll(x):
        seen.append(x.count())
        return x

    for r, narrow in ((span(2, 6), False), (span(2, 8), True)):
        c = context(r, store)
        leaf = c.time_series_task("leaf", days(spark), checker=DAILY)
        leaf.run()
        t = c.time_series_task("roll", roll, x=Dependency(leaf, timedelta(days=1)), narrow=narrow)
        t.run()
    assert seen == [4, 3]
    assert t.output.read().count() == 6


def test_checkers(spark):
    c = context()
    t = c.time_series_task("leaf", days(spark), checker=IrregularChecker())
    assert not t.complete()
    t.run()
    assert t.complete()
    later = context(span(20, 25), t.store).time_series_task("leaf", days(spark), checker=IrregularChecker())
    with pytest.raises(ValueError, match="overlap"):
        later.complete()


def test_inference(spark):
    hourly = CalendarChecker(OffsetCalendar(timedelta(hours=1)))
    c = context()
    a = c.time_series_task("a", days(spark), checker=DAILY, version="branch")
    b = c.time_series_task("b", days(spark), checker=hourly, time_range=span(4, 9))
    irregular = c.time_series_task("i", days(spark), checker=IrregularChecker())

    def two(a, b):
        return a

    t = c.time_series_task("t", two, a=a, b=b)
    assert t.version == "branch" and t.time_range == span(4, 6)
    assert t.checker == CalendarChecker(UnionCalendar.merge([DAILY.calendar, hourly.calendar]))
    assert c.time_series_task("t", two, a=Dependency(a, inherit_frequency=True), b=b).checker == DAILY
    assert c.time_series_task("t", two, a=Dependency(a, inherit_frequency=False), b=b).checker == hourly
    with pytest.raises(ValueError, match="do not go together"):
        c.time_series_task("t", two, a=a, b=irregular)
    with pytest.raises(ValueError, match="completion checker"):
        c.time_series_task("t", days(spark))
    other = c.time_series_task("o", days(spark), checker=DAILY, version="other")
    with pytest.raises(ValueError, match="more than one value"):
        c.time_series_task("t", two, a=a, b=other)
    with pytest.raises(ValueError, match="version"):
        GraphContext().static_task("s", lambda: None)
    with pytest.raises(TypeError):
        c.time_series_task("t", two, a=a, checker=DAILY)
    inner = c.extend_namespace("x").extend_namespace("y")
    assert inner.static_task("s", lambda: spark.range(1)).output.name == "x.y.s"


class Boom(Exception):
    pass


def diamond(spark, fails=(), store=None):
    c = context(store=store)

    def make(name):
        def f(**inputs):
            if name in fails:
                raise Boom(name)
            return spark.range(1)

        return f

    a = c.static_task("a", make("a"))
    b, d = (c.static_task(n, make(n), a=a) for n in "bd")
    e = c.static_task("e", make("e"), b=b, d=d)
    return Graph([e]), (a, b, d, e)


@pytest.mark.parametrize("threads", [0, 3])
@pytest.mark.parametrize("fails, complete, failed, blocked", [((), 4, 0, 0), (("a",), 0, 1, 3), (("b",), 2, 1, 1), (("e",), 3, 1, 0)])
def test_runners(spark, threads, fails, complete, failed, blocked):
    graph, tasks = diamond(spark, fails)
    runner = MultiThreadedRunner(spark, threads) if threads else SingleThreadedRunner()
    status = runner.run(graph)
    assert (len(status.complete), len(status.failed), len(status.has_failed_predecessor)) == (complete, failed, blocked)
    assert not status.ready and not status.waiting
    assert str(status).startswith("4 tasks")
    assert status.to_df(spark).count() == 4


@pytest.mark.parametrize("fails, complete, failed, blocked", [((), 4, 0, 0), (("a",), 0, 1, 3), (("b",), 2, 1, 1)])
def test_external_scheduler(spark, fails, complete, failed, blocked):
    graph, (a, b, d, e) = diamond(spark, fails)
    ran = []

    def build(tasks):
        """As schedulers do: requirements first, failures are kept, nothing runs twice."""
        for t in tasks:
            build(t.requires())
            if not t.complete() and t.task_id not in ran and all(r.complete() for r in t.requires()):
                ran.append(t.task_id)
                try:
                    t.run()
                except Boom:
                    pass

    status = ScheduledRunner(build).run(graph)
    # A status does not look behind tasks that are complete.
    assert (len(status.complete), len(status.failed), len(status.has_failed_predecessor)) == (complete if fails else 1, failed, blocked)
    assert len(ran) == len(set(ran)) == complete + failed
    (top,) = scheduled(graph)
    assert top.task == e and [r.task for r in top.requires()] == sorted([b, d], key=lambda t: t.output.name)
    assert top.task_id == scheduled(diamond(spark)[0])[0].task_id and top.parameters["name"] == "e"
    if not fails:
        assert status.complete == {e} and outcome(graph).complete == {e}


def test_status_stops_at_complete_tasks(spark):
    graph, (a, b, d, e) = diamond(spark)
    SingleThreadedRunner().run(graph)
    again = GraphStatus(Graph([e]))
    assert again.complete == {e} and not again.ready
    lonely = context().static_task("alone", lambda: spark.range(2))
    assert SingleThreadedRunner().run(Graph([lonely])).complete == {lonely}
    assert graph.sinks == {e} and graph.get_successors(a) == {b, d} and len(graph.tasks) == 4


def test_example_graph_on_parquet(spark, tmp_path):
    graph = interest_graph(spark, ParquetStore(spark, f"file://{tmp_path}/s"), datetime(2024, 1, 1), datetime(2024, 2, 1))
    status = MultiThreadedRunner(spark, 2).run(graph)
    assert {t.output.name for t in status.complete} == {"reference.closes", "market.interest"}
    (sink,) = graph.sinks
    rows = sink.output.read().orderBy("ts").collect()
    assert len(rows) == 23 and rows[-1].value == pytest.approx(1.0001**23)
