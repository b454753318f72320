"""A small graph to run: reference data, then market data made of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from causalframe.calendars import TimeOfDayCalendar
from causalframe.functions import fin
from causalframe.plans.context import Defaults, GraphContext
from causalframe.plans.graph import Graph, TaskModule
from causalframe.plans.tasks import CalendarChecker
from causalframe.sources.store import Store
from causalframe.time import TimeOfDay, TimeRange


class ReferenceData(TaskModule):
    """The closing times of business days."""

    def __init__(self, spark: SparkSession, context: GraphContext):
        own = context.extend_namespace("reference")
        calendar = TimeOfDayCalendar(TimeOfDay.from_str("16:00 America/New_York"))

        def closes(time_range: TimeRange) -> DataFrame:
            return calendar.to_df(spark, time_range)

        self.closes = own.time_series_task("closes", closes, checker=CalendarChecker(calendar))


class MarketData(TaskModule):
    """A price that grows at a fixed rate from close to close."""

    def __init__(self, context: GraphContext, reference: ReferenceData):
        own = context.extend_namespace("market")
        self.interest = own.time_series_task("interest", fin.compound_interest, calendar=reference.closes, rate=0.0001)


def interest_graph(spark: SparkSession, store: Store, start: datetime, end: datetime) -> Graph:
    context = GraphContext(Defaults("v1", store, TimeRange(start, end)))
    reference = ReferenceData(spark, context)
    market = MarketData(context, reference)
    return Graph(reference.all_tasks() | market.all_tasks())
