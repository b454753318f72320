from datetime import datetime, timedelta

from causalframe.plans.tasks import CalendarChecker
from causalframe.calendars import OffsetCalendar
from causalframe.sources.dataset import Metadata
from causalframe.sources.store import ParquetStore
from causalframe.streaming.incremental import append_stream, bucketed, merge_stream, ready
from causalframe.time import timestamp
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def write(spark, path, hours, value):
    spark.createDataFrame([(T0 + timedelta(hours=h), value) for h in hours], "ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(path)


def test_append_and_merge_streams(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    late, filled = Metadata("late", store=store), Metadata("filled", store=store)
    for hours, value in (([0, 1, 2, 5], 1.0), ([3, 5, 6], 2.0)):
        write(spark, source, hours, value)
        for make, m in ((append_stream, late), (merge_stream, filled)):
            stream = spark.readStream.schema("ts timestamp_ntz, v double").parquet(source)
            query = make(stream, m, f"file://{tmp_path}/cp-{m.name}").trigger(availableNow=True).start()
            query.awaitTermination()
    # Late rows are dropped by an append; a merge keeps them and the stored value of hour 5.
    assert [(r.ts.hour, r.v) for r in late.read().orderBy("ts").collect()] == [(0, 1.0), (1, 1.0), (2, 1.0), (5, 1.0), (6, 2.0)]
    assert [(r.ts.hour, r.v) for r in filled.read().orderBy("ts").collect()] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0), (5, 1.0), (6, 2.0)]
    gate = CalendarChecker(OffsetCalendar(timedelta(hours=1)))
    assert ready([late, filled], gate, timestamp(T0 + timedelta(hours=7)), timestamp(T0))
    assert not ready([late], gate, timestamp(T0 + timedelta(hours=9)), timestamp(T0))


def test_bucketed_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    write(spark, source, [0, 0, 1, 5], 1.0)
    stream = spark.readStream.schema("ts timestamp_ntz, v double").parquet(source).withColumn("at", F.col("ts").cast("timestamp"))
    query = bucketed(stream, "at", "1 hour", "1 hour", [], total=F.sum("v")).writeStream.format("memory").queryName("cf_buckets").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.total for r in spark.sql("select total from cf_buckets").collect()) == [1.0, 1.0, 2.0]
