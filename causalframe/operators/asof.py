"""As-of joins and as-of bucket aggregation.

Both put data and target rows of one entity in order of time and carry the last data
row forward in one window pass: no join on inequality. Windows are partitioned by the
keys. For series without keys, or with one key that holds most rows, time is split into
blocks that are windowed on their own; each block's last data row (or first target
time) is carried over in a table of one row for each block. Without keys that is the
default, with a width that makes a few blocks for each shuffle partition.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.timeframe import check_time_type, check_unique

_P, _O, _B, _M, _T = "__payload", "__order", "__block", "__matched", "__target"


def _union(data: DataFrame, target: DataFrame, keys: list[str], on: str, values: list[str], data_first: bool, block: timedelta | None) -> DataFrame:
    """Data rows (payload) and target rows (their columns in a struct), in one frame."""
    payload = F.struct(F.col(on).alias(on), *values)
    d = data.select(*keys, on, F.lit(0 if data_first else 1).alias(_O), payload.alias(_P))
    t = target.select(*keys, on, F.lit(1 if data_first else 0).alias(_O), F.struct(*target.columns).alias(_T))
    both = d.unionByName(t, allowMissingColumns=True)
    return both.withColumn(_B, _block(on, block)) if block else both


def _block(on: str, block: timedelta) -> Column:
    return F.floor(F.unix_micros(F.to_utc_timestamp(F.col(on).cast("timestamp"), F.current_timezone())) / int(block / timedelta(microseconds=1)))


def _auto_block(frame: DataFrame, on: str) -> timedelta | None:
    """Several blocks of time for each shuffle partition; from one aggregate of the target's times."""
    low, high = frame.agg(F.min(on), F.max(on)).first()
    if low is None or high == low:
        return None
    parts = 4 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max((high - low) / parts, timedelta(microseconds=1))


def _by_all(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality of these columns, null with null."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def causal_match(
    data: DataFrame,
    target: DataFrame,
    on: str = "ts",
    keys: list[str] | tuple[str, ...] = (),
    contemp: bool = False,
    fill_limit: int | None = None,
    values: list[str] | None = None,
    block: timedelta | None = None,
    matched_time: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Backward as-of left join: every target row with the values of the latest data row
    of its keys before it, or at its own time too with contemp.

    The last row counts as a whole, nulls included. Target rows may repeat. fill_limit
    is how many target rows after the one that a data row lands on it may still fill,
    in order of time (rows of one time one by one, by their other columns). matched_time names a
    column for the data row's time. check costs one job: repeated data times raise ValueError."""
    keys = list(keys)
    check_time_type(data, on)
    check_time_type(target, on)
    values = [c for c in data.columns if c not in keys and c != on] if values is None else list(values)
    clash = sorted(set(values) & (set(target.columns) - set(keys) - {on}))
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(clash)}")
    if check:
        check_unique(data, *keys, on)
    block = block or (None if keys else _auto_block(target, on))
    both = _union(data, target, keys, on, values, contemp, block)
    parts = keys + ([_B] if block else [])
    w = Window.partitionBy(*parts).orderBy(on, _O).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn(_M, F.last(_P, ignorenulls=True).over(w)).where(F.col(_T).isNotNull())
    if block:
        ends = both.groupBy(*parts).agg(F.max_by(_P, F.when(F.col(_P).isNotNull(), F.col(on))).alias(_P))
        earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.withColumn("__carry", F.last(_P, ignorenulls=True).over(earlier)).drop(_P)
        carry = carry.select(*parts, "__carry")
        rows = rows.join(carry, _by_all(rows, carry, parts), "left").select(rows[on], *[rows[c] for c in keys], rows[_T], F.coalesce(rows[_M], F.col("__carry")).alias(_M))
    if fill_limit is not None:
        # Rows without a match have nothing to fill: they are dealt out by time.
        run = Window.partitionBy(*keys, F.col(f"{_M}.{on}"), F.when(F.col(_M).isNull(), F.xxhash64(on)))
        others = [F.col(f"{_T}.{c}") for c in target.columns if c != on and c not in keys]
        land = F.min(on).over(run)
        rows = rows.withColumn("__land", land)
        after = F.row_number().over(run.orderBy(on, *others)) - F.sum(F.when(F.col(on) == F.col("__land"), 1).otherwise(0)).over(run)
        rows = rows.withColumn(_M, F.when(after <= fill_limit, F.col(_M)))
    out = [F.col(f"{_T}.{c}").alias(c) for c in target.columns] + [F.col(f"{_M}.{c}").alias(c) for c in values]
    if matched_time:
        out.append(F.col(f"{_M}.{on}").alias(matched_time))
    return rows.select(*out)


def causal_broadcast(data: DataFrame, target: DataFrame, on: str = "ts", **options) -> DataFrame:
    """One series matched onto a target of several entities: as-of on the distinct target
    times, then an equi-join back to all target rows."""
    values = [c for c in data.columns if c != on]
    times = causal_match(data, target.select(on).distinct(), on, **options)
    return target.join(times.select(on, *values), on, "left")


AggMethod = str | Callable[[str], Column]


def _aggregate(column: str, on: str, method: AggMethod) -> Column:
    c = F.col(column)
    if not isinstance(method, str):
        return method(column)
    known = {
        # The last and first value that is there, column by column.
        "last": lambda: F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col(on))),
        "first": lambda: F.min_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col(on))),
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0).cast("double")),
        "mean": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count": lambda: F.count(c),
        "std": lambda: F.stddev_samp(c),
    }
    if method not in known:
        raise ValueError(f"unknown aggregation {method!r}; one of {', '.join(known)} or a function of a column name")
    return known[method]()


def causal_resample(
    data: DataFrame,
    target: DataFrame,
    method: AggMethod | dict[str, AggMethod],
    on: str = "ts",
    keys: list[str] | tuple[str, ...] = (),
    contemp: bool = False,
    values: list[str] | None = None,
    block: timedelta | None = None,
    check: bool = True,
) -> DataFrame:
    """Every target row with an aggregate of the data rows between the target time before
    it and its own (its own included with contemp). Target times without data get nulls;
    data after the last target time is left out. Target rows may repeat.

    method: last, first, sum, mean, min, max, count, std, or a function from a column name
    to an aggregate Column (a grouped-aggregate pandas UDF, say); or a dict of these."""
    keys = list(keys)
    check_time_type(data, on)
    check_time_type(target, on)
    if check:
        check_unique(data, *keys, on)
    values = [c for c in data.columns if c not in keys and c != on] if values is None else list(values)
    methods = method if isinstance(method, dict) else dict.fromkeys(values, method)
    d = data.select(*keys, on, *methods, F.lit(1 if contemp else 0).alias(_O), F.lit(None).cast("timestamp_ntz").alias("__bucket"))
    t = target.select(*keys, on).distinct().select(*keys, on, F.lit(0 if contemp else 1).alias(_O), F.col(on).alias("__bucket"))
    # Backward in time, so that the next target time is the last one seen: a running
    # frame costs one pass, one that looks ahead would not.
    both = d.withColumn("__data", F.lit(True)).unionByName(t, allowMissingColumns=True)
    block = block or (None if keys else _auto_block(target, on))
    parts = keys + ([_B] if block else [])
    both = both.withColumn(_B, _block(on, block)) if block else both
    w = Window.partitionBy(*parts).orderBy(F.col(on).desc(), F.col(_O)).rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.withColumn("__bucket", F.last("__bucket", ignorenulls=True).over(w)).where("__data")
    if block:
        later = Window.partitionBy(*keys).orderBy(F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = both.groupBy(*parts).agg(F.min("__bucket").alias("__first")).withColumn("__carry", F.last("__first", ignorenulls=True).over(later)).select(*parts, "__carry")
        dealt = dealt.join(carry, _by_all(dealt, carry, parts), "left").select(*[dealt[c] for c in (*keys, on, *methods)], F.coalesce(dealt["__bucket"], F.col("__carry")).alias("__bucket"))
    dealt = dealt.where("__bucket is not null")
    found = dealt.groupBy(*keys, "__bucket").agg(*[_aggregate(c, on, m).alias(c) for c, m in methods.items()])
    found = found.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__bucket", *methods)
    same = target[on] == found["__bucket"]
    for k in keys:
        same = same & target[k].eqNullSafe(found[f"__k_{k}"])
    return target.join(found, same, "left").select(*[target[c] for c in target.columns], *[found[c] for c in methods])
