"""Summaries: describe, quantile buckets, correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, columns: list[Column], parts: int) -> list[list]:
    """For each column, inner bounds of about `parts` equally full ranges: one aggregate with
    sketches of fixed size, whose result is a few numbers."""
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(*[F.percentile_approx(c, probs, F.lit(10 * parts)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(x or [])) for x in found]


def range_of(value: Column, bounds: list) -> Column:
    """The number of the range that a value lies in. The bounds are literals, so the same row
    is in the same range in every branch of a plan."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value)) if bounds else F.lit(0)


def _parts(df: DataFrame) -> int:
    return max(2, min(128, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _ranked(values: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, x, __part): one row for each key and distinct value, null included, with how
    often it is there (__c), the places of its first and last copy among the key's values that
    are not null, and how many these are (__n). Equal values are counted first; each range of
    values is ranked on its own and moved by the sizes of those below, so no task holds all
    values of a key."""
    counted = values.groupBy(*keys, "__part", "x").agg(F.count(F.lit(1)).alias("__c")).withColumn("__v", F.when(F.col("x").isNotNull(), F.col("__c")).otherwise(0))
    inside = Window.partitionBy(*keys, "__part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__cum", F.sum("__v").over(inside))
    # One row for each key and range.
    sizes = counted.groupBy(*keys, "__part").agg(F.sum("__v").alias("__s"))
    below, all_ = Window.partitionBy(*keys).orderBy("__part"), Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "__part", (F.sum("__s").over(below) - F.col("__s")).alias("__off"), F.sum("__s").over(all_).alias("__n"))
    same = reduce(lambda a, b: a & b, [ranked[c].eqNullSafe(sizes[c]) for c in (*keys, "__part")])
    return ranked.join(sizes, same).select(*[ranked[c] for c in keys], "x", "__c", "__v", (F.col("__off") + F.col("__cum") - F.col("__v")).alias("__first"), (F.col("__off") + F.col("__cum") - 1).alias("__last"), "__n")


def _quantile(p: float) -> Column:
    """The exact quantile of a key's ranked values, between two of them by their distance."""
    at = F.lit(p) * (F.col("__n") - 1)
    low, high = (F.max(F.when((F.col("__first") <= f(at)) & (F.col("__last") >= f(at)), F.col("x"))) for f in (F.floor, F.ceil))
    return low + (high - low) * F.max(at - F.floor(at))


def describe(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """One row for each column (and key): count, mean, std, min, quartiles, max. Columns
    become rows before the aggregation; all figures come from the same ranked values."""
    keys = list(keys)
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(keys, columns, "variable", "x")
    part, middle = F.lit(0), F.lit(0.0)
    for c, bounds in zip(columns, range_bounds(wide, [F.col(c) for c in columns], _parts(df)), strict=True):
        part = F.when(F.col("variable") == c, range_of(F.col("x"), bounds)).otherwise(part)
        if bounds:
            middle = F.when(F.col("variable") == c, F.lit(float(bounds[len(bounds) // 2]))).otherwise(middle)
    rows = _ranked(long.withColumn("__part", part), [*keys, "variable"])
    # Moments around a value amid the column's: squares of large levels would cancel.
    n, d = F.sum("__v"), F.col("x") - middle
    one, two = F.sum(d * F.col("__v")), F.sum(d * d * F.col("__v"))
    mean = F.max(middle) + one / n
    std = F.when(n > 1, F.sqrt(F.greatest(two - one * one / n, F.lit(0.0)) / (n - 1)))
    return rows.groupBy(*keys, "variable").agg(
        n.cast("long").alias("count"), F.when(n > 0, mean).alias("mean"), std.alias("std"), F.min("x").alias("min"),
        *[_quantile(p).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))], F.max("x").alias("max"),
    )


def quantile_edges(df: DataFrame, column: str, parts: int = 10, keys: list[str] = ()) -> DataFrame:
    """keys, edges: the quantiles 0, 1/parts, ... short of 1."""
    x = F.col(column).cast("double")
    (bounds,) = range_bounds(df, [x], _parts(df))
    values = df.select(*keys, x.alias("x")).withColumn("__part", range_of(F.col("x"), bounds))
    return _ranked(values.where("x is not null"), list(keys)).groupBy(*keys).agg(F.array(*[_quantile(i / parts) for i in range(parts)]).alias("edges"))


def bucket(value: Column, edges: Column) -> Column:
    """How many edges do not exceed the value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def quantile_buckets(df: DataFrame, column: str, mean_of: str, parts: int = 10) -> DataFrame:
    """bucket, n, mean of another column. The edges are one row, so they are broadcast."""
    edged = df.join(F.broadcast(quantile_edges(df, column, parts)))
    return edged.groupBy(bucket(F.col(column), F.col("edges")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(mean_of).alias("mean"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long matrix (row, col, corr) from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    rows = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"`{i}`").alias("corr")) for a, b, i in cells])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n: equal widths from the smallest to the largest value (which falls in the last bin)."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def strict_row_sum(columns: list[str]) -> Column:
    """Sum across columns, null if one is."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])
