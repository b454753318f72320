"""Ordered analytics by key: fills, differences, rolling and cumulative sums,
exponentially weighted means and deviations.

Every function adds one column and takes `keys` (entities) and `on` (time). Frames
only look back or are bounded, so each is one pass over a sorted partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str] | tuple[str, ...]


def ordered(keys: Keys, on: str = "ts"):
    return Window.partitionBy(*keys).orderBy(on)


def ffill(column: str | Column, w, limit: int | None = None) -> Column:
    """The last value that is there, at most `limit` rows back."""
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def bfill(column: str, keys: Keys, on: str = "ts", limit: int | None = None) -> Column:
    """The next value that is there, at most `limit` rows on: a forward fill backward in time."""
    w = Window.partitionBy(*keys).orderBy(F.col(on).desc())
    return ffill(column, w, limit)


def diff(column: str | Column, w, step: int = 1) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c - F.lag(c, step).over(w)


def shift(column: str, w, step: int = 1) -> Column:
    return F.lag(column, step).over(w)


def rolling(column: str, w, rows: int, how: str = "sum") -> Column:
    """Sum or mean of the last `rows` rows; null until all of them have a value."""
    f = {"sum": F.sum, "mean": F.avg}[how]
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(frame) == rows, f(column).over(frame))


def cumsum(column: str | Column, w) -> Column:
    return F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cumprod(column: str, w) -> Column:
    """Product so far, of any signs: logarithms of sizes, parity of negatives, zeros."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(column)
    size = F.exp(F.sum(F.when(c != 0, F.ln(F.abs(c)))).over(frame))
    odd = F.sum(F.when(c < 0, 1).otherwise(0)).over(frame) % 2
    zero = F.max(F.when(c == 0, 1).otherwise(0)).over(frame) == 1
    return F.when(F.count(c).over(frame) > 0, F.when(zero, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * F.when(odd == 1, -1.0).otherwise(1.0)))


def keep_last(df: DataFrame, by: Keys, order: list[str]) -> DataFrame:
    """The last row, by `order`, of those that share `by`."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


# ------------------------------------------------------------------ exponential
def alpha_from_span(span: float) -> float:
    return 2 / (1 + span)


#: Rows of a block, unless a span needs more or would overflow in as many. One size for
#: most spans, so that several means of one series share its blocks and their order.
BLOCK_ROWS = 1024
_N = "__ew_n"


def _block_rows(decay: float) -> int:
    """Rows after which a weight has fallen under 1e-18; BLOCK_ROWS where that is enough and
    squared weights stay finite."""
    need = max(2, math.ceil(math.log(1e-18) / math.log(decay)))
    return BLOCK_ROWS if need <= BLOCK_ROWS and -2 * BLOCK_ROWS * math.log10(decay) < 280 else need


def _blocked(df: DataFrame, size: int, keys: Keys, on: str) -> DataFrame:
    """Adds the row's number, its block and its place in it, once for each size."""
    if _N not in df.columns:
        df = df.withColumn(_N, F.row_number().over(ordered(keys, on)) - 1)
    if f"__ew_b{size}" not in df.columns:
        df = df.withColumns({f"__ew_b{size}": F.floor(F.col(_N) / size), f"__ew_p{size}": F.col(_N) % size})
    return df


def _by_block(size: int, keys: Keys):
    """The order of time once more, in a form that all windows of the blocks share: rows are sorted once."""
    return Window.partitionBy(*keys).orderBy(f"__ew_b{size}", _N)


def _unblocked(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__ew_")])


def _weighted(df: DataFrame, x: Column, decay: float, keys: Keys, on: str, powers: tuple[int, ...], tag: str) -> DataFrame:
    """Adds, for p in powers, {tag}x{p}, {tag}y{p} and {tag}w{p}: sums over all rows up to each of
    decay**(p * age) times x, times x squared, and of the weights where x is there.

    A closed form would need decay**-row, which overflows in long series. Rows are cut
    into blocks within which it cannot; older blocks than the one before weigh nothing
    at double precision."""
    size = _block_rows(decay)
    df = _blocked(df, size, keys, on)
    block, place = f"__ew_b{size}", f"__ew_p{size}"
    inside = Window.partitionBy(*keys, block).orderBy(_N).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rangeBetween(-1, -1)
    terms = {}
    for p in powers:
        up = F.pow(F.lit(decay**p), -F.col(place))
        terms |= {(f"{tag}x{p}", p): x * up, (f"{tag}y{p}", p): x * x * up, (f"{tag}w{p}", p): F.when(x.isNotNull(), up)}
    # Within blocks first: that order of rows is also one of the blocks, so nothing is sorted again.
    df = df.withColumns({name: F.coalesce(F.sum(term).over(inside), F.lit(0.0)) * F.pow(F.lit(decay**p), F.col(place)) for (name, p), term in terms.items()})
    return df.withColumns({name: F.col(name) + F.coalesce(F.sum(term).over(before), F.lit(0.0)) * F.pow(F.lit(decay**p), F.col(place) + size) for (name, p), term in terms.items()})


def _settled(df: DataFrame, value: Column, x: Column, least: int, size: int, keys: Keys, out: str, tag: str) -> DataFrame:
    """The value where `least` values are there so far; with nothing new a ratio stays what it was."""
    w = _by_block(size, keys).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(f"{tag}v", value)
    df = df.withColumn(out, F.when(F.count(x).over(w) >= least, F.last(f"{tag}v", ignorenulls=True).over(w)))
    return df.drop(*[c for c in df.columns if c.startswith(tag)])


def _mean(df: DataFrame, column: str, span: float, out: str, keys: Keys, on: str, min_periods: int | None = None) -> DataFrame:
    decay, tag = 1 - alpha_from_span(span), f"__{out}_"
    least = math.ceil(3 * span) if min_periods is None else min_periods
    x = F.col(column).cast("double")
    df = _weighted(df, x, decay, keys, on, (1,), tag)
    value = F.when(F.col(f"{tag}w1") > 0, F.col(f"{tag}x1") / F.col(f"{tag}w1"))
    return _settled(df, value, x, least, _block_rows(decay), keys, out, tag)


def _volatility(df: DataFrame, column: str, span: float, out: str, keys: Keys, on: str, centered: bool = False) -> DataFrame:
    decay, tag = 1 - alpha_from_span(span), f"__{out}_"
    if not centered:
        df = df.withColumn(f"__sq_{out}", F.pow(F.col(column), 2))
        return _mean(df, f"__sq_{out}", span, out, keys, on).withColumn(out, F.sqrt(out)).drop(f"__sq_{out}")
    size = _block_rows(decay)
    x = F.col(column).cast("double")
    df = _blocked(df, size, keys, on)
    # Around the series' first value: squares of large levels would cancel.
    first = F.first(x, ignorenulls=True).over(_by_block(size, keys).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn(f"{tag}c", x - first)
    df = _weighted(df, F.col(f"{tag}c"), decay, keys, on, (1, 2), tag)
    s, mean = F.col(f"{tag}w1"), F.col(f"{tag}x1") / F.col(f"{tag}w1")
    variance = (F.col(f"{tag}y1") / s - mean * mean) * s * s / (s * s - F.col(f"{tag}w2"))
    value = F.when((s > 0) & (s * s > F.col(f"{tag}w2")), F.sqrt(F.greatest(variance, F.lit(0.0))))
    return _settled(df, value, x, math.ceil(3 * span), size, keys, out, tag)


def ewma(df: DataFrame, column: str, span: float, out: str, keys: Keys = (), on: str = "ts", min_periods: int | None = None) -> DataFrame:
    """Exponentially weighted mean over all rows so far (weights adjusted, nulls age the
    weights), null until min_periods values (3 * span) are there."""
    return _unblocked(_mean(df, column, span, out, keys, on, min_periods))


def ewm_volatility(df: DataFrame, column: str, span: float, out: str, keys: Keys = (), on: str = "ts", centered: bool = False) -> DataFrame:
    """Root of the weighted mean square, or with centered the weighted deviation without bias."""
    return _unblocked(_volatility(df, column, span, out, keys, on, centered))


def momentum(df: DataFrame, column: str, horizons: list[tuple[float, float, str]], vol_span: float, scale, keys: Keys = (), on: str = "ts") -> DataFrame:
    """For each (fast, slow, out): the difference of two weighted means by the volatility of
    moves and scale(fast, slow). All means share one sorted pass where their blocks agree."""
    size = _block_rows(1 - alpha_from_span(vol_span))
    df = _blocked(df, size, keys, on)
    w = _by_block(size, keys)
    df = df.withColumn("__ff", ffill(column, w)).withColumn("__move", F.when(F.col(column).isNotNull(), diff("__ff", w)))
    df = _volatility(df, "__move", vol_span, "__vol", keys, on)
    means = sorted({span for fast, slow, _ in horizons for span in (fast, slow)})
    for i, span in enumerate(means):
        df = _mean(df, column, span, f"__m{i}", keys, on)
    for fast, slow, out in horizons:
        gap = F.col(f"__m{means.index(fast)}") - F.col(f"__m{means.index(slow)}")
        df = df.withColumn(out, F.try_divide(gap, F.col("__vol") * scale(fast, slow)))
    return _unblocked(df).drop("__ff", "__move", "__vol", *[f"__m{i}" for i in range(len(means))])


def rows_between(df: DataFrame, start: int, end: int, keys: Keys, on: str = "ts") -> DataFrame:
    """Rows start to end - 1 of each key, counted from 0 in order of time."""
    return df.withColumn("__r", F.row_number().over(ordered(keys, on)) - 1).where(f"__r >= {start} and __r < {end}").drop("__r")


def tail(df: DataFrame, rows: int, keys: Keys, on: str = "ts") -> DataFrame:
    """The last rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(on).desc())
    return df.withColumn("__r", F.row_number().over(w)).where(f"__r <= {rows}").drop("__r")
