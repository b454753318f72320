"""Price analytics: bar returns, momentum signals, random-walk test prices."""

from __future__ import annotations

import math
from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalframe.operators.windows import Keys, alpha_from_span, bfill, diff, ewm_volatility, ffill, momentum, ordered
from causalframe.time import TimeRange, utc_wall


class ReturnType(str, Enum):
    """causal: a gap's return falls on the bar that ends it. trading: prices are filled from the next one first."""

    CAUSAL = "causal"
    TRADING = "trading"


def arithmetic_bar_returns(prices: DataFrame, column: str = "price", step: int = 1, return_type: str | ReturnType = ReturnType.CAUSAL, fill_limit: int | None = None, keys: Keys = (), on: str = "ts", out: str = "ret") -> DataFrame:
    """Differences over `step` bars by key: keys, start, end, ret. Null where the price
    is; the first `step` rows have no bar."""
    if not isinstance(step, int) or isinstance(step, bool) or step < 1:
        raise ValueError(f"a step is an integer above 0, not {step!r}")
    try:
        kind = ReturnType(return_type)
    except ValueError:
        raise ValueError(f"return_type is causal or trading, not {return_type!r}") from None
    w = ordered(keys, on)
    filled = ffill(column, w, fill_limit) if kind is ReturnType.CAUSAL else bfill(column, keys, on, fill_limit)
    df = prices.withColumn("__filled", filled).withColumn("__n", F.row_number().over(w))
    df = df.withColumns({out: F.when(F.col(column).isNotNull(), diff("__filled", w, step)), "start": F.lag(on, step).over(w)})
    return df.where(F.col("__n") > step).select(*keys, "start", F.col(on).alias("end"), out)


def ou_factor(fast_span: float, slow_span: float) -> float:
    """Deviation of the difference of two weighted means of a unit random walk: the root
    of the sum over ages of (F**i - S**i)**2 for the two decays."""
    fast, slow = 1 - alpha_from_span(fast_span), 1 - alpha_from_span(slow_span)

    def geometric(q: float) -> float:
        return q / (1 - q)

    return math.sqrt(geometric(fast * fast) + geometric(slow * slow) - 2 * geometric(fast * slow))


def macd(prices: DataFrame, fast_span: float, slow_span: float, vol_span: float, column: str = "price", keys: Keys = (), on: str = "ts", out: str = "macd") -> DataFrame:
    """Difference of a fast and a slow mean, in units of its deviation for a random walk of
    the price's volatility. Adds one column."""
    return momentum(prices, column, [(fast_span, slow_span, out)], vol_span, ou_factor, keys, on)


def macd_multi_horizon(prices: DataFrame, horizons: list[tuple[int, int]], vol_span: float, column: str = "price", keys: Keys = (), on: str = "ts") -> DataFrame:
    """Long form: keys, time, fast, slow, macd."""
    names = [(f"__h_{fast}_{slow}", fast, slow) for fast, slow in horizons]
    df = momentum(prices, column, [(f, s, n) for n, f, s in names], vol_span, ou_factor, keys, on)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(n).alias("macd")) for n, f, s in names]))
    return df.select(*keys, on, rows.alias("__h")).select(*keys, on, "__h.fast", "__h.slow", "__h.macd")


def risk_adjusted_returns(returns: DataFrame, column: str = "ret", span: float = 30, keys: Keys = (), on: str = "ts", out: str = "risk_adjusted") -> DataFrame:
    """Returns by the volatility known before them."""
    df = ewm_volatility(returns, column, span, "__vol", keys, on)
    return df.withColumn(out, F.try_divide(F.col(column), F.lag("__vol").over(ordered(keys, on)))).drop("__vol")


def compound_interest(calendar: DataFrame, rate: float, on: str = "ts", keys: Keys = ()) -> DataFrame:
    """(1 + rate) to the number of points so far."""
    return calendar.withColumn("value", F.pow(F.lit(1.0 + rate), F.row_number().over(ordered(keys, on))))


def brownian_returns(spark: SparkSession, rows: int, assets: list[str], seed: int = 0) -> DataFrame:
    """Independent normal returns: i, asset, ret."""
    names = F.explode(F.array(*[F.lit(a) for a in assets]))
    return spark.range(rows).select(F.col("id").alias("i"), names.alias("asset")).withColumn("ret", F.randn(seed))


def rebased(df: DataFrame, column: str, keys: Keys = (), out: str = "price") -> DataFrame:
    """Moves each key's series so that its smallest value is 1."""
    return df.withColumn(out, F.col(column) - F.min(column).over(Window.partitionBy(*keys)) + 1)


def market_data(spark: SparkSession, tickers: list[str], time_range: TimeRange, pull: Callable, columns: str = "price double") -> DataFrame:
    """A leaf: what pull(ticker, start, end) gives for each ticker, a pandas frame with ts (UTC
    wall time) and these columns. Tickers are pulled on the executors, each in a task."""
    start, end = utc_wall(time_range.start), utc_wall(time_range.end)
    names = [c.split()[0] for c in columns.split(",")]

    def run(frames):
        for pdf in frames:
            for ticker in pdf["ticker"]:
                found = pull(ticker, start, end)
                yield found[(found["ts"] >= start) & (found["ts"] < end)].assign(ticker=ticker)[["ticker", "ts", *names]]

    one_each = spark.createDataFrame([(t,) for t in tickers], "ticker string").repartition(max(len(tickers), 1), "ticker")
    return one_each.mapInPandas(run, f"ticker string, ts timestamp_ntz, {columns}")


def brownian_prices(spark: SparkSession, rows: int, vols: dict[str, float], seed: int = 0) -> DataFrame:
    """Random walks whose smallest price is 1: i, asset, price."""
    vol = F.create_map(*[F.lit(x) for kv in vols.items() for x in kv])[F.col("asset")]
    walk = F.sum(F.col("ret") * vol).over(Window.partitionBy("asset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    df = brownian_returns(spark, rows, list(vols), seed).withColumn("walk", walk)
    return rebased(df, "walk", ["asset"]).select("i", "asset", "price")
