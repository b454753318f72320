"""Every operator as a query on the test tables, with its DuckDB counterpart.

h is the hourly mean of events.value by event_type, px the daily mean l_extendedprice
by l_returnflag; both are small aggregates of large scans. Nulls are made where
an operator is about them, since the tables have none.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.calendars import Days, OffsetCalendar, TimeOfDayCalendar, UnionCalendar, missing_points
from causalframe.functions import fin, linalg
from causalframe.operators import ml, reshape, stats
from causalframe.operators import windows as win
from causalframe.operators.asof import causal_broadcast, causal_match, causal_resample
from causalframe.time import Interval, TimeOfDay, TimeRange, timestamp, utc_wall
from causalframe.timeframe import dropna, fillna, mask

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ small inputs
H_SQL = "h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL)"
#: h with the values above 50 made null.
HN_SQL = H_SQL + ", hn AS (SELECT event_type, ts, CASE WHEN v <= 50 THEN v END AS v FROM h)"
PX_SQL = "px AS (SELECT l_returnflag AS k, l_shipdate AS ts, avg(l_extendedprice) AS price FROM lineitem GROUP BY ALL)"
CUT = 50.0


def hourly(spark, sf_dir) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("event_type", hour.alias("ts")).agg(F.avg("value").alias("v"))


def hourly_gaps(spark, sf_dir) -> DataFrame:
    return mask(hourly(spark, sf_dir), "v", F.col("v") <= CUT)


def prices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_shipdate").alias("ts")).agg(F.avg("l_extendedprice").alias("price"))


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def kind(spark, sf_dir, name, *columns) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == name).select("user_id", "ts", *columns)


# ------------------------------------------------------------- ranges, intervals
@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 12:00:00'")
def range_view(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return TimeRange(timestamp("2024-01-05"), timestamp("2024-01-12 12:00:00")).view(df, "ts")


@query("SELECT min(ts) AS first_ts, max(ts) + INTERVAL 1 MICROSECOND AS end_ts FROM events")
def range_from_data(spark, sf_dir):
    found = TimeRange.of(table(spark, sf_dir, "events"), "ts")
    return spark.createDataFrame([(utc_wall(found.start), utc_wall(found.end))], "first_ts timestamp_ntz, end_ts timestamp_ntz")


def _span_sql(kind: str) -> str:
    return f"(SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 1 MICROSECOND AS e FROM events WHERE event_type = '{kind}' GROUP BY user_id)"


@query(
    f"""SELECT a.user_id, a.s < b.e AND b.s < a.e AS intersects, a.s <= b.s AND b.e <= a.e AS contains, a.s <= b.s AND b.s < a.e AS holds_start,
 CASE WHEN a.s < b.e AND b.s < a.e THEN greatest(a.s, b.s) END AS both_start, CASE WHEN a.s < b.e AND b.s < a.e THEN least(a.e, b.e) END AS both_end,
 CASE WHEN a.s < b.e AND b.s < a.e THEN least(a.s, b.s) END AS either_start, CASE WHEN a.s < b.e AND b.s < a.e THEN greatest(a.e, b.e) END AS either_end
FROM {_span_sql("view")} a JOIN {_span_sql("error")} b ON a.user_id = b.user_id"""
)
def interval_algebra(spark, sf_dir):
    """Every user's range of views against the range of errors."""
    e = table(spark, sf_dir, "events")
    span = Interval.spanned("ts")
    a, b = (e.where(F.col("event_type") == t).groupBy("user_id").agg(span.start.alias("s"), span.end.alias("e")).alias(n) for t, n in (("view", "a"), ("error", "b")))
    x, y = (Interval(F.col(f"{n}.s"), F.col(f"{n}.e")) for n in "ab")
    both, either = x.intersection(y), x.union(y)
    return a.join(b, "user_id").select(
        "user_id", x.intersects(y).alias("intersects"), x.contains(y).alias("contains"), x.holds(y.start).alias("holds_start"),
        both.start.alias("both_start"), both.end.alias("both_end"), either.start.alias("either_start"), either.end.alias("either_end"),
    )


# -------------------------------------------------------------------- as-of joins
_CLICKS = "SELECT user_id, ts, value AS click_value FROM events WHERE event_type = 'click'"


def _asof_sql(sign: str) -> str:
    return f"""SELECT e.event_id, e.user_id, e.ts, c.ts AS click_ts, c.click_value FROM events e
ASOF LEFT JOIN ({_CLICKS}) c ON e.user_id = c.user_id AND e.ts {sign} c.ts WHERE e.event_type = 'error'"""


def _errors_and_clicks(spark, sf_dir):
    return kind(spark, sf_dir, "click", F.col("value").alias("click_value")), kind(spark, sf_dir, "error", "event_id")


@query(_asof_sql(">="))
def asof_contemp(spark, sf_dir):
    """For every error the latest click of its user, at its own time too."""
    clicks, errors = _errors_and_clicks(spark, sf_dir)
    return causal_match(clicks, errors, keys=["user_id"], contemp=True, matched_time="click_ts", check=False)


@query(_asof_sql(">"))
def asof_strict(spark, sf_dir):
    clicks, errors = _errors_and_clicks(spark, sf_dir)
    return causal_match(clicks, errors, keys=["user_id"], matched_time="click_ts", check=False)


@query(_asof_sql(">="))
def asof_blocks(spark, sf_dir):
    """The same, windowed day by day with the last click of each day carried over."""
    clicks, errors = _errors_and_clicks(spark, sf_dir)
    return causal_match(clicks, errors, keys=["user_id"], contemp=True, matched_time="click_ts", block=timedelta(days=1), check=False)


def _fill_sql(limit: int) -> str:
    return f"""WITH m AS ({_asof_sql(">=")}),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, click_ts ORDER BY ts, event_id) - 1 AS k, min(ts) OVER (PARTITION BY user_id, click_ts) AS land FROM m)
SELECT event_id, user_id, ts, CASE WHEN k <= {limit} THEN click_value END AS click_value FROM k"""


def _filled(spark, sf_dir, limit):
    clicks, errors = _errors_and_clicks(spark, sf_dir)
    return causal_match(clicks, errors, keys=["user_id"], contemp=True, fill_limit=limit, check=False)


@query(_fill_sql(0))
def asof_fill_limit_0(spark, sf_dir):
    return _filled(spark, sf_dir, 0)


@query(_fill_sql(2))
def asof_fill_limit_2(spark, sf_dir):
    return _filled(spark, sf_dir, 2)


_DAILY_ERRORS = "d AS (SELECT date_trunc('day', ts) AS ts, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL)"


@query(f"WITH {_DAILY_ERRORS}, t AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS ts FROM events) SELECT t.event_type, t.ts, d.errors FROM t ASOF LEFT JOIN d ON t.ts > d.ts")
def asof_broadcast_panel(spark, sf_dir):
    """One daily series onto every hour of every event type, strictly before."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    daily = kind(spark, sf_dir, "error").groupBy(day.alias("ts")).agg(F.count(F.lit(1)).alias("errors"))
    return causal_broadcast(daily, hourly(spark, sf_dir).select("event_type", "ts"))


# ------------------------------------------------------------------------ resample
def _resample_sql(agg: str, sign: str = "<=") -> str:
    return f"""WITH d AS (SELECT user_id, ts, CASE WHEN value <= 60 THEN value END AS v FROM events WHERE event_type = 'view'),
t AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'),
b AS (SELECT d.user_id, t.ts AS bucket, d.ts, d.v FROM d ASOF JOIN t ON d.user_id = t.user_id AND d.ts {sign} t.ts),
g AS (SELECT user_id, bucket, {agg} AS v FROM b GROUP BY ALL)
SELECT e.event_id, e.user_id, e.ts, g.v FROM events e LEFT JOIN g ON e.user_id = g.user_id AND e.ts = g.bucket WHERE e.event_type = 'purchase'"""


def _resampled(spark, sf_dir, method, contemp=True):
    views = mask(kind(spark, sf_dir, "view", F.col("value").alias("v")), "v", F.col("v") <= 60)
    return causal_resample(views, kind(spark, sf_dir, "purchase", "event_id"), method, keys=["user_id"], contemp=contemp, check=False)


def _resample_query(name: str, method: str, agg: str, contemp: bool = True, digits: int | None = 4) -> None:
    def run(spark, sf_dir):
        found = _resampled(spark, sf_dir, method, contemp)
        return rounded(found, "v", digits=digits) if digits else found

    run.__name__ = name
    sql = _resample_sql(agg, "<=" if contemp else "<")
    query(sql.replace("g.v FROM", f"round(g.v, {digits}) AS v FROM") if digits else sql)(run)


_resample_query("resample_last", "last", "arg_max(v, ts) FILTER (v IS NOT NULL)")
_resample_query("resample_first", "first", "arg_min(v, ts) FILTER (v IS NOT NULL)")
_resample_query("resample_sum", "sum", "coalesce(sum(v), 0)")
_resample_query("resample_mean", "mean", "avg(v)")
_resample_query("resample_min", "min", "min(v)")
_resample_query("resample_max", "max", "max(v)")
_resample_query("resample_std", "std", "stddev_samp(v)")
_resample_query("resample_count", "count", "count(v)", digits=None)
_resample_query("resample_sum_strict", "sum", "coalesce(sum(v), 0)", contemp=False)


@query(_resample_sql("2 * sum(v)").replace("g.v FROM", "round(g.v, 4) AS v FROM"))
def resample_callable(spark, sf_dir):
    """An aggregate of one's own."""
    return rounded(_resampled(spark, sf_dir, lambda c: F.sum(F.col(c) * 2)), "v")


@query(
    f"""WITH {H_SQL}, d AS (SELECT ts, avg(v) AS v FROM h GROUP BY ts),
t AS (SELECT ts FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(ts)),
b AS (SELECT t.ts AS bucket, d.v FROM d ASOF JOIN t ON d.ts <= t.ts)
SELECT t.ts, round(m, 4) AS v FROM t LEFT JOIN (SELECT bucket, avg(v) AS m FROM b GROUP BY bucket) ON ts = bucket"""
)
def resample_calendar(spark, sf_dir):
    """One series without keys onto the days of a calendar."""
    data = hourly(spark, sf_dir).groupBy("ts").agg(F.avg("v").alias("v"))
    days = OffsetCalendar(timedelta(days=1)).to_df(spark, TimeRange(timestamp("2023-12-31 12:00:00"), timestamp("2024-01-31 12:00:00")))
    return rounded(causal_resample(data, days, "mean", contemp=True, check=False), "v")


# ----------------------------------------------------------------------- calendars
_BDAYS = """days AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5)"""
_NY = "timezone('UTC', timezone('America/New_York', d + TIME '15:45:00'))"
QUARTER = TimeRange(timestamp("2024-01-03"), timestamp("2024-03-20"))
CLOSE = TimeOfDay.from_str("15:45 America/New_York")
_IN_QUARTER = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-03-20'"
HOLIDAYS = (date(2024, 1, 15), date(2024, 2, 19))


@query(f"WITH {_BDAYS} SELECT ts FROM (SELECT {_NY} AS ts FROM days) WHERE {_IN_QUARTER}")
def calendar_bday_tod(spark, sf_dir):
    return TimeOfDayCalendar(CLOSE).to_df(spark, QUARTER)


@query(f"WITH {_BDAYS} SELECT ts FROM (SELECT {_NY} AS ts FROM days WHERE d NOT IN (DATE '2024-01-15', DATE '2024-02-19')) WHERE {_IN_QUARTER}")
def calendar_holidays(spark, sf_dir):
    return TimeOfDayCalendar(CLOSE, Days(holidays=frozenset(HOLIDAYS))).to_df(spark, QUARTER)


_HALF_DAY = TimeRange(timestamp("2024-01-05 00:02:00"), timestamp("2024-01-05 12:00:00"))


@query("SELECT ts FROM generate_series(TIMESTAMP '2024-01-05 00:05:00', TIMESTAMP '2024-01-05 11:55:00', INTERVAL 5 MINUTE) t(ts)")
def calendar_offset_5min(spark, sf_dir):
    return OffsetCalendar(timedelta(minutes=5)).to_df(spark, _HALF_DAY)


@query(
    """SELECT ts FROM generate_series(TIMESTAMP '2024-01-05 01:00:00', TIMESTAMP '2024-01-05 11:00:00', INTERVAL 1 HOUR) t(ts)
UNION SELECT ts FROM generate_series(TIMESTAMP '2024-01-05 00:30:00', TIMESTAMP '2024-01-05 11:30:00', INTERVAL 30 MINUTE) t(ts)"""
)
def calendar_union(spark, sf_dir):
    calendar = UnionCalendar.merge([OffsetCalendar(timedelta(hours=1)), OffsetCalendar(timedelta(minutes=30))])
    return calendar.to_df(spark, _HALF_DAY)


@query(
    """SELECT ts FROM generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR) t(ts)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND date_trunc('hour', e.ts) = t.ts)"""
)
def calendar_missing_points(spark, sf_dir):
    points = OffsetCalendar(timedelta(hours=1)).to_df(spark, TimeRange(timestamp("2024-01-01"), timestamp("2024-02-01")))
    return missing_points(points, hourly(spark, sf_dir).where("event_type = 'error'"))


# ------------------------------------------------------------------------- windows
_W = "PARTITION BY event_type ORDER BY ts"
KEY = ["event_type"]


@query(f"WITH {HN_SQL} SELECT event_type, ts, round(last_value(v IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) AS v FROM hn")
def ffill(spark, sf_dir):
    df = hourly_gaps(spark, sf_dir)
    return rounded(df.withColumn("v", win.ffill("v", win.ordered(KEY))), "v")


@query(f"WITH {HN_SQL} SELECT event_type, ts, round(last_value(v IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS v FROM hn")
def ffill_limit(spark, sf_dir):
    df = hourly_gaps(spark, sf_dir)
    return rounded(df.withColumn("v", win.ffill("v", win.ordered(KEY), 1)), "v")


@query(f"WITH {HN_SQL} SELECT event_type, ts, round(first_value(v IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS v FROM hn")
def bfill(spark, sf_dir):
    return rounded(hourly_gaps(spark, sf_dir).withColumn("v", win.bfill("v", KEY)), "v")


@query(f"WITH {H_SQL} SELECT event_type, ts, round(v - lag(v, 3) OVER ({_W}), 7) AS d FROM h")
def diff_step(spark, sf_dir):
    df = hourly(spark, sf_dir)
    return rounded(df.select(*KEY, "ts", win.diff("v", win.ordered(KEY), 3).alias("d")), "d", digits=7)


@query(f"WITH {H_SQL} SELECT event_type, ts, round(lag(v, 1) OVER ({_W}), 4) AS v FROM h")
def shift_1(spark, sf_dir):
    df = hourly(spark, sf_dir)
    return rounded(df.withColumn("v", win.shift("v", win.ordered(KEY))), "v")


def _returns_sql(fill: str, step: int) -> str:
    return f"""WITH {HN_SQL}, f AS (SELECT *, {fill} AS f FROM hn),
r AS (SELECT event_type, lag(ts, {step}) OVER ({_W}) AS "start", ts AS "end", CASE WHEN v IS NOT NULL THEN f - lag(f, {step}) OVER ({_W}) END AS ret, row_number() OVER ({_W}) AS n FROM f)
SELECT event_type, "start", "end", round(ret, 4) AS ret FROM r WHERE n > {step}"""


@query(_returns_sql(f"last_value(v IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING)", 1))
def bar_returns_causal(spark, sf_dir):
    return rounded(fin.arithmetic_bar_returns(hourly_gaps(spark, sf_dir), "v", keys=KEY), "ret")


@query(_returns_sql(f"first_value(v IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", 2))
def bar_returns_trading(spark, sf_dir):
    return rounded(fin.arithmetic_bar_returns(hourly_gaps(spark, sf_dir), "v", 2, "trading", keys=KEY), "ret")


def _ewma_sql(x: str, span: int, source: str, keys: str = "event_type", order: str = "rn") -> str:
    """Closed form over a numbered source: fine for the short series of the tests."""
    lam = 1 - 2 / (1 + span)
    w = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    up = f"pow({lam!r}, -{order})"
    return f"CASE WHEN count({x}) {w} >= {3 * span} THEN sum({x} * {up}) {w} / sum(CASE WHEN {x} IS NOT NULL THEN {up} END) {w} END"


_HR = HN_SQL + f", r AS (SELECT *, row_number() OVER ({_W}) AS rn FROM hn), r2 AS (SELECT *, v * v AS sq FROM r)"
_PXR = PX_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) AS rn, price - lag(price) OVER (PARTITION BY k ORDER BY ts) AS move FROM px), r2 AS (SELECT *, move * move AS sq FROM r)"


@query(f"WITH {_HR} SELECT event_type, ts, round({_ewma_sql('v', 10, 'r')}, 4) AS v FROM r")
def ewma_span10(spark, sf_dir):
    return rounded(win.ewma(hourly_gaps(spark, sf_dir), "v", 10, "v", KEY), "v")


@query(f"WITH {_HR} SELECT event_type, ts, round(sqrt({_ewma_sql('sq', 8, 'r2')}), 4) AS vol FROM r2")
def ewm_vol(spark, sf_dir):
    df = win.ewm_volatility(hourly_gaps(spark, sf_dir), "v", 8, "vol", KEY)
    return rounded(df.select(*KEY, "ts", "vol"), "vol")


def _std_sql(span: int) -> str:
    lam = 1 - 2 / (1 + span)
    w = f"OVER ({_W.replace('ts', 'rn')} ROWS UNBOUNDED PRECEDING)"
    s0, s1, s2, q = (f"sum(CASE WHEN v IS NOT NULL THEN pow({lam!r}, -rn * {p}) * {t} END) {w}" for p, t in ((1, "1"), (1, "v"), (1, "v * v"), (2, "1")))
    return f"WITH {_HR} SELECT event_type, ts, round(CASE WHEN count(v) {w} >= {3 * span} THEN sqrt(({s2} / {s0} - pow({s1} / {s0}, 2)) * {s0} * {s0} / ({s0} * {s0} - {q})) END, 3) AS vol FROM r"


@query(_std_sql(20))
def ewm_vol_centered(spark, sf_dir):
    df = win.ewm_volatility(hourly_gaps(spark, sf_dir), "v", 20, "vol", KEY, centered=True)
    return rounded(df.select(*KEY, "ts", "vol"), "vol", digits=3)


def _macd_sql(fast: int, slow: int, vol: int) -> str:
    e = [_ewma_sql(x, n, "r2", "k") for x, n in (("price", fast), ("price", slow), ("sq", vol))]
    return f"({e[0]} - {e[1]}) / (sqrt({e[2]}) * {fin.ou_factor(fast, slow)!r})"


@query(f"WITH {_PXR} SELECT k, ts, round({_macd_sql(10, 20, 20)}, 4) AS macd FROM r2")
def macd_10_20(spark, sf_dir):
    return rounded(fin.macd(prices(spark, sf_dir), 10, 20, 20, keys=["k"]).select("k", "ts", "macd"), "macd")


@query(
    f"WITH {_PXR}, f AS (SELECT * FROM r2) SELECT k, ts, 8 AS fast, 16 AS slow, round({_macd_sql(8, 16, 20)}, 4) AS macd FROM f"
    f" UNION ALL SELECT k, ts, 16 AS fast, 32 AS slow, round({_macd_sql(16, 32, 20)}, 4) AS macd FROM f"
)
def macd_multi(spark, sf_dir):
    return rounded(fin.macd_multi_horizon(prices(spark, sf_dir), [(8, 16), (16, 32)], 20, keys=["k"]), "macd")


@query(f"WITH {_PXR}, f AS (SELECT * FROM r2), v AS (SELECT k, ts, rn, move, sqrt({_ewma_sql('sq', 30, 'r2', 'k')}) AS vol FROM f) SELECT k, ts, round(move / lag(vol) OVER (PARTITION BY k ORDER BY rn), 4) AS risk_adjusted FROM v")
def risk_adj_returns(spark, sf_dir):
    moves = prices(spark, sf_dir).withColumn("ret", win.diff("price", win.ordered(["k"])))
    return rounded(fin.risk_adjusted_returns(moves, keys=["k"]).select("k", "ts", "risk_adjusted"), "risk_adjusted")


@query(f"WITH {HN_SQL} SELECT event_type, ts, round(CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END, 4) AS s, round(CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END, 4) AS m FROM hn WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_3(spark, sf_dir):
    w = win.ordered(KEY)
    df = hourly_gaps(spark, sf_dir)
    return rounded(df.select(*KEY, "ts", win.rolling("v", w, 3).alias("s"), win.rolling("v", w, 3, "mean").alias("m")), "s", "m")


@query(f"WITH {H_SQL} SELECT event_type, ts, round(sum(v) OVER ({_W} ROWS UNBOUNDED PRECEDING), 6) AS c FROM h")
def cumsum(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select(*KEY, "ts", win.cumsum("v", win.ordered(KEY)).alias("c")), "c", digits=6)


@query(f"WITH {H_SQL}, x AS (SELECT event_type, ts, (v - 50) / 400 AS x FROM h) SELECT event_type, ts, round(product(1 + x) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) AS c FROM x")
def cumprod(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumn("x", 1 + (F.col("v") - 50) / 400)
    return rounded(df.select(*KEY, "ts", win.cumprod("x", win.ordered(KEY)).alias("c")), "c")


@query("SELECT d AS ts, round(pow(1.0001, row_number() OVER (ORDER BY d)), 6) AS value FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR) t(d)")
def compound_interest(spark, sf_dir):
    points = OffsetCalendar(timedelta(hours=1)).to_df(spark, TimeRange(timestamp("2024-01-01"), timestamp("2024-02-01")))
    return rounded(fin.compound_interest(points, 0.0001), "value", digits=6)


@query("SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedup_keep_last(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return win.keep_last(df, ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def tail_3(spark, sf_dir):
    """A top-k report."""
    return win.tail(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), 3, ["user_id"])


@query(f"WITH {H_SQL}, r AS (SELECT *, row_number() OVER ({_W}) - 1 AS rn FROM h) SELECT event_type, ts, round(v, 4) AS v FROM r WHERE rn >= 10 AND rn < 20")
def rows_slice(spark, sf_dir):
    """Rows 10 to 19 of every series, by place."""
    return rounded(win.rows_between(hourly(spark, sf_dir), 10, 20, KEY), "v")


# ------------------------------------------------------------------------- upserts
_OLD = "old AS (SELECT event_id, ts, CASE WHEN value <= 60 THEN value END AS value FROM events WHERE ts < TIMESTAMP '2024-01-16')"
_NEW = "new AS (SELECT event_id, ts, value, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-14')"
NEW_RANGE = TimeRange(timestamp("2024-01-14"), timestamp("2024-02-01"))


def _old_new(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = mask(TimeRange(None, timestamp("2024-01-16")).view(e, "ts").select("event_id", "ts", "value"), "value", F.col("value") <= 60)
    return old, TimeRange(NEW_RANGE.start, None).view(e, "ts").select("event_id", "ts", "value", "event_type")


@query(f"WITH {_OLD}, {_NEW} SELECT event_id, ts, value, NULL::VARCHAR AS event_type FROM old UNION ALL SELECT event_id, ts, value, event_type FROM new WHERE ts > (SELECT max(ts) FROM old)")
def append_new_rows(spark, sf_dir):
    from causalframe.sources.dataset import Dataset
    from causalframe.sources.store import MemoryStore

    old, new = _old_new(spark, sf_dir)
    first = Dataset.build("events", old, store=MemoryStore())
    first.metadata.store.replace(first)
    first.metadata.append(new, NEW_RANGE)
    return first.metadata.read()


@query(f"WITH {_OLD}, {_NEW} SELECT event_id, ts, value, NULL::VARCHAR AS event_type FROM old UNION ALL SELECT event_id, ts, value, event_type FROM new WHERE ts > (SELECT max(ts) FROM old)")
def append_parquet_store(spark, sf_dir):
    """The same in a store of Parquet snapshots partitioned by day."""
    from causalframe.sources.dataset import Dataset
    from causalframe.sources.scratch import scratch_root
    from causalframe.sources.store import ParquetStore

    old, new = _old_new(spark, sf_dir)
    first = Dataset.build("events", old, store=ParquetStore(spark, scratch_root(spark)))
    first.metadata.store.replace(first)
    first.metadata.append(new, NEW_RANGE)
    return first.metadata.read()


@query(f"WITH {_OLD}, {_NEW} SELECT event_id, ts, value, NULL::VARCHAR AS event_type FROM old WHERE ts >= TIMESTAMP '2024-01-10' UNION ALL SELECT event_id, ts, value, event_type FROM new WHERE ts > (SELECT max(ts) FROM old) AND ts < TIMESTAMP '2024-01-18'")
def read_parquet_range(spark, sf_dir):
    """A slice across two snapshots; days outside are never opened."""
    from causalframe.sources.dataset import Dataset
    from causalframe.sources.scratch import scratch_root
    from causalframe.sources.store import ParquetStore

    old, new = _old_new(spark, sf_dir)
    first = Dataset.build("events", old, store=ParquetStore(spark, scratch_root(spark)))
    first.metadata.store.replace(first)
    first.metadata.append(new, NEW_RANGE)
    return first.metadata.read(TimeRange(timestamp("2024-01-10"), timestamp("2024-01-18")))


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(o.event_id, n.event_id) AS event_id, coalesce(o.ts, n.ts) AS ts, coalesce(o.value, n.value) AS value, n.event_type FROM old o FULL JOIN new n ON o.event_id = n.event_id AND o.ts = n.ts")
def merge_combine_first(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return reshape.combine_first(old, new, ["event_id", "ts"])


@query(f"WITH {_OLD}, {_NEW} SELECT event_id, ts, value, event_type FROM new")
def replace_latest(spark, sf_dir):
    from causalframe.sources.dataset import Dataset
    from causalframe.sources.store import MemoryStore

    old, new = _old_new(spark, sf_dir)
    first = Dataset.build("events", old, store=MemoryStore())
    first.metadata.store.replace(first)
    first.metadata.replace(new, NEW_RANGE)
    return first.metadata.read()


# ------------------------------------------------------------------ shape, set algebra
@query("SELECT l_orderkey, l_linenumber, variable, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem) ON q, d, t INTO NAME variable VALUE value)")
def unpivot_long(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    return reshape.stack(df, ["l_orderkey", "l_linenumber"], ["q", "d", "t"])


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {H_SQL} SELECT ts, " + ", ".join(f"round(max(v) FILTER (event_type = '{k}'), 4) AS {k}" for k in KINDS) + " FROM h GROUP BY ts")
def pivot_wide(spark, sf_dir):
    return rounded(reshape.unstack(hourly(spark, sf_dir), ["ts"], "event_type", "v", KINDS), *KINDS)


@query("SELECT o_orderkey AS id, o_totalprice AS price, NULL::DOUBLE AS bal FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def concat_union_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_acctbal").alias("bal"))
    return reshape.concat_rows([orders, customers])


_O, _L = "SELECT o_orderdate AS ts FROM orders", "SELECT l_shipdate AS ts FROM lineitem"


def _dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts")), table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"))


@query(f"{_O} UNION {_L}")
def index_union(spark, sf_dir):
    return reshape.index_union(*_dates(spark, sf_dir))


@query(f"{_L} EXCEPT {_O}")
def index_difference(spark, sf_dir):
    orders, lines = _dates(spark, sf_dir)
    return reshape.index_difference(lines, orders)


@query(f"({_L} EXCEPT {_O}) UNION ALL ({_O} EXCEPT {_L})")
def index_symmetric_difference(spark, sf_dir):
    return reshape.index_symmetric_difference(*_dates(spark, sf_dir))


@query("WITH o AS (SELECT o_orderdate AS ts, sum(o_totalprice) AS x FROM orders GROUP BY ALL), l AS (SELECT l_shipdate AS ts, sum(l_extendedprice) AS x FROM lineitem GROUP BY ALL) SELECT coalesce(o.ts, l.ts) AS ts, round(o.x - l.x, 2) AS x FROM o FULL JOIN l ON o.ts = l.ts")
def index_aligned_minus(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("x"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.sum("l_extendedprice").alias("x"))
    return rounded(reshape.outer_arithmetic(o, li, ["ts"], "x", lambda a, b: a - b), "x", digits=2)


@query(f"WITH {H_SQL} SELECT ts, " + ", ".join(f"round(max(v) FILTER (event_type = '{k}'), 4) AS {k}" for k in KINDS) + " FROM h GROUP BY ts")
def concat_columns(spark, sf_dir):
    h = hourly(spark, sf_dir)
    return rounded(reshape.concat_columns([h.where(F.col("event_type") == k).select("ts", F.col("v").alias(k)) for k in KINDS], ["ts"]), *KINDS)


@query(f"WITH {HN_SQL}, f AS (SELECT event_type, ts, coalesce(v, 0) AS filled, v FROM hn) SELECT event_type, count(*) AS n, count(v) AS there, round(sum(filled), 3) AS total FROM f GROUP BY ALL")
def fillna_dropna(spark, sf_dir):
    gaps = hourly_gaps(spark, sf_dir)
    filled = fillna(gaps.withColumn("filled", F.col("v")), 0.0, ["filled"])
    there = dropna(gaps, ["v"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("there"))
    sums = filled.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("filled"), 3).alias("total"))
    return sums.join(there, "event_type", "left").select("event_type", "n", F.coalesce("there", F.lit(0)).cast("long").alias("there"), "total")


# ------------------------------------------------------------------------ algebra
def _arrays(spark, sf_dir) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", e.alias("l"), F.reverse(e).alias("r"))


_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS r FROM embeddings)"


@query(f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * r[i])), 6) AS v FROM e")
def vec_dot(spark, sf_dir):
    return rounded(_arrays(spark, sf_dir).select("vec_id", linalg.dot_array(F.col("l"), F.col("r")).alias("v")), "v", digits=6)


@query(f"WITH {_E} SELECT vec_id, i AS col, round(l[i + 1] * r[i + 1], 6) AS v FROM (SELECT *, unnest(range(0, len(l))) AS i FROM e)")
def vec_hadamard(spark, sf_dir):
    df = _arrays(spark, sf_dir).select("vec_id", F.posexplode(linalg.hadamard_array(F.col("l"), F.col("r"))).alias("col", "v"))
    return rounded(df.withColumn("col", F.col("col").cast("long")), "v", digits=6)


def _long(spark, sf_dir):
    """Vectors with gaps, and for each a matrix of three rows: the vector reversed, the
    vector, and their products."""
    arr = _arrays(spark, sf_dir)
    v = arr.select("vec_id", F.posexplode("l").alias("col", "v"))
    v = v.withColumn("v", F.when(~((F.col("vec_id") % 7 == 0) & (F.col("col") == 2)), F.col("v")))
    rows = F.array(F.col("r"), F.col("l"), linalg.hadamard_array(F.col("l"), F.col("r")))
    m = arr.select("vec_id", F.posexplode(rows).alias("row", "x")).select("vec_id", "row", F.posexplode("x").alias("col", "m"))
    return v, m


_LONG = _E + """, v AS (SELECT vec_id, CAST(i AS INTEGER) AS col, CASE WHEN NOT (vec_id % 7 = 0 AND i = 2) THEN l[i + 1] END AS v FROM (SELECT *, unnest(range(0, len(l))) AS i FROM e)),
m AS (SELECT vec_id, CAST(k AS INTEGER) AS row, CAST(i AS INTEGER) AS col, CASE k WHEN 0 THEN r[i + 1] WHEN 1 THEN l[i + 1] ELSE l[i + 1] * r[i + 1] END AS m
 FROM (SELECT *, unnest(range(0, len(l))) AS i FROM e), (SELECT unnest(range(0, 3)) AS k)),
mv AS (SELECT m.vec_id, m.row AS col, CASE WHEN count(m * v) = count(*) THEN sum(m * v) END AS v FROM m LEFT JOIN v ON m.vec_id = v.vec_id AND m.col = v.col GROUP BY ALL)"""


@query(f"WITH {_LONG} SELECT vec_id, col, round(v, 6) AS v FROM mv")
def mat_vec(spark, sf_dir):
    v, m = _long(spark, sf_dir)
    return rounded(linalg.mat_vec(m, v, ["vec_id"]), "v", digits=6)


@query(f"WITH {_LONG}, lv AS (SELECT * FROM v WHERE col < 3) SELECT coalesce(lv.vec_id, mv.vec_id) AS vec_id, round(CASE WHEN count(lv.v * mv.v) = count(*) THEN sum(lv.v * mv.v) END, 6) AS v FROM lv FULL JOIN mv ON lv.vec_id = mv.vec_id AND lv.col = mv.col GROUP BY ALL")
def bilinear(spark, sf_dir):
    v, m = _long(spark, sf_dir)
    return rounded(linalg.bilinear(v.where("col < 3"), m, v, ["vec_id"]), "v", digits=6)


@query(f"WITH {HN_SQL} SELECT event_type, date_trunc('day', ts) AS ts, round(CASE WHEN count(v) = count(*) THEN sum(v) END, 4) AS s FROM hn GROUP BY ALL")
def skipna_false_sum(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    df = hourly_gaps(spark, sf_dir).groupBy("event_type", day.alias("ts")).agg(linalg.strict_sum("v").alias("s"))
    return rounded(df, "s")


@query("SELECT a.r AS row, b.r AS col FROM (SELECT DISTINCT l_returnflag AS r FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_returnflag AS r FROM lineitem) b")
def square_labels(spark, sf_dir):
    return linalg.square_labels(table(spark, sf_dir, "lineitem"), "l_returnflag")


# --------------------------------------------------------------------- statistics
@query(
    """SELECT variable, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min,
round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75, max(x) AS max
FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS variable, unnest([l_quantity, l_extendedprice, l_discount]) AS x FROM lineitem) GROUP BY variable"""
)
def describe_stats(spark, sf_dir):
    found = stats.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(found, "mean", "std", "p25", "p50", "p75")


@query(
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9]) AS edges FROM lineitem)
SELECT CAST(len(list_filter(edges, lambda e: e <= l_extendedprice)) AS INTEGER) AS bucket, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem, q GROUP BY ALL"""
)
def quantile_buckets(spark, sf_dir):
    return rounded(stats.quantile_buckets(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount"), "mean", digits=6)


_CORR = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _CORR for b in _CORR))
def corr_matrix(spark, sf_dir):
    return rounded(stats.correlations(table(spark, sf_dir, "lineitem"), _CORR), "corr", digits=6)


@query("SELECT l_returnflag, 'l_quantity' AS variable, count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 4) AS p25, round(quantile_cont(l_quantity, 0.5), 4) AS p50, round(quantile_cont(l_quantity, 0.75), 4) AS p75, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag")
def describe_by_key(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_returnflag"]), "mean", "std", "p25", "p50", "p75")


@query("SELECT n.n_name, c.c_name FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey")
def reindex_left(spark, sf_dir):
    """Every row of the target with what the data has for it."""
    target = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    data = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_name")
    return reshape.reindex(target, data, ["k"]).select("n_name", "c_name")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY ALL")
def histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", 10)


# --------------------------------------------------------------------- walk-forward
_DAYS = """f AS (SELECT date_trunc('day', ts) AS ts, avg(value) AS x FROM events WHERE event_type = 'view' GROUP BY ALL),
y AS (SELECT date_trunc('day', ts) AS ts, avg(value) AS y FROM events WHERE event_type = 'click' GROUP BY ALL),
j AS (SELECT y.ts, y.y, f.x, row_number() OVER (ORDER BY y.ts) - 1 AS rn FROM y ASOF LEFT JOIN f ON y.ts > f.ts),
n AS (SELECT count(*) AS n FROM j)"""
_ROLL = _DAYS + """, ends AS (SELECT unnest(range(6, n, 3)) AS e FROM n UNION SELECT n FROM n),
b AS (SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INTEGER) AS batch, greatest(e - 10, 0) AS s, e FROM ends),
r AS (SELECT b.batch, j.rn, j.ts, j.x, j.y FROM b JOIN j ON j.rn >= b.s AND j.rn < b.e)"""


def _daily(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events")
    return tuple(e.where(F.col("event_type") == t).groupBy(day.alias("ts")).agg(F.avg("value").alias(c)) for t, c in (("view", "x"), ("click", "y")))


def _batches(spark, sf_dir):
    x, y = _daily(spark, sf_dir)
    return ml.walk_forward(x, y, 10, min_periods=6, step_size=3, strict_step_size=False, check=False)


@query(f"WITH {_ROLL} SELECT batch, rn, ts, round(x, 6) AS x, round(y, 6) AS y FROM r")
def walkforward_batches(spark, sf_dir):
    return rounded(_batches(spark, sf_dir).select("batch", "rn", "ts", "x", "y"), "x", "y", digits=6)


@query(
    f"""WITH {_DAYS}, p AS (SELECT unnest(range(0, n, 7)) AS s, n FROM n), q AS (SELECT s, lead(s) OVER (ORDER BY s) AS e, n FROM p),
b AS (SELECT s, CASE WHEN e IS NOT NULL THEN e WHEN n - s > 2 THEN n END AS e FROM q)
SELECT CAST(s // 7 AS INTEGER) AS batch, rn, ts, round(x, 6) AS x, round(y, 6) AS y FROM b JOIN j ON rn >= s AND rn < e"""
)
def walkforward_sequential(spark, sf_dir):
    x, y = _daily(spark, sf_dir)
    rows = ml.walk_forward(x, y, 7, min_periods=2, check=False)
    return rounded(rows.select("batch", "rn", "ts", "x", "y"), "x", "y", digits=6)


@query(f"WITH {_ROLL} SELECT batch, max(ts) AS model_ts, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, CAST(regr_count(y, x) AS BIGINT) AS n FROM r GROUP BY batch")
def walkforward_ols(spark, sf_dir):
    return rounded(ml.fit_ols(_batches(spark, sf_dir), "x", "y"), "slope", "intercept")


def _apply_sql(sign: str) -> str:
    return f"""WITH {_ROLL}, m AS (SELECT max(ts) AS model_ts, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM r GROUP BY batch)
SELECT f.ts, m.model_ts, round(intercept + slope * f.x, 4) AS prediction FROM f ASOF JOIN m ON f.ts {sign} m.model_ts"""


def _applied(spark, sf_dir, contemp):
    models = ml.fit_ols(_batches(spark, sf_dir), "x", "y").select("model_ts", "slope", "intercept")
    found = ml.predict_line(ml.apply_models(models, _daily(spark, sf_dir)[0], contemp), "x")
    return rounded(found.select("ts", "model_ts", "prediction"), "prediction")


@query(_apply_sql(">="))
def apply_models_contemp(spark, sf_dir):
    return _applied(spark, sf_dir, True)


@query(_apply_sql(">"))
def apply_models_strict(spark, sf_dir):
    return _applied(spark, sf_dir, False)


@query(
    f"""WITH {_ROLL}, m AS (SELECT max(ts) AS model_ts, quantile_cont(y, 0.5) AS median FROM r GROUP BY batch)
SELECT f.ts, round(m.median, 6) AS median FROM f ASOF JOIN m ON f.ts > m.model_ts"""
)
def walkforward_models(spark, sf_dir):
    """Models of any kind, fitted batch by batch in parallel and applied point in time."""
    import pandas as pd

    models = ml.fit_models(_batches(spark, sf_dir), lambda pdf: float(pdf["y"].median()))
    x, _ = _daily(spark, sf_dir)
    applied = ml.apply_models(models, x, values=["model"])
    return rounded(ml.apply_pickled(applied, lambda m, pdf: pd.DataFrame({"ts": pdf["ts"], "median": m}), "ts timestamp_ntz, median double"), "median", digits=6)


@query(_apply_sql(">"))
def walkforward_pipelines(spark, sf_dir):
    """A pipeline of a scaling and an estimator, a copy of it fitted on every batch."""
    models = ml.fit_pipelines(_batches(spark, sf_dir), ml.LocalPipeline([ml.Scale(), ml.Fitted(ml.LeastSquares())]), ["x"], ["y"])
    found = ml.apply_pipelines(models, _daily(spark, sf_dir)[0], ["x"], ["y"])
    return rounded(found.withColumnRenamed("y", "prediction"), "prediction")


@query(f"WITH {_DAYS} SELECT CAST(0 AS INTEGER) AS batch, max(ts) AS model_ts, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, CAST(regr_count(y, x) AS BIGINT) AS n FROM j")
def walkforward_all(spark, sf_dir):
    """Without a window: one batch of all rows."""
    x, y = _daily(spark, sf_dir)
    return rounded(ml.fit_ols(ml.walk_forward(x, y, None, check=False), "x", "y"), "slope", "intercept")


_LINE = f"WITH {_DAYS}, d AS (SELECT f.ts, f.x, y.y FROM f JOIN y ON f.ts = y.ts), m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d WHERE x > 49)"


def _steps(spark, sf_dir, last) -> DataFrame:
    """Univariate and joint steps, then an estimator: fitted on days with x above 49, applied to all."""
    x, y = _daily(spark, sf_dir)
    fit_on = ml.Bivariate(x, y)
    above = ml.Univariate(lambda df, least: df.where(F.col("x") > least), 49, on_y=False)
    together = ml.Joint(lambda a, b: (a.na.drop(), b.join(a, "ts", "left_semi")))
    ml.Pipeline([above, together, last]).fit(fit_on)
    return rounded(ml.Pipeline([last]).transform(ml.Bivariate(x)).y, "y")


@query(f"{_LINE} SELECT f.ts, round(a * f.x + b, 4) AS y FROM f, m")
def pipeline_linear(spark, sf_dir):
    return _steps(spark, sf_dir, ml.LinearEstimator(["x"], ["y"], ["ts"]))


@query(f"{_LINE} SELECT f.ts, round(a * f.x + b, 4) AS y FROM f, m")
def pipeline_estimator(spark, sf_dir):
    """The same with an estimator on pandas frames."""
    return _steps(spark, sf_dir, ml.Estimator(ml.LeastSquares(), ["x"], ["y"], ["ts"]))


@query("WITH d AS (SELECT l_returnflag AS k, l_shipdate AS ts, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL) SELECT k, ts, top, round(top - min(top) OVER (PARTITION BY k) + 1, 4) AS price FROM d")
def rebased_prices(spark, sf_dir):
    """Every series moved so that its smallest price is 1."""
    top = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_shipdate").alias("ts")).agg(F.max("l_extendedprice").alias("top"))
    return rounded(fin.rebased(top, "top", ["k"]), "price")


@query("SELECT c_mktsegment AS ticker, d AS ts, length(c_mktsegment) + epoch(d - TIMESTAMP '2024-01-01') / 86400 AS price FROM (SELECT DISTINCT c_mktsegment FROM customer), generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-19', INTERVAL 1 DAY) t(d)")
def market_data_leaf(spark, sf_dir):
    """An outside source, one ticker a task; here a formula instead of a service."""
    import pandas as pd

    def pull(ticker, start, end):
        days = pd.date_range("2024-01-01", "2024-01-31")
        return pd.DataFrame({"ts": days, "price": [len(ticker) + float(i) for i in range(len(days))]})

    segments = [r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect()]
    return fin.market_data(spark, segments, TimeRange(timestamp("2024-01-03"), timestamp("2024-01-20")), pull)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 40 THEN l_quantity END + l_tax + l_discount, 6) AS s FROM lineitem")
def row_sum_strict(spark, sf_dir):
    """Across columns, null if one is."""
    df = mask(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_quantity") <= 40)
    return rounded(df.select("l_orderkey", "l_linenumber", stats.strict_row_sum(["l_quantity", "l_tax", "l_discount"]).alias("s")), "s", digits=6)


@query(f"WITH {_E} SELECT vec_id, i AS col, round(l[i + 1] * r[i + 1], 6) AS v FROM (SELECT *, unnest(range(0, len(l))) AS i FROM e)")
def vec_hadamard_long(spark, sf_dir):
    """Long vectors, whose columns must be the same."""
    df = _arrays(spark, sf_dir)
    left, right = (df.select("vec_id", F.posexplode(c).alias("col", "v")).withColumn("col", F.col("col").cast("long")) for c in "lr")
    return rounded(linalg.hadamard(left, right, ["vec_id"]), "v", digits=6)


# ------------------------------------------------------------------- without an oracle
@query()
def brownian_prices(spark, sf_dir):
    return fin.brownian_prices(spark, 1000, {f"a{i}": 0.1 * 10**i for i in range(3)}, seed=7)


from causalframe.plans import state_queries  # noqa: E402, F401  stores, catalogs, streams and task graphs
