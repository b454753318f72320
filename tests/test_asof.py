from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalframe.operators.asof import causal_broadcast, causal_match, causal_resample

T0 = datetime(2000, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def model_match(data, target, contemp, limit):
    """Row by row: landing row, last data row per landing, fill."""
    out = []
    landed = {}
    for ts, v in data:
        at = next((i for i, (t, _) in enumerate(target) if (t >= ts if contemp else t > ts)), None)
        if at is not None:
            landed[target[at][0]] = v
    have, land, used = None, None, 0
    for t, pos in target:
        if t in landed and t != land:
            have, land, used = (landed[t],), t, 0
        elif land is not None and t > land:
            used += 1
        ok = have is not None and (limit is None or used <= limit)
        out.append((t, pos, have[0] if ok else None))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [None, timedelta(hours=3)])
def test_match_against_model(spark, seed, block):
    rng = np.random.default_rng(seed)
    contemp, limit = bool(seed % 2), [None, 0, 2][seed % 3]
    data, target, want = [], [], []
    for key in ("a", "b"):
        times = sorted(rng.choice(60, int(rng.integers(0, 14)), replace=False).tolist())
        d = [(T0 + timedelta(minutes=15 * t), None if rng.random() < 0.2 else float(i)) for i, t in enumerate(times)]
        goal = sorted(rng.integers(0, 60, int(rng.integers(0, 25))).tolist())
        g = [(T0 + timedelta(minutes=15 * t), i) for i, t in enumerate(goal)]
        data += [(key, *x) for x in d]
        target += [(key, *x) for x in g]
        want += [(key, *x) for x in model_match(d, g, contemp, limit)]
    found = causal_match(frame(spark, data, "k string, ts timestamp_ntz, v double"), frame(spark, target, "k string, ts timestamp_ntz, pos int"), keys=["k"], contemp=contemp, fill_limit=limit, block=block)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want, key=lambda r: r[:3]) or sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_errors_and_empty_target(spark):
    d = frame(spark, [(T0, 1.0), (T0, 2.0)], "ts timestamp_ntz, v double")
    t = frame(spark, [(T0,)], "ts timestamp_ntz")
    with pytest.raises(ValueError, match="repeat"):
        causal_match(d, t)
    with pytest.raises(ValueError, match="timestamp_ntz"):
        causal_match(d, t.select(F.col("ts").cast("timestamp")))
    assert causal_match(d.limit(1), t.where("false"), check=False).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        causal_match(d, t.withColumn("v", F.lit(1)))


def test_last_row_counts_whole(spark):
    d = frame(spark, [(T0, 1.0, 2.0), (T0 + timedelta(hours=1), None, 3.0)], "ts timestamp_ntz, a double, b double")
    t = frame(spark, [(T0 + timedelta(hours=2),)], "ts timestamp_ntz")
    assert tuple(causal_match(d, t).first())[1:] == (None, 3.0)
    assert tuple(causal_resample(d, t, "last").first())[1:] == (1.0, 3.0)


def test_broadcast_to_panel(spark):
    d = frame(spark, [(T0, 1.0), (T0 + timedelta(days=1), 2.0)], "ts timestamp_ntz, v double")
    t = frame(spark, [(a, T0 + timedelta(days=i)) for i in range(3) for a in "AB"], "asset string, ts timestamp_ntz")
    rows = causal_broadcast(d, t).orderBy("asset", "ts").collect()
    assert [r.v for r in rows] == [None, 1.0, 2.0] * 2


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("method", ["last", "first", "sum", "mean", "min", "max", "count", "std"])
def test_resample_against_pandas(spark, seed, method):
    rng = np.random.default_rng(seed)
    contemp = bool(seed % 2)
    times = sorted(rng.choice(50, 20, replace=False).tolist())
    goal = sorted(rng.integers(0, 50, 9).tolist())
    data = pd.DataFrame({"ts": [T0 + timedelta(hours=t) for t in times], "v": rng.normal(size=20).round(3)})
    data.loc[rng.random(20) < 0.25, "v"] = np.nan
    goal_ts = [T0 + timedelta(hours=t) for t in goal]
    side = "left" if contemp else "right"
    distinct = pd.Index(sorted(set(goal_ts)))
    at = distinct.searchsorted(data["ts"], side=side)
    kept = data[at < len(distinct)].assign(b=distinct[at[at < len(distinct)]])
    want = kept.groupby("b")["v"].agg(method)
    rows = [(r.ts.to_pydatetime(), None if np.isnan(r.v) else float(r.v)) for r in data.itertuples()]
    found = causal_resample(frame(spark, rows, "ts timestamp_ntz, v double"), frame(spark, [(t,) for t in goal_ts], "ts timestamp_ntz"), method, contemp=contemp).collect()
    assert len(found) == len(goal_ts)
    for r in found:
        w = want.get(pd.Timestamp(r.ts), np.nan)
        assert (r.v is None and np.isnan(w)) or r.v == pytest.approx(w)


def test_resample_with_a_function(spark):
    d = frame(spark, [(T0 + timedelta(hours=i), float(i)) for i in range(4)], "ts timestamp_ntz, v double")
    t = frame(spark, [(T0 + timedelta(hours=3),)], "ts timestamp_ntz")
    assert causal_resample(d, t, lambda c: F.sum(F.col(c) * 2), contemp=True).first().v == 12.0

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    assert causal_resample(d, t, lambda c: spread(F.col(c))).first().v == 2.0
    with pytest.raises(ValueError, match="unknown aggregation"):
        causal_resample(d, t, "mode")
