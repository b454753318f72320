import pickle
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalframe.operators import ml

T0 = datetime(2020, 1, 1)


def stepped(n, width, step, least, strict):
    """Brute force: a window ends where enough rows are behind it, at every step from there on."""
    ends = [e for e in range(1, n + 1) if e >= least and (e - least) % step == 0]
    if ends[-1] < n and not strict:
        ends.append(n)
    return [(max(0, e - width), e) for e in ends]


def chunked(n, width, least):
    chunks = [list(range(n))[i : i + width] for i in range(0, n, width)]
    return [(c[0], c[-1] + 1) for i, c in enumerate(chunks) if i + 1 < len(chunks) or len(c) > least]


@pytest.mark.parametrize("n", [7, 12, 13, 25])
@pytest.mark.parametrize("width, least", [(3, 0), (3, 2), (5, 1), (6, 6), (7, 4)])
def test_chunks(n, width, least):
    assert ml.plan_batches(n, width, least).bounds() == chunked(n, width, least)


@pytest.mark.parametrize("n", [8, 17, 23])
@pytest.mark.parametrize("width, step, least", [(5, 1, 2), (5, 4, 5), (7, 3, 1), (2, 5, 1), (6, 2, None)])
@pytest.mark.parametrize("strict", [True, False])
def test_windows(n, width, step, least, strict):
    assert ml.plan_batches(n, width, least, step, strict).bounds() == stepped(n, width, step, least or width, strict)


def test_batch_errors():
    for options in ((6, 9, 7, 2), (21, 4, 5, 2), (21, 0, None, 2), (21, 4, None, 0), (3, 5, 4), (11, None, 2), (11, None, None, 2)):
        with pytest.raises(ValueError):
            ml.plan_batches(*options)
    # Strict steps and no min_periods: a chunk that ends with the data does not qualify.
    assert ml.plan_batches(15, 5).bounds() == [(0, 5), (5, 10)]
    assert ml.plan_batches(15, 5, strict_step_size=False).bounds() == [(0, 5), (5, 10), (10, 15)]
    assert ml.plan_batches(11, None).bounds() == [(0, 11)]


@pytest.mark.parametrize("options", [(None,), (4,), (4, 1), (5, 3, 2), (5, 3, 2, False), (8, 6, 3, False), (3, 2, 5, False), (4, None, 3, False), (6, 4, 7, False)])
def test_batches_that_hold_a_row(spark, options):
    for n in (9, 13, 14):
        plan = ml.plan_batches(n, *options)
        want = {(i, r) for i, (a, b) in enumerate(plan.bounds()) for r in range(a, b)}
        ids = spark.range(n).select("id", F.explode(plan.holding(F.col("id"))).alias("b"))
        assert {(r.b, r.id) for r in ids.collect()} == want


def frame(spark, values, name, shift=0):
    return spark.createDataFrame([(T0 + timedelta(days=i + shift), float(v)) for i, v in enumerate(values)], f"ts timestamp_ntz, {name} double")


def test_models_switch_over(spark):
    models = spark.createDataFrame([(T0 + timedelta(days=3), 0.5, 2.0), (T0 + timedelta(days=5), 0.5, 7.0)], "model_ts timestamp_ntz, slope double, intercept double")
    data = frame(spark, [4.0] * 8, "x")
    strict = [r.prediction for r in ml.predict_line(ml.apply_models(models, data), "x").orderBy("ts").collect()]
    contemp = [r.prediction for r in ml.predict_line(ml.apply_models(models, data, contemp=True), "x").orderBy("ts").collect()]
    assert strict == [4.0] * 2 + [9.0] * 2 and contemp == [4.0] * 2 + [9.0] * 3


def test_walk_forward_fits(spark):
    x, y = frame(spark, range(12), "x"), frame(spark, [2.0 * (i - 1) + 1 for i in range(1, 12)], "y", 1)
    rows = ml.walk_forward(x, y, 6, min_periods=4, step_size=3, strict_step_size=False)
    assert sorted({(r.batch, r.n) for r in ml.fit_ols(rows, "x", "y").collect()}) == [(0, 4), (1, 6), (2, 6), (3, 6)]
    for r in ml.fit_ols(rows, "x", "y").collect():
        assert (r.slope, r.intercept) == (pytest.approx(2.0), pytest.approx(1.0))

    def mean(pdf):
        return float(pdf["y"].mean())

    def add(model, pdf):
        return pd.DataFrame({"ts": pdf["ts"], "p": model + pdf["x"] * 0})

    models = ml.fit_models(rows, mean)
    assert models.count() == 4
    out = ml.apply_pickled(ml.apply_models(models, x, values=["model"]), add, "ts timestamp_ntz, p double").orderBy("ts").collect()
    assert out[0].ts == T0 + timedelta(days=5) and out[0].p == pytest.approx(4.0)
    with pytest.raises(ValueError):
        ml.walk_forward(x.where("false"), y, 6)


def test_pipeline(spark):
    x = frame(spark, range(10), "x")
    y = x.selectExpr("ts", "3 * x + 2 as y")
    p = ml.Pipeline([ml.Univariate(lambda df: df.na.drop()), ml.Joint(lambda a, b: (a, b)), ml.LinearEstimator(["x"], ["y"], ["ts"])])
    found = p.fit_transform(ml.Bivariate(x, y))
    assert [r.y for r in found.y.orderBy("ts").collect()] == pytest.approx([3.0 * i + 2 for i in range(10)])
    weights = pickle.loads(pickle.dumps(p.steps[-1])).weights["y"]
    assert weights[0][0] == pytest.approx(3.0) and weights[1] == pytest.approx(2.0)
    only_x = ml.Univariate(lambda df: df.limit(3), on_y=False).transform(ml.Bivariate(x, y))
    assert only_x.x.count() == 3 and only_x.y.count() == 10


def test_numbering_by_ranges(spark):
    df = spark.range(5000).selectExpr("timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, 0, pmod(id * 7919, 5000)) as ts", "pmod(id * 7919, 5000) as want")
    rows = ml.numbered(df.repartition(7)).collect()
    assert len(rows) == 5000 and all(r.rn == r.want for r in rows)


def test_estimators_and_batch_pipelines(spark):
    x = frame(spark, [1.0, 2.0, 4.0, 7.0, 11.0, 16.0], "x")
    y = x.selectExpr("ts", "3 * x + 2 as y", "1 - x as z")
    step = ml.Estimator(ml.LeastSquares(), ["x"], ["y", "z"], ["ts"])
    with pytest.raises(ValueError, match="fitted"):
        step.transform(ml.Bivariate(x))
    found = {r.ts: (r.y, r.z) for r in step.fit_transform(ml.Bivariate(x, y)).y.collect()}
    assert found == {r.ts: (pytest.approx(r.y), pytest.approx(r.z)) for r in y.collect()}
    assert {r.ts for r in pickle.loads(pickle.dumps(step)).transform(ml.Bivariate(x)).y.collect()} == set(found)

    pipeline = ml.LocalPipeline([ml.Scale(), ml.Fitted(ml.LeastSquares())])
    batches = ml.walk_forward(x, y.withColumn("ts", F.expr("ts + interval 1 hour")), 4, min_periods=3, step_size=1)
    models = ml.fit_pipelines(batches, pipeline, ["x"], ["y", "z"])
    assert models.count() == 4 and not hasattr(pipeline.steps[0], "mean")
    later = ml.apply_pipelines(models, frame(spark, range(20, 23), "x", 6), ["x"], ["y", "z"]).collect()
    assert [(r.y, r.z) for r in sorted(later, key=lambda r: r.ts)] == [(pytest.approx(3.0 * v + 2), pytest.approx(1.0 - v)) for v in (20, 21, 22)]
