"""Walk-forward batches, point-in-time training and application of models."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalframe.functions.hashing import positive
from causalframe.operators.asof import causal_match
from causalframe.operators.stats import range_bounds, range_of
from causalframe.shipping import ship
from causalframe.sources.scratch import checkpointed

@dataclass(frozen=True)
class Batches:
    """Training batches over n rows in order of time, as an arithmetic progression: batch k
    ends in front of row `first_end + k * step` and spans the `width` rows before that, as far
    as they exist. Only the last may end early, with the data; a `sliding` one then still
    spans width rows, any other starts where it would have."""

    n: int
    count: int
    first_end: int
    step: int
    width: int
    sliding: bool = False

    def bounds(self) -> list[tuple[int, int]]:
        """First row and end of every batch."""
        found = []
        for k in range(self.count):
            due = self.first_end + k * self.step
            end = min(due, self.n)
            found.append((max((end if self.sliding else due) - self.width, 0), end))
        return found

    def holding(self, rn: Column) -> Column:
        """The batches that row rn is part of, by arithmetic: a join of rows to a table of
        batches would compare each with all."""
        low = F.greatest(F.floor((rn - self.first_end) / self.step) + 1, F.lit(0))
        high = F.least(F.floor((rn + self.width - self.first_end) / self.step), F.lit(self.count - 1))
        none = F.array().cast("array<int>")
        ids = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(none)
        early = self.first_end + (self.count - 1) * self.step - self.n
        if self.sliding and self.count and early > 0:
            # The last batch reaches back by as many rows as it ends early.
            extra = (rn >= self.n - self.width) & (rn < self.n - self.width + early)
            ids = F.concat(ids, F.when(extra, F.array(F.lit(self.count - 1))).otherwise(none))
        return ids


def plan_batches(n: int, window_size: int | None, min_periods: int | None = None, step_size: int | None = None, strict_step_size: bool = True) -> Batches:
    """How n rows are cut into training batches.

    Without window_size: one batch of all rows. With window_size alone: chunks without
    overlap, the last one only if it has more than min_periods rows (window_size if that is
    not given and steps are strict, so that no last chunk qualifies). With step_size too:
    windows that move on by it, the first of min_periods rows (window_size if not given),
    growing to window_size; what is left after the last whole step makes one more window,
    if strict only when it is a whole step itself."""
    if window_size is None:
        if (min_periods, step_size) != (None, None):
            raise ValueError("without window_size there is no min_periods or step_size")
        return Batches(n, 1, n, max(n, 1), n)
    width = positive(window_size, "window_size")
    if step_size is None:
        least = min_periods or (width if min_periods is None and strict_step_size else 0)
        if n < least:
            raise ValueError("no batches: fewer rows than min_periods")
        # Every chunk but the last is whole; the last has 1 to width rows.
        before = max(n - 1, 0) // width
        return Batches(n, before + (n - before * width > least), width, width, width)
    step = positive(step_size, "step_size")
    least = width if min_periods is None else positive(min_periods, "min_periods")
    if not least <= width or n <= least:
        raise ValueError("min_periods must not exceed window_size and must be less than the number of rows")
    whole, rest = divmod(n - least, step)
    # The window at the end of the data is one of `whole` if no rows are left over.
    return Batches(n, 1 + whole + (rest > 0 and not strict_step_size), least, step, width, sliding=True)


def numbered(df: DataFrame, on: str = "ts") -> DataFrame:
    """Adds rn, the row's place in time, without one task that sees all rows: each range
    of times is numbered on its own and then moved by the sizes of those before it. The
    ranges are literals, so both branches of the plan cut alike."""
    moment = F.unix_micros(F.to_utc_timestamp(F.col(on).cast("timestamp"), F.current_timezone()))
    n = max(2, min(128, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    (bounds,) = range_bounds(df, [moment], n)
    parts = df.withColumn("__part", range_of(moment, bounds))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range.
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    parts = parts.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(on)))
    return parts.join(F.broadcast(before), "__part").withColumn("rn", F.col("__before") + F.col("__k") - 1).drop("__part", "__k", "__before")


def walk_forward(features: DataFrame, responses: DataFrame, window_size: int | None, min_periods: int | None = None, step_size: int | None = None, strict_step_size: bool = True, on: str = "ts", **match_options) -> DataFrame:
    """Training rows of every batch: batch, rn and the columns of both sides, features
    matched to responses as of their time. One row for each batch that it is part of.
    The match is made once and checkpointed: its rows are counted and numbered from there."""
    found = match_options.pop("matched_time", None) or "__matched_ts"
    joined = checkpointed(causal_match(features, responses, on, matched_time=found, **match_options))
    n, matched = joined.agg(F.count(F.lit(1)), F.count(found)).first()
    if not n or (not matched and features.isEmpty()):
        raise ValueError("features and responses must have rows")
    if found == "__matched_ts":
        joined = joined.drop(found)
    plan = plan_batches(n, window_size, min_periods, step_size, strict_step_size)
    return numbered(joined, on).withColumn("batch", F.explode(plan.holding(F.col("rn"))))


def fit_ols(batches: DataFrame, x: str, y: str, on: str = "ts") -> DataFrame:
    """A line for each batch, by partial aggregation: batch, model_ts (last training time), slope, intercept, n."""
    return batches.groupBy("batch").agg(F.max(on).alias("model_ts"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def fit_models(batches: DataFrame, fit: Callable, on: str = "ts") -> DataFrame:
    """One fitted model for each batch, made by fit(pandas DataFrame) in parallel: batch,
    model_ts, model (pickled). A batch is one task's: its size is the window's."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(on)
        return pd.DataFrame({"batch": [int(pdf["batch"].iloc[0])], "model_ts": [pdf[on].iloc[-1]], "model": [pickle.dumps(fit(pdf))]})

    ship(batches.sparkSession)
    return batches.groupBy("batch").applyInPandas(run, "batch int, model_ts timestamp_ntz, model binary")


def apply_models(models: DataFrame, data: DataFrame, contemp: bool = False, on: str = "ts", values: list[str] | None = None) -> DataFrame:
    """Every data row with the newest model before it (with contemp: of its own time too).
    Rows before the first model go. values: the model's columns."""
    values = values or [c for c in models.columns if c != "model_ts"]
    right = models.select(F.col("model_ts").alias(on), *values)
    return causal_match(right, data, on, contemp=contemp, matched_time="model_ts").where("model_ts is not null")


def predict_line(applied: DataFrame, x: str, out: str = "prediction") -> DataFrame:
    return applied.withColumn(out, F.col("intercept") + F.col("slope") * F.col(x))


def apply_pickled(applied: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """predict(model, pandas rows) of each model's rows, in Arrow batches."""
    cache: dict[bytes, object] = {}

    def run(frames):
        for pdf in frames:
            for blob, part in pdf.groupby("model", sort=False):
                if blob not in cache:
                    cache.clear()
                    cache[blob] = pickle.loads(blob)
                yield predict(cache[blob], part.drop(columns="model"))

    ship(applied.sparkSession)
    return applied.mapInPandas(run, schema)


# --------------------------------------------------------- pipelines of two frames
@dataclass(frozen=True)
class Bivariate:
    """Features and, if known, responses."""

    x: DataFrame
    y: DataFrame | None = None


class Transformer:
    """fit gives the transformer itself; fitted or not it can be pickled."""

    def fit(self, data: Bivariate) -> Transformer:
        return self

    def transform(self, data: Bivariate) -> Bivariate:
        raise NotImplementedError

    def fit_transform(self, data: Bivariate) -> Bivariate:
        return self.fit(data).transform(data)


class Univariate(Transformer):
    """A function of one frame, on x, y or both."""

    def __init__(self, func: Callable, *args, on_x: bool = True, on_y: bool = True, **kwargs):
        self.func, self.args, self.kwargs, self.on_x, self.on_y = func, args, kwargs, on_x, on_y

    def transform(self, data):
        def f(df):
            return self.func(df, *self.args, **self.kwargs)

        return Bivariate(f(data.x) if self.on_x else data.x, f(data.y) if self.on_y and data.y is not None else data.y)


class Joint(Transformer):
    """A function from both frames to both."""

    def __init__(self, func: Callable, *args, **kwargs):
        self.func, self.args, self.kwargs = func, args, kwargs

    def transform(self, data):
        return Bivariate(*self.func(data.x, data.y, *self.args, **self.kwargs))


class LinearEstimator(Transformer):
    """Least squares of every y column on the x columns (pyspark.ml); predictions replace y."""

    def __init__(self, x_cols: list[str], y_cols: list[str], by: list[str]):
        self.x_cols, self.y_cols, self.by, self.weights = x_cols, y_cols, by, {}

    def fit(self, data):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import LinearRegression

        rows = VectorAssembler(inputCols=self.x_cols, outputCol="__features").transform(data.x.join(data.y, self.by))
        for y in self.y_cols:
            model = LinearRegression(featuresCol="__features", labelCol=y, solver="normal").fit(rows)
            self.weights[y] = ([float(c) for c in model.coefficients], float(model.intercept))
        return self

    def transform(self, data):
        out = []
        for y, (weights, intercept) in self.weights.items():
            total = F.lit(intercept)
            for c, w in zip(self.x_cols, weights, strict=True):
                total = total + F.col(c) * w
            out.append(total.alias(y))
        return Bivariate(data.x, data.x.select(*self.by, *out))


class Estimator(Transformer):
    """Any estimator with fit(X, y) and predict(X) on pandas frames; predictions replace y and
    have its columns. It is fitted in one task of an executor, as such estimators need all
    rows at once; predictions are made in Arrow batches wherever the rows are."""

    def __init__(self, estimator, x_cols: list[str], y_cols: list[str], by: list[str]):
        self.estimator, self.x_cols, self.y_cols, self.by, self.fitted = estimator, x_cols, y_cols, by, None

    def fit(self, data):
        import pandas as pd

        estimator, x_cols, y_cols, by = self.estimator, self.x_cols, self.y_cols, self.by

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(by)
            own = copy.deepcopy(estimator)
            own.fit(pdf[x_cols], pdf[y_cols[0]] if len(y_cols) == 1 else pdf[y_cols])
            return pd.DataFrame({"model": [pickle.dumps(own)]})

        ship(data.x.sparkSession)
        rows = data.x.select(*by, *x_cols).join(data.y.select(*by, *y_cols), by)
        self.fitted = rows.groupBy().applyInPandas(run, "model binary").first()["model"]
        return self

    def transform(self, data):
        if self.fitted is None:
            raise ValueError("the estimator has not been fitted")
        fitted, x_cols, y_cols, by = self.fitted, self.x_cols, self.y_cols, self.by

        def run(frames):
            import numpy as np

            own = pickle.loads(fitted)
            for pdf in frames:
                found = np.asarray(own.predict(pdf[x_cols]), float)
                found = found.reshape(len(pdf), -1)
                if found.shape[1] != len(y_cols):
                    raise ValueError(f"predictions have {found.shape[1]} columns, not {len(y_cols)}")
                out = pdf[by].copy()
                out[y_cols] = found
                yield out

        ship(data.x.sparkSession)
        kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in data.x.select(*by).schema.fields), *(f"`{c}` double" for c in y_cols)])
        return Bivariate(data.x, data.x.select(*by, *x_cols).mapInPandas(run, kinds))


class LocalPipeline:
    """Steps in order on the pandas frames (x, y) of one batch: objects with fit(x, y) and
    transform(x, y) -> (x, y), such as `Scale` and `Fitted`."""

    def __init__(self, steps: list):
        self.steps = steps

    def fit(self, x, y) -> LocalPipeline:
        for step in self.steps:
            step.fit(x, y)
            x, y = step.transform(x, y)
        return self

    def transform(self, x, y=None):
        for step in self.steps:
            x, y = step.transform(x, y)
        return x, y


class Scale:
    """Features without mean, in units of their deviation, both as of the fit."""

    def fit(self, x, y) -> None:
        self.mean, self.std = x.mean(), x.std(ddof=0).replace(0.0, 1.0)

    def transform(self, x, y):
        return (x - self.mean) / self.std, y


class Fitted:
    """An estimator with fit(X, y) and predict(X); predictions replace y."""

    def __init__(self, estimator):
        self.estimator = estimator

    def fit(self, x, y) -> None:
        self.columns = list(y.columns)
        self.estimator.fit(x, y[self.columns[0]] if len(self.columns) == 1 else y)

    def transform(self, x, y):
        import numpy as np
        import pandas as pd

        found = np.asarray(self.estimator.predict(x), float).reshape(len(x), -1)
        return x, pd.DataFrame(found, index=x.index, columns=self.columns)


class LeastSquares:
    """Linear regression with a constant, of one or more responses."""

    def fit(self, x, y) -> None:
        import numpy as np

        self.weights = np.linalg.lstsq(np.column_stack([np.asarray(x, float), np.ones(len(x))]), np.asarray(y, float), rcond=None)[0]

    def predict(self, x):
        import numpy as np

        return np.column_stack([np.asarray(x, float), np.ones(len(x))]) @ self.weights


def fit_pipelines(batches: DataFrame, pipeline: LocalPipeline, x_cols: list[str], y_cols: list[str], on: str = "ts") -> DataFrame:
    """A copy of the pipeline for each batch, fitted on it: batch, model_ts (the batch's last
    time), model. Batches are fitted in parallel; the one that is given stays unfitted."""

    def fit(pdf):
        # Rows whose features or responses are not known yet teach nothing.
        pdf = pdf.dropna(subset=[*x_cols, *y_cols])
        return copy.deepcopy(pipeline).fit(pdf[x_cols], pdf[y_cols])

    return fit_models(batches, fit, on)


def apply_pipelines(models: DataFrame, data: DataFrame, x_cols: list[str], y_cols: list[str], contemp: bool = False, on: str = "ts") -> DataFrame:
    """Every data row with the predictions of the newest pipeline before it: on, model_ts and
    y_cols. Rows before the first go."""
    applied = apply_models(models, data.select(on, *x_cols), contemp, on, values=["model"])

    def predict(model: LocalPipeline, pdf):
        out = pdf[[on, "model_ts"]].reset_index(drop=True)
        out[y_cols] = model.transform(pdf[x_cols].reset_index(drop=True))[1][y_cols]
        return out

    return apply_pickled(applied, predict, ", ".join([f"`{on}` timestamp_ntz", "model_ts timestamp_ntz", *(f"`{c}` double" for c in y_cols)]))


class Pipeline(Transformer):
    """Steps in order."""

    def __init__(self, steps: list[Transformer]):
        self.steps = steps

    def fit(self, data):
        self.fit_transform(data)
        return self

    def transform(self, data):
        for step in self.steps:
            data = step.transform(data)
        return data

    def fit_transform(self, data):
        for step in self.steps:
            data = step.fit_transform(data)
        return data
