"""A DataFrame with the roles of its columns, and checks on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalframe.time import TimeRange


@dataclass(frozen=True)
class TimeFrame:
    """Long-form series: a time column, key columns (entities), value columns."""

    df: DataFrame
    time_col: str = "ts"
    key_cols: tuple[str, ...] = ()
    value_cols: tuple[str, ...] = field(default=None)

    def __post_init__(self):
        object.__setattr__(self, "key_cols", tuple(self.key_cols))
        if self.value_cols is None:
            object.__setattr__(self, "value_cols", tuple(c for c in self.df.columns if c != self.time_col and c not in self.key_cols))
        missing = [c for c in (self.time_col, *self.key_cols, *self.value_cols) if c not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        check_time_type(self.df, self.time_col)

    def window(self, descending: bool = False):
        order = F.col(self.time_col).desc() if descending else F.col(self.time_col)
        return Window.partitionBy(*self.key_cols).orderBy(order)

    def view(self, time_range: TimeRange) -> TimeFrame:
        return TimeFrame(time_range.view(self.df, self.time_col), self.time_col, self.key_cols, self.value_cols)

    def range(self) -> TimeRange:
        return TimeRange.of(self.df, self.time_col)

    def canonical(self) -> TimeFrame:
        """NaN becomes null in floating value columns."""
        floats = {f.name for f in self.df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        clean = {c: F.when(~F.isnan(c), F.col(c)) for c in self.value_cols if c in floats}
        return TimeFrame(self.df.withColumns(clean) if clean else self.df, self.time_col, self.key_cols, self.value_cols)


def check_time_type(df: DataFrame, *columns: str) -> None:
    """Time columns are TIMESTAMP_NTZ (UTC wall time): others would be converted
    silently, by the session's zone."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.TimestampNTZType):
            raise ValueError(f"column {c} is {df.schema[c].dataType.simpleString()}, not timestamp_ntz; convert it with convert_timezone first")


def check_unique(df: DataFrame, *columns: str) -> None:
    """One job: no two rows share these columns."""
    if df.groupBy(*columns).count().where("count > 1").head(1):
        raise ValueError(f"rows repeat by {', '.join(columns)}")


def fillna(df: DataFrame, value: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    return df.na.fill(value, columns)


def dropna(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def mask(df: DataFrame, column: str, keep) -> DataFrame:
    """Nulls a value where `keep` does not hold; the row stays."""
    return df.withColumn(column, F.when(keep, F.col(column)))


def equals(left: DataFrame, right: DataFrame) -> bool:
    """Same columns, types and rows, as bags."""
    if [(f.name, f.dataType) for f in left.schema.fields] != [(f.name, f.dataType) for f in right.schema.fields]:
        return False
    return not left.exceptAll(right).head(1) and not right.exceptAll(left).head(1)
