"""Long and wide forms, concatenation, index algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(df: DataFrame, ids: list[str], columns: list[str], name: str = "variable", value: str = "value", keep_null: bool = False) -> DataFrame:
    """Wide to long; nulls are dropped unless kept."""
    long = df.unpivot(ids, columns, name, value)
    return long if keep_null else long.where(F.col(value).isNotNull())


def unstack(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide. Names are given: finding them would cost a job."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value, ignorenulls=True))


def concat_rows(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns of some are null in the others."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_columns(frames: list[DataFrame], by: list[str]) -> DataFrame:
    """All columns of all frames, outer by the index."""
    return reduce(lambda a, b: a.join(b, by, "full_outer"), frames)


def index_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def index_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def index_symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right).union(right.subtract(left))


def combine_first(existing: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Union of rows and columns; existing values that are not null win. Null index
    values meet null ones."""
    e, n = existing.alias("e"), new.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by])
    both = e.join(n, same, "full_outer")
    out = [F.coalesce(F.col(f"e.{c}"), F.col(f"n.{c}")).alias(c) for c in by]
    for c in dict.fromkeys([*existing.columns, *new.columns]):
        if c not in by:
            sides = [F.col(f"{a}.{c}") for a, f in (("e", existing), ("n", new)) if c in f.columns]
            out.append((F.coalesce(*sides) if len(sides) > 1 else sides[0]).alias(c))
    return both.select(*out)


def outer_arithmetic(left: DataFrame, right: DataFrame, by: list[str], column: str, op) -> DataFrame:
    """op of two frames' columns, rows aligned by the index; null where one side lacks a row."""
    r = right.select(*by, F.col(column).alias("__r"))
    return left.select(*by, column).join(r, by, "full_outer").select(*by, op(F.col(column), F.col("__r")).alias(column))


def reindex(target: DataFrame, data: DataFrame, by: list[str]) -> DataFrame:
    """Every target row with the data of its index, or nulls."""
    return target.join(data, by, "left")
