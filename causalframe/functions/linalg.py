"""Linear algebra with one vector or matrix for each timestamp, as long tables or arrays.

Long vectors are (ids..., col, v), long matrices (ids..., row, col, m). A missing or null
element makes every sum that it belongs to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_sum(x: str | Column) -> Column:
    """A sum that is null if any of its terms is."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def hadamard(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """Element by element. Vectors of one id must have the same columns: a row that only one
    side has fails the query, in the same pass that multiplies."""
    r = right.select(*ids, "col", F.col("v").alias("__r"), F.lit(1).alias("__has"))
    both = left.withColumn("__l", F.lit(1)).join(r, [*ids, "col"], "full_outer")
    odd = F.concat(F.lit("the vectors have different columns: "), F.col("col").cast("string"))
    product = F.col("v") * F.col("__r")
    return both.select(*ids, "col", F.when(F.col("__l").isNull() | F.col("__has").isNull(), F.raise_error(odd).cast("double")).otherwise(product).alias("v"))


def dot(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """ids, v. Elements of either side alone count as null."""
    r = right.select(*ids, "col", F.col("v").alias("__r"))
    both = left.select(*ids, "col", "v").join(r, [*ids, "col"], "full_outer")
    return both.groupBy(*ids).agg(strict_sum(F.col("v") * F.col("__r")).alias("v"))


def mat_vec(matrix: DataFrame, vector: DataFrame, ids: list[str]) -> DataFrame:
    """ids, col, v: col is the matrix's row."""
    both = matrix.join(vector.select(*ids, "col", "v"), [*ids, "col"], "left")
    return both.groupBy(*ids, "row").agg(strict_sum(F.col("m") * F.col("v")).alias("v")).withColumnRenamed("row", "col")


def bilinear(left: DataFrame, matrix: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """ids, v: left' M right; M may be rectangular."""
    return dot(left, mat_vec(matrix, right, ids), ids)


def square_labels(names: DataFrame, column: str) -> DataFrame:
    """All pairs (row, col) of distinct labels: a few, since they are columns of a matrix."""
    labels = names.select(column).distinct()
    every = labels.groupBy().agg(F.array_sort(F.collect_list(column)).alias("all"))
    return labels.select(F.col(column).alias("row")).join(F.broadcast(every)).select("row", F.explode("all").alias("col"))


# Arrays: one row holds the whole vector, nothing is shuffled.
def hadamard_array(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a * b)


def dot_array(left: Column, right: Column) -> Column:
    return F.aggregate(hadamard_array(left, right), F.lit(0.0), lambda s, x: s + x)


def mat_vec_array(matrix: Column, vector: Column) -> Column:
    return F.transform(matrix, lambda row: dot_array(row, vector))


def bilinear_array(left: Column, matrix: Column, right: Column) -> Column:
    return dot_array(left, mat_vec_array(matrix, right))
