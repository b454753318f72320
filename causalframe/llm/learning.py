"""Small pieces of the text classifiers: labelled samples of bounded size and a
logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(parts: int) -> F.Column:
    """crc32 of doc_id as text, modulo parts; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(labels: DataFrame, column: str, parts: int, held: int, most: int) -> DataFrame:
    """doc_id and label of at most `most` rows of either class that are not held out.
    Which rows: those with the smallest hashes of doc_id, so the same for any layout.
    A doc_id with two labels counts as 1; rows without a label or doc_id do not count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(remainder(parts) != held).groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    each = [known.where(F.col("label") == k).orderBy("h", "doc_id").limit(most) for k in (0, 1)]
    return each[0].unionByName(each[1]).select("doc_id", "label", F.pmod("h", F.lit(4)).cast("int").alias("fold"))


def marked(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """docs (doc_id, text) with label and fold, null outside the sample. The sample has
    a bounded number of rows of three integers, so it is broadcast."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, balanced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant last) by Newton's method."""
    if not len(y) or y.min() == y.max():
        # One class only: every score is its share.
        p = (y.sum() + 1) / (len(y) + 2)
        k = x.shape[1]
        return np.zeros(k), np.ones(k), np.append(np.zeros(k), np.log(p / (1 - p)))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if balanced else np.ones(len(y))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (share * (p - y)) / len(y) + ridge * w
        hess = (z * (share * p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def logistic(model: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ w, -30, 30)))
