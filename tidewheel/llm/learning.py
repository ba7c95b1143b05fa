"""What both classifiers share: a bounded sample of labelled rows, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """A null doc_id is read as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


#: Bytes of text that a sample has at most; whole texts are taken in the order of their hashes until they are reached.
SAMPLE_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, each: int, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most `each` rows of either label and `most` bytes, none held out, and the share of label 1
    among all.

    The rows with the smallest keyed hashes are taken, so reruns agree; of rows that share a doc_id, the one with the
    smallest hash of its text. Labels that contradict each other for one doc_id, and null ones, are left out.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a = b AND doc_id IS NOT NULL").select("doc_id", F.col("a").alias("y"))
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).withColumn("h", F.xxhash64(F.lit("sample"), "doc_id"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = known.where("y = 0").orderBy("h", "doc_id").limit(each).union(known.where("y = 1").orderBy("h", "doc_id").limit(each))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # the broadcast is of the sample's size
    one = rows.groupBy("doc_id", "y", "h").agg(F.min_by(F.coalesce("text", F.lit("")), F.struct(F.xxhash64("text"), "text")).alias("text"))
    upto = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each of the sample
    rows = one.withColumn("__upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("__upto") <= most).orderBy("h", "doc_id").collect()
    share = n.get(1, 0) / max(1, sum(n.values()))
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64), share


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method with ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    b = np.zeros(x.shape[1])
    r = np.full(x.shape[1], ridge)
    r[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - r * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(r)
        step = np.linalg.solve(h + 1e-9 * np.eye(len(b)), g)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b
