"""Filling missing values from their neighbours, by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .core import by


def _neighbours(df: DataFrame, x: str, keys: Sequence[str], block: int | None) -> DataFrame:
    """df with __p (position from 1), and __a and __z: p and x of the last valid row up to this one and the first from it
    on. A key in a task, or without keys and with block by blocks of periods."""
    here = F.when(F.col(x).isNotNull(), F.struct(F.col("__p").alias("p"), F.col(x).alias("x")))
    if keys and block is None:
        w = by(keys)
        pos = df.withColumn("__p", F.row_number().over(w).cast("long"))
        return pos.withColumns({"__a": F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__z": F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    size = block or blocks.BLOCK
    pos = blocks.scanned(df, keys, {"__p": blocks.total(F.lit(1).cast("long"))}, size)
    return blocks.scanned(pos, keys, {"__a": blocks.latest(here), "__z": blocks.latest(here, back=True)}, size, ("t", "__p"))


def _fill(df: DataFrame, x: str, maxgap: int | None, keys: Sequence[str], out: str | None, forward: bool, block: int | None) -> DataFrame:
    near = _neighbours(df, x, keys, block)
    side = F.col("__a" if forward else "__z")
    filled = side["x"]
    if maxgap is not None:
        ends = blocks.same_keys(near, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), keys) if keys else near.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__rows"))))  # one row
        gap = F.coalesce(F.col("__z.p"), F.col("__rows") + 1) - F.coalesce(F.col("__a.p"), F.lit(0)) - 1
        near, filled = ends, F.when(F.col(x).isNotNull() | (gap <= maxgap), filled)
    return near.withColumn(out or x, filled).drop("__p", "__a", "__z", "__rows")


def forward_fill(df: DataFrame, x: str, maxgap: int | None = None, keys: Sequence[str] = (), out: str | None = None, block: int | None = None) -> DataFrame:
    """The last value before; a run of more than maxgap missing rows stays missing, and so do leading ones."""
    return _fill(df, x, maxgap, keys, out, True, block)


def backward_fill(df: DataFrame, x: str, maxgap: int | None = None, keys: Sequence[str] = (), out: str | None = None, block: int | None = None) -> DataFrame:
    return _fill(df, x, maxgap, keys, out, False, block)


def interpolate(df: DataFrame, x: str, kind: str = "linear", keys: Sequence[str] = (), out: str | None = None, block: int | None = None) -> DataFrame:
    """constant, linear, cubic or quintic between the first and last valid rows, by position; fewer than two valid rows
    stay as they are. Splines are solved for each key in pandas, the others are windows."""
    out = out or x
    if kind == "constant":
        return forward_fill(df, x, keys=keys, out=out, block=block)
    if kind == "linear":
        near = _neighbours(df, x, keys, block)
        a, z = F.col("__a.x").cast("double"), F.col("__z.x").cast("double")
        line = a + (z - a) * (F.col("__p") - F.col("__a.p")) / F.nullif(F.col("__z.p") - F.col("__a.p"), F.lit(0))
        return near.withColumn(out, F.coalesce(F.col(x).cast("double"), line)).drop("__p", "__a", "__z")
    order = {"cubic": 3, "quintic": 5}[kind]
    one = df if keys else df.withColumn("__key", F.lit(0))
    group = list(keys) or ["__key"]
    schema = df.drop(out).schema if out != x else df.schema
    fields = ", ".join(f"`{f.name}` {'double' if f.name == out else f.dataType.simpleString()}" for f in schema.fields) + ("" if out in df.columns else f", `{out}` double")

    def run(rows):
        rows = rows.sort_values("t").drop(columns=[c for c in ("__key",) if c in rows])
        y = rows[x].to_numpy(float)
        rows[out] = spline(y, order)
        return rows

    return one.groupBy(*group).applyInPandas(run, fields)


def spline(y, order: int):
    """Not-a-knot interpolating spline through the valid points of y by position."""
    import numpy as np

    at = np.flatnonzero(~np.isnan(y))
    out = y.copy()
    if len(at) < 2:
        return out
    k = min(order, len(at) - 1)
    k -= 1 - k % 2
    inside = np.arange(at[0], at[-1] + 1)
    drop = (k - 1) // 2
    inner = at[drop + 1 : len(at) - drop - 1].astype(float)
    knots = np.concatenate([[at[0]] * (k + 1), inner, [at[-1]] * (k + 1)]).astype(float)

    n = len(at)

    def basis(x):
        """First of the k + 1 functions that are not 0 at each x, and their values."""
        i = np.clip(np.searchsorted(knots, x, side="right") - 1, k, n - 1)
        b = np.zeros((len(x), k + 1))
        b[:, 0] = 1
        for d in range(1, k + 1):
            carry = np.zeros(len(x))
            for j in range(d):
                low, high = knots[i - d + 1 + j], knots[i + 1 + j]
                part = b[:, j] / (high - low)
                b[:, j] = carry + (high - x) * part
                carry = (x - low) * part
            b[:, d] = carry
        return i - k, b

    # the matrix is banded and totally positive: elimination needs no pivots, and a row reaches k columns to either side
    first, values = basis(at.astype(float))
    band, y_ = np.zeros((n, 2 * k + 1)), y[at].astype(float)  # column j of row r is band[r, j - r + k]
    for m in range(k + 1):
        off = first + m - np.arange(n) + k
        ok = (off >= 0) & (off <= 2 * k)
        band[np.flatnonzero(ok), off[ok]] = values[ok, m]
    for r in range(n):
        for q in range(r + 1, min(n, r + k + 1)):
            if factor := band[q, r - q + k] / band[r, k]:
                band[q, r - q + k : r - q + 2 * k + 1] -= factor * band[r, k:]
                y_[q] -= factor * y_[r]
    c = np.zeros(n + k)
    for r in range(n - 1, -1, -1):
        c[r] = (y_[r] - band[r, k + 1 :] @ c[r + 1 : r + k + 1]) / band[r, k]
    start, b = basis(inside.astype(float))
    made = (b * c[start[:, None] + np.arange(k + 1)]).sum(1)
    out[inside] = np.where(np.isnan(y[inside]), made, y[inside])
    return out
