"""Auto- and cross-covariances and correlations of a series (missing values and gaps count as no pair).

Rows are dealt by blocks of periods, each with the rows up to the largest lag before it, and the pairs of a block are
made from two arrays, so no task needs a whole series and no row is copied for every lag. Divisors are the number of
valid pairs, plus the lag for periodograms.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import anom
from .blocks import BLOCK


def lags(n: int, m: int | None = None) -> list[int]:
    """0 .. n - 1, then -(n - 1) .. -1; of two lengths n is the smaller, and negative lags reach the larger one's end."""
    k = n if m is None else min(n, m)
    first = -(n - 1) if m is None else -(n + m - k) + 1
    return [*range(k), *range(first, 0)]


def _sums(both: DataFrame, maxlag: int, signed: bool) -> DataFrame:
    """lag, s and n of x[t + lag] * y[t] for rows t, x, y; one row of a repeated date counts as a pair each."""
    size = max(BLOCK // 4, maxlag, 1)
    home = F.floor(F.col("t") / size).cast("long")
    reach = F.floor((F.col("t") + maxlag) / size).cast("long")
    # y goes to its own block and to those its lags reach; with negative lags x at t - lag lies before it
    first = F.floor((F.col("t") - maxlag) / size).cast("long") if signed else home
    xs = both.where("x IS NOT NULL").select(home.alias("__b"), F.struct(F.col("t"), F.col("x").alias("v")).alias("p"), F.lit(True).alias("own"))
    ys = both.where("y IS NOT NULL").select(F.explode(F.sequence(first, reach)).alias("__b"), F.struct(F.col("t"), F.col("y").alias("v")).alias("p"), F.lit(False).alias("own"))
    cells = xs.unionByName(ys).groupBy("__b").agg(*[F.collect_list(F.when(F.col("own") if own else ~F.col("own"), F.col("p"))).alias(n) for n, own in (("xs", True), ("ys", False))])

    def run(batches):
        for rows in batches:
            lags_, s, n = [], [], []
            for x, y in zip(rows["xs"], rows["ys"]):
                if not len(x) or not len(y):
                    continue
                xt, xv = np.array([p["t"] for p in x]), np.array([p["v"] for p in x], float)
                yt, yv = np.array([p["t"] for p in y]), np.array([p["v"] for p in y], float)
                at = np.arange(min(xt.min(), yt.min()), max(xt.max(), yt.max()) + 1)  # a block and its halo
                cell = lambda t, v: np.bincount(t - at[0], v, len(at))
                sx, cx, sy, cy = cell(xt, xv), cell(xt, None), cell(yt, yv), cell(yt, None)
                for k in range(-maxlag if signed else 0, maxlag + 1):
                    a, b = (slice(k, None), slice(0, len(at) - k)) if k >= 0 else (slice(0, len(at) + k), slice(-k, None))
                    if k < len(at) and -k < len(at) and (m := int((cx[a] * cy[b]).sum())):
                        lags_.append(k)
                        s.append(float((sx[a] * sy[b]).sum()))
                        n.append(m)
            yield pd.DataFrame({"lag": np.array(lags_, np.int64), "s": np.array(s, float), "n": np.array(n, np.int64)})

    return cells.mapInPandas(run, "lag long, s double, n long").groupBy("lag").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def cvf(df: DataFrame, x: str, y: str, maxlag: int, periodogram: bool = True) -> DataFrame:
    """lag and cov: sums of x[t + lag] * y[t] of the deviations from the means, for lags -maxlag to maxlag."""
    both = anom(anom(df.select("t", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "x"), "y")
    sums = _sums(both, maxlag, True)
    return sums.select("lag", (F.col("s") / (F.col("n") + (F.abs("lag") if periodogram else F.lit(0)))).alias("cov"), "n")


def avf(df: DataFrame, x: str, maxlag: int, periodogram: bool = True) -> DataFrame:
    """lag 0 to maxlag, cov and the number of pairs; negative lags are their mirror."""
    own = anom(df.select("t", F.col(x).cast("double").alias("x")), "x").withColumn("y", F.col("x"))
    sums = _sums(own, maxlag, False)
    return sums.select("lag", (F.col("s") / (F.col("n") + (F.col("lag") if periodogram else F.lit(0)))).alias("cov"), "n")


def _by_lag_0(cov: DataFrame, out: str) -> DataFrame:
    zero = cov.where("lag = 0").select(F.col("cov").alias("__c0"))  # one row
    return cov.crossJoin(F.broadcast(zero)).select("lag", F.try_divide("cov", "__c0").alias(out))


def acf(df, x, maxlag, periodogram=True) -> DataFrame:
    return _by_lag_0(avf(df, x, maxlag, periodogram), "acf")


def ccf(df, x, y, maxlag, periodogram=True) -> DataFrame:
    """Divided by the covariance at lag 0."""
    return _by_lag_0(cvf(df, x, y, maxlag, periodogram), "ccf")


def acf_std(df, x, maxlag, periodogram=True, confidence=0.6826895, simplified=True) -> DataFrame:
    """Standard errors: sqrt((1 + 2 sum of squares of the smaller lags) / n) times the normal quantile; 0 at lag 0. Not
    simplified, Bartlett's sum over all lags up to maxlag."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    r = acf(df, x, maxlag, periodogram)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    if simplified:
        w = Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)  # maxlag + 1 rows
        sq = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2)).over(w), F.lit(0.0))
        return r.crossJoin(F.broadcast(n)).select("lag", F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1 + 2 * sq) / F.col("__n")) * z).alias("std"))
    every = r.agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda v: v["acf"]).alias("r"))
    at = lambda i: F.coalesce(F.get("r", F.abs(i).cast("int")), F.lit(0.0))
    k = F.col("lag")
    term = lambda i: at(i) ** 2 + at(i + k) * at(i - k) - 4 * at(k) * at(i) * at(i - k) + 2 * at(k) ** 2 * at(i) ** 2
    total = F.aggregate(F.sequence(F.lit(-maxlag), F.lit(maxlag)), F.lit(0.0), lambda s, i: s + term(i))
    return r.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(n)).select("lag", F.when(k == 0, 0.0).otherwise(F.sqrt(F.greatest(total, F.lit(0.0)) / F.col("__n")) * z).alias("std"))


def levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of autocorrelations r, 0 at lag 0: the recursion of Levinson and Durbin, of which each
    order takes the coefficients of the one before."""
    out = np.zeros(len(r))
    phi, rest = np.zeros(0), float(r[0]) if len(r) else 1.0
    for k in range(1, len(r)):
        out[k] = (r[k] - phi @ r[k - 1 : 0 : -1]) / rest if rest else np.nan
        phi = np.append(phi - out[k] * phi[::-1], out[k])
        rest *= 1 - out[k] ** 2
    return out


def pacf(df: DataFrame, x: str, maxlag: int, periodogram: bool = True) -> DataFrame:
    """lag and pacf; the maxlag + 1 autocorrelations are solved together."""
    r = acf(df, x, maxlag, periodogram).withColumn("__g", F.lit(0))

    def run(rows):
        rows = rows.sort_values("lag")
        rows["pacf"] = levinson(rows["acf"].to_numpy())
        return rows[["lag", "pacf"]]

    return r.groupBy("__g").applyInPandas(run, "lag long, pacf double")
