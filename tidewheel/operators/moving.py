"""Moving windows: null for the first span - 1 rows and wherever one of the span rows is missing.

A key is a window's whole partition; without keys, or with block, rows are dealt by blocks of positions, each with the
rows before and after it that its windows reach, so a series of any length, with or without gaps, runs in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .blocks import same_keys
from .core import finite, windowed


def _moved(df: DataFrame, span: int, make: Callable[[WindowSpec], Column], gates: Sequence[str], out: str, keys: Sequence[str], block: int | None, before: int | None = None) -> DataFrame:
    if span < 1:
        raise ValueError("span must be positive")
    before = span - 1 if before is None else before
    after = span - 1 - before

    def whole(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-before, after)
        ok = F.count(F.lit(1)).over(frame) == span
        for g in gates:
            ok = ok & (F.count(finite(g)).over(frame) == span)
        return F.when(ok, make(frame))

    return windowed(df, keys, before, after, {out: whole}, block)


def _one(name: str, f: Callable[[Column], Column]):
    def moving(df: DataFrame, x: str, span: int, keys: Sequence[str] = (), out: str | None = None, block: int | None = None) -> DataFrame:
        return _moved(df, span, lambda w: f(finite(x)).over(w), [x], out or x, keys, block)

    moving.__name__ = name
    return moving


mov_sum = _one("mov_sum", F.sum)
mov_mean = mov_average = _one("mov_mean", F.avg)
mov_min = _one("mov_min", F.min)
mov_max = _one("mov_max", F.max)


def mov_median(df, x, span, keys=(), out=None, block=None):
    return _moved(df, span, lambda w: F.percentile(finite(x), F.lit(0.5)).over(w), [x], out or x, keys, block)


def mov_var(df, x, span, ddof=0, keys=(), out=None, block=None):
    scale = F.try_divide(F.lit(float(span)), F.lit(float(span - ddof)))
    return _moved(df, span, lambda w: F.var_pop(finite(x)).over(w) * scale, [x], out or x, keys, block)


def mov_std(df, x, span, ddof=0, keys=(), out=None, block=None):
    scale = F.try_divide(F.lit(float(span)), F.lit(float(span - ddof)))
    return _moved(df, span, lambda w: F.sqrt(F.var_pop(finite(x)).over(w) * scale), [x], out or x, keys, block)


def mov_cov(df, x, y, span, bias=0, keys=(), out="cov", block=None):
    f = F.covar_pop if bias else F.covar_samp
    return _moved(df, span, lambda w: f(finite(x), finite(y)).over(w), [x, y], out, keys, block)


def mov_corr(df, x, y, span, keys=(), out="corr", block=None):
    def make(w):
        d = F.stddev_pop(finite(x)).over(w) * F.stddev_pop(finite(y)).over(w)
        return F.try_divide(F.covar_pop(finite(x), finite(y)).over(w), F.when(d > 0, d))

    return _moved(df, span, make, [x, y], out, keys, block)


def cmov_mean(df, x, span, keys=(), out=None, block=None):
    """Centred mean; for an even span one row more lies before."""
    return _moved(df, span, lambda w: F.avg(finite(x)).over(w), [x], out or x, keys, block, before=span - 1 - (span - 1 - span // 2))


cmov_average = cmov_mean


def window_weights(kind, n: int) -> np.ndarray:
    """Symmetric windows: a name, (name, parameter...), or a number (kaiser)."""
    name, *args = (kind,) if isinstance(kind, str) else ("kaiser", kind) if isinstance(kind, (int, float)) else kind
    i, m = np.arange(n), max(1, n - 1)
    c = lambda k: np.cos(2 * np.pi * k * i / m)
    f = np.abs(i / m - 0.5)
    g = np.abs(2 * i / m - 1)
    if n == 1:
        return np.ones(1)
    if name == "parzen":
        u = np.abs(i - m / 2) / (n / 2)
        return np.where(u <= 0.5, 1 - 6 * u**2 + 6 * u**3, 2 * (1 - u) ** 3)
    if name == "slepian":
        h, k = args[0] / 2, np.arange(1, n)
        a = np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * h)) + np.diag(k * (n - k) / 2, 1) + np.diag(k * (n - k) / 2, -1)
        v = np.abs(np.linalg.eigh(a)[1][:, -1])
        return v / v.max()
    made = {
        "boxcar": lambda: np.ones(n), "bartlett": lambda: 1 - g, "triang": lambda: 1 - np.abs(2 * i - m) / (n + n % 2), "hamming": lambda: 0.54 - 0.46 * c(1), "blackman": lambda: 0.42 - 0.5 * c(1) + 0.08 * c(2),
        "blackmanharris": lambda: 0.35875 - 0.48829 * c(1) + 0.14128 * c(2) - 0.01168 * c(3), "nuttall": lambda: 0.3635819 - 0.4891775 * c(1) + 0.1365995 * c(2) - 0.0106411 * c(3), "barthann": lambda: 0.62 - 0.48 * f + 0.38 * np.cos(2 * np.pi * f),
        "bohman": lambda: (1 - g) * np.cos(np.pi * g) + np.sin(np.pi * g) / np.pi, "kaiser": lambda: np.i0(args[0] * np.sqrt(np.maximum(0, 1 - (2 * i / m - 1) ** 2))) / np.i0(args[0]),
        "gaussian": lambda: np.exp(-0.5 * ((i - m / 2) / args[0]) ** 2), "general_gaussian": lambda: np.exp(-0.5 * np.abs((i - m / 2) / args[1]) ** (2 * args[0])),
    }
    return made[name]()


def cmov_window(df, x, span, kind="boxcar", normalize=False, keys=(), out=None, block=None):
    """Centred weighted sum over span (normalize: over the weights' sum). Taps of weight 0 don't spread missing values."""
    weights = window_weights(kind, span)
    before = span // 2
    total = float(weights.sum()) if normalize else float(span)

    def make(w):  # lag and lead need the ordering alone
        parts = [F.lag(finite(x), before - j).over(w) if j <= before else F.lead(finite(x), j - before).over(w) for j in range(span)]
        acc = F.lit(0.0)
        for p, k in zip(parts, weights):
            if abs(k) > 1e-15:
                acc = acc + p * F.lit(float(k))
        return F.when(F.count(F.lit(1)).over(w.rowsBetween(-before, span - 1 - before)) == span, acc / F.lit(total))

    return windowed(df, keys, before, span - 1 - before, {out or x: make}, block)


def mov_average_expw(df, x, span, tol=1e-6, keys=(), out=None, block=256):
    """Exponential average: y starts at the first value and moves by k (x - y), k = 2 / (span + 1); a missing x carries y.
    Null where the same average of the missing flags leaves more than tol. Rows of one date follow by value.

    Both are affine maps of the state, so a block of periods is one map, `block` blocks are one map again, and so on
    until the maps of a key are few; then each block starts from its own state. No row holds more than `block` of them.
    """
    out, k = out or x, 2.0 / (span + 1)
    d, names = "double", list(df.columns)
    v = finite(x).cast(d)
    state = lambda y, e: F.struct(y.cast(d).alias("y"), e.cast(d).alias("e"))  # noqa: E731  y: null before the first value; e: share of values so far

    def step(s, r):
        y = F.when(r["v"].isNull(), s["y"]).otherwise(F.coalesce(s["y"] + F.lit(k) * (r["v"] - s["y"]), r["v"]))
        hit = F.when(r["gone"], F.lit(0.0)).otherwise(F.lit(1.0))
        return state(y, F.coalesce(s["e"] + F.lit(k) * (hit - s["e"]), hit))

    def apply(m, s):
        """The state after map m: own + keep * state, or what m makes of nothing."""
        return state(F.coalesce(m["y0"] + m["ky"] * s["y"], m["fy"], s["y"]), F.coalesce(m["e0"] + m["ke"] * s["e"], m["fe"], s["e"]))

    cells = df.withColumn("__b", F.floor(F.col("t") / block).cast("long")).select(*keys, "__b", F.struct("t", v.alias("v"), F.col(x).isNull().alias("gone"), F.struct(*[F.col(c) for c in names]).alias("row")).alias("r"))
    rows = cells.groupBy(*keys, "__b").agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)).alias("rows"))
    n, values = F.size("rows"), F.size(F.filter("rows", lambda r: r["v"].isNotNull()))
    zero = F.aggregate("rows", state(F.lit(0.0), F.lit(0.0)), step)
    fresh = F.aggregate("rows", state(F.lit(None), F.lit(None)), step)
    maps = rows.select(*keys, "__b", F.struct(zero["y"].alias("y0"), F.pow(F.lit(1 - k), values).alias("ky"), fresh["y"].alias("fy"), zero["e"].alias("e0"), F.pow(F.lit(1 - k), n).alias("ke"), fresh["e"].alias("fe")).alias("m"))

    def begins(maps: DataFrame, level: int) -> DataFrame:
        """keys, __b and the state s before each block."""
        up = maps.withColumn("__s", F.floor(F.col("__b") / block).cast("long") if level else F.lit(0).cast("long"))
        groups = up.groupBy(*keys, "__s").agg(F.array_sort(F.collect_list(F.struct("__b", "m"))).alias("ms"))
        if level:
            both = lambda a, m: F.struct((m["y0"] + m["ky"] * a["y0"]).alias("y0"), (a["ky"] * m["ky"]).alias("ky"), F.coalesce(m["y0"] + m["ky"] * a["fy"], m["fy"]).alias("fy"), (m["e0"] + m["ke"] * a["e0"]).alias("e0"), (a["ke"] * m["ke"]).alias("ke"), F.coalesce(m["e0"] + m["ke"] * a["fe"], m["fe"]).alias("fe"))
            same = F.struct(F.lit(0.0).alias("y0"), F.lit(1.0).alias("ky"), F.lit(None).cast(d).alias("fy"), F.lit(0.0).alias("e0"), F.lit(1.0).alias("ke"), F.lit(None).cast(d).alias("fe"))
            tops = groups.select(*keys, F.col("__s").alias("__b"), F.aggregate("ms", same, lambda a, m: both(a, m["m"])).alias("m"))
            groups = same_keys(groups, begins(tops, level - 1).select(*keys, F.col("__b").alias("__s"), "s"), [*keys, "__s"])
        else:
            groups = groups.withColumn("s", state(F.lit(None), F.lit(None)))
        empty = F.struct(F.col("s").alias("s"), F.array().cast("array<struct<b:bigint,s:struct<y:double,e:double>>>").alias("all"))
        listed = F.aggregate("ms", empty, lambda a, m: F.struct(apply(m["m"], a["s"]).alias("s"), F.concat(a["all"], F.array(F.struct(m["__b"].alias("b"), a["s"].alias("s")))).alias("all")))["all"]
        return groups.select(*keys, F.explode(listed).alias("c")).select(*keys, F.col("c.b").alias("__b"), F.col("c.s").alias("s"))

    run = same_keys(rows, begins(maps, 2), [*keys, "__b"])
    init = F.struct(F.col("s").alias("s"), F.array().cast("array<struct<y:double,e:double>>").alias("all"))
    states = F.aggregate("rows", init, lambda a, r: (lambda s: F.struct(s.alias("s"), F.concat(a["all"], F.array(s)).alias("all")))(step(a["s"], r)))["all"]
    each = run.select(F.explode(F.arrays_zip(F.transform("rows", lambda r: r["row"]).alias("row"), states.alias("s"))).alias("z"))
    res = each.select(*[F.col(f"z.row.{c}").alias(c) for c in names if c != out], F.when(1 - F.col("z.s.e") <= tol, F.col("z.s.y")).alias(out))
    return res.select(*names, *[out] * (out not in names))
