"""Gap filling, alignment, arithmetic of series, concatenation and duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.errors import TimeSeriesCompatibilityError

from . import blocks
from .blocks import BLOCK, same_keys, scanned
from .core import by, freq_of, numbered, same_freq, span_of, step_of, values_of, windowed, with_freq


def spine(spans: DataFrame, keys: Sequence[str] = (), step: int = 1) -> DataFrame:
    """Every period from start_date to end_date of each key. A span is cut into blocks, which are dealt out before
    their periods are made, so no row or task holds a long span whole."""
    n = F.lit(step).cast("long")
    width = F.lit(BLOCK * step).cast("long")
    last = F.floor((F.col("end_date") - F.col("start_date")) / width).cast("long")
    cut = spans.where("start_date <= end_date").withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("start_date") + F.col("__b") * width
    dealt = cut.select(*keys, "__b", first.alias("__first"), F.least(F.col("end_date"), first + width - n).alias("__last")).repartition(*keys, "__b")
    return dealt.select(*keys, F.explode(F.sequence("__first", "__last", n)).alias("t"))


def fill_missing_dates(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Missing periods between a key's first and last, their values null. Full series come back as they are."""
    out = same_keys(spine(span_of(df, keys), keys, step_of(df)), df, [*keys, "t"], "left").select(*df.columns)
    return with_freq(out, freq_of(df), step_of(df))


def missing_dates(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return same_keys(spine(span_of(df, keys), keys, step_of(df)), df.select(*keys, "t"), [*keys, "t"], "left_anti")


def adjust_endpoints(df: DataFrame, start: int | None = None, end: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Cut or padded with nulls to start and end (None: the series' own)."""
    s = span_of(df, keys)
    s = s.withColumn("start_date", F.lit(start).cast("long") if start is not None else F.col("start_date")).withColumn("end_date", F.lit(end).cast("long") if end is not None else F.col("end_date"))
    return with_freq(same_keys(spine(s, keys, step_of(df)), df, [*keys, "t"], "left").select(*df.columns), freq_of(df), step_of(df))


def _distinct(*series: DataFrame, keys: Sequence[str]) -> None:
    names = [c for s in series for c in values_of(s, keys)]
    if len(set(names)) < len(names):
        raise TimeSeriesCompatibilityError("names", names, names)


def align_series(*series: DataFrame, start: int | None = None, end: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One DataFrame over the union of all spans (or the given one); gaps are null. Value names must differ."""
    f = same_freq(*series)
    _distinct(*series, keys=keys)
    every = series[0].select(*keys, "t")
    for s in series[1:]:
        every = every.unionByName(s.select(*keys, "t"))
    s = span_of(every, keys)
    s = s.withColumn("start_date", F.coalesce(F.lit(start).cast("long"), "start_date")).withColumn("end_date", F.coalesce(F.lit(end).cast("long"), "end_date"))
    out = spine(s, keys, step_of(series[0]))
    for x in series:
        out = same_keys(out, x, [*keys, "t"], "left")
    return with_freq(out, f, step_of(series[0]))


def align_with(first: DataFrame, *others: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The others over the first one's span."""
    _distinct(first, *others, keys=keys)
    out = spine(span_of(first, keys), keys, step_of(first))
    for x in (first, *others):
        out = same_keys(out, x, [*keys, "t"], "left")
    return with_freq(out, same_freq(first, *others), step_of(first))


def compatible(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> None:
    """Raises unless the dates of both are the same: by start, number, and each date, in that order. Two aggregates."""
    same_freq(a, b)
    marked = a.select(*keys, "t", F.lit(1).alias("__n")).unionByName(b.select(*keys, "t", F.lit(-1).alias("__n")))
    each = marked.groupBy(*keys, "t").agg(F.sum("__n").alias("d"), F.sum(F.when(F.col("__n") > 0, 1)).alias("na"), F.sum(F.when(F.col("__n") < 0, 1)).alias("nb"))
    per = each.groupBy(*keys).agg(F.min(F.when(F.col("na") > 0, F.col("t"))).alias("a"), F.min(F.when(F.col("nb") > 0, F.col("t"))).alias("b"), F.coalesce(F.sum("na"), F.lit(0)).alias("na"), F.coalesce(F.sum("nb"), F.lit(0)).alias("nb"), F.max(F.abs("d")).alias("d"))
    bad = per.where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("na") != F.col("nb")) | (F.col("d") != 0)).limit(1).collect()
    for r in bad:
        if r.a != r.b:
            raise TimeSeriesCompatibilityError("start_date", r.a, r.b)
        if r.na != r.nb:
            raise TimeSeriesCompatibilityError("size", r.na, r.nb)
        raise TimeSeriesCompatibilityError("time_steps", r.d, 0)


def binary(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column], x: str, y: str, out: str = "x", keys: Sequence[str] = (), align: bool = False, check: bool = False) -> DataFrame:
    """op on values of equal periods: an inner join, or an outer one with align. Other frequencies raise; with check, so
    do other dates (start, size, steps), which takes a job of its own."""
    f = same_freq(a, b)
    if check:
        compatible(a, b, keys)
    left, right = a.select(*keys, "t", F.col(x).alias("__x")), b.select(*keys, "t", F.col(y).alias("__y"))
    return with_freq(same_keys(left, right, [*keys, "t"], "full" if align else "inner").select(*keys, "t", op(F.col("__x"), F.col("__y")).alias(out)), f)


def stack(*series: DataFrame, keys: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Values side by side; with check, dates that aren't the same in all are an error when the rows are made."""
    f = same_freq(*series)
    names = [c for s in series for c in values_of(s, keys)]
    if len(set(names)) < len(names):
        raise TimeSeriesCompatibilityError("names", names, names)
    out = None
    for i, s in enumerate(series):
        s = s.withColumn(f"__in{i}", F.lit(1))
        out = s if out is None else same_keys(out, s, [*keys, "t"], "full" if check else "inner")
    if check:
        ok = F.lit(True)
        for i in range(len(series)):
            ok = ok & F.col(f"__in{i}").isNotNull()
        out = out.withColumn("t", F.when(ok, F.col("t")).otherwise(F.raise_error(F.lit("dates differ")).cast("long")))
    return with_freq(out.select(*keys, "t", *names), f)


def concatenate(series: Sequence[DataFrame], keys: Sequence[str] = (), remove_duplicates: bool = True, fill_missing: bool = False, order: str | None = None) -> DataFrame:
    """All rows by date; of equal dates the earliest listed series wins, then the smallest order (or values)."""
    f = same_freq(*series)
    out = None
    for i, s in enumerate(series):
        s = s.withColumn("__src", F.lit(i))
        out = s if out is None else out.unionByName(s)
    if remove_duplicates:
        tie = [order] if order else values_of(series[0], keys)
        w = Window.partitionBy(*keys, "t").orderBy("__src", *tie)
        out = out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    out = with_freq(out.drop("__src"), f)
    return fill_missing_dates(out, keys) if fill_missing else out


def remove_duplicated_dates(df: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The first row of each date in the order of a column (rows of a DataFrame have none of their own)."""
    w = Window.partitionBy(*keys, "t").orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def find_duplicated_dates(df: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(order)).alias("positions")).where("n > 1")


# shifts: rows are positions, as in a gap-free series


def tshift(df: DataFrame, nper: int, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Values moved by nper rows: negative to the right; the ends are null."""
    made = {c: lambda w, c=c: F.lag(c, -nper).over(w) if nper < 0 else F.lead(c, nper).over(w) for c in values_of(df, keys)}
    return windowed(df, keys, max(0, -nper), max(0, nper), made, block)


def _with_lag(df: DataFrame, nper: int, keys: Sequence[str], f: Callable[[Column, Column], Column], block: int | None) -> DataFrame:
    made = {c: lambda w, c=c: f(F.col(c).cast("double"), F.lag(c, nper).over(w).cast("double")) for c in values_of(df, keys)}
    return windowed(df, keys, max(0, nper), max(0, -nper), made, block)


def pct(df: DataFrame, nper: int = 1, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    return _with_lag(df, nper, keys, lambda x, y: F.try_divide(x, y) - 1, block)


def pct_log(df: DataFrame, nper: int = 1, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    return _with_lag(df, nper, keys, lambda x, y: F.ln(F.try_divide(x, y)), block)


def pct_symmetric(df: DataFrame, nper: int = 1, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    return _with_lag(df, nper, keys, lambda x, y: F.try_divide(2 * (x - y), x + y), block)


# statistics along dates


def stats(df: DataFrame, x: str, keys: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """sum prod mean var std count min max ptp, and the dates of the extremes; nulls don't count. ordered: sum, mean and
    variance (by Welford's updates) take values in the order of dates, so that their last digits don't change with tasks;
    a key's values are then an array, one for each of its dates."""
    v = F.col(x)
    some = v.isNotNull()
    made = {"sum": F.sum(v), "mean": F.avg(v), "var": F.var_pop(v), "std": F.stddev_pop(v)}
    if ordered:
        v0 = F.lit(0.0)
        runs = F.sort_array(F.collect_list(F.when(some, F.struct("t", v.cast("double").alias("v")))))
        run = F.aggregate(runs, F.struct(v0.alias("n"), v0.alias("sum"), v0.alias("m"), v0.alias("q")), _welford)
        n = F.when(F.count(v) > 0, F.count(v))
        made = {"sum": F.when(n > 0, run["sum"]), "mean": run["sum"] / n, "var": run["q"] / n, "std": F.sqrt(run["q"] / n)}
    return df.groupBy(*keys).agg(
        made["sum"].alias("sum"), F.product(v).alias("prod"), *[made[n].alias(n) for n in ("mean", "var", "std")], F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("ptp"),
        F.min(F.when(some, F.struct(v.alias("v"), F.col("t")))).getField("t").alias("argmin"), F.min(F.when(some, F.struct((-v).alias("v"), F.col("t")))).getField("t").alias("argmax"),
    )


def _welford(s: Column, e: Column) -> Column:
    v, n = e["v"], s["n"] + 1
    m = s["m"] + (v - s["m"]) / n
    return F.struct(n.alias("n"), (s["sum"] + v).alias("sum"), m.alias("m"), (s["q"] + (v - m) * (v - s["m"])).alias("q"))


def all_any(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(F.col(x).cast("boolean")).alias("all"), F.bool_or(F.col(x).cast("boolean")).alias("any"))


def across(df: DataFrame, columns: Sequence[str], how: str = "sum", out: str = "x") -> DataFrame:
    """sum mean min max count over the variables of a date; the dates stay."""
    some = F.array_compact(F.array(*columns))
    total = F.aggregate(some, F.lit(0.0), lambda a, v: a + v.cast("double"))
    n = F.size(some)
    made = {"sum": F.when(n > 0, total), "mean": F.try_divide(total, n), "count": n, "min": F.array_min(some), "max": F.array_max(some)}
    return df.withColumn(out, made[how])


def _running(df: DataFrame, x: str, keys: Sequence[str], out: str | None, agg, scan, block: int | None) -> DataFrame:
    if keys and block is None:
        w = by(keys).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out or x, F.when(F.col(x).isNotNull(), agg(F.col(x)).over(w)))
    got = scanned(df, keys, {"__sum": scan(F.col(x))}, block or BLOCK)
    return got.withColumn(out or x, F.when(F.col(x).isNotNull(), F.col("__sum"))).drop("__sum")


def cumsum(df: DataFrame, x: str, keys: Sequence[str] = (), out: str | None = None, block: int | None = None) -> DataFrame:
    """Running sums; missing values don't count and stay missing. Without keys, or with block, by blocks of periods."""
    return _running(df, x, keys, out, F.sum, blocks.total, block)


def cumprod(df: DataFrame, x: str, keys: Sequence[str] = (), out: str | None = None, block: int | None = None) -> DataFrame:
    return _running(df, x, keys, out, F.product, blocks.product, block)


def anom(df: DataFrame, x: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Deviations from the mean, which is a small aggregate joined back."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("__mean"))
    joined = same_keys(df, mean, keys) if keys else df.crossJoin(F.broadcast(mean))  # one row without keys
    return joined.withColumn(out or x, F.col(x) - F.col("__mean")).drop("__mean")


def clip(df: DataFrame, x: str, low: float | None = None, high: float | None = None, out: str | None = None) -> DataFrame:
    v = F.col(x)
    v = v if low is None else F.when(v < low, F.lit(low)).otherwise(v)
    v = v if high is None else F.when(v > high, F.lit(high)).otherwise(v)
    return df.withColumn(out or x, v)


def rounded(df: DataFrame, x: str, digits: int = 0, out: str | None = None) -> DataFrame:
    """To the nearest, halves to the even neighbour."""
    return df.withColumn(out or x, F.bround(x, digits))


def take(df: DataFrame, at: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Rows at these positions (negative from the end are not read), as often as they are listed."""
    wanted = df.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(at)], "__at long, place long")
    return numbered(df, keys, "__pos").join(F.broadcast(wanted), F.col("__pos") == F.col("__at")).drop("__pos", "__at")


def repeat(df: DataFrame, n: int) -> DataFrame:
    """Each row n times."""
    return df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("__i") if n > 0 else df.limit(0)


def searchsorted(df: DataFrame, dates: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """date and pos: how many dates of each key come before it. One aggregate over the series."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col("t") < int(d)).alias(f"__{i}") for i, d in enumerate(dates)])
    pairs = F.array(*[F.struct(F.lit(int(d)).cast("long").alias("date"), F.col(f"__{i}").alias("pos")) for i, d in enumerate(dates)])
    return counts.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.date", "p.pos")


def ranked(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """argsort: positions from 0 in the order of values, nulls last."""
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last(), "t")
    return numbered(df, keys).withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
