"""Frequency conversion, timesteps, and counts of what is missing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.errors import TimeSeriesError
from tidewheel.functions import period as P
from tidewheel.functions.freq import Freq, parse, row_width

from .align import spine
from .blocks import same_keys
from .core import freq_of, span_of, step_of, values_of, with_freq

AGGREGATES: Mapping[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max, "count": F.count, "prod": F.product, "median": lambda x: F.percentile(x, F.lit(0.5)),
    "first": lambda x: F.min_by(x, F.when(x.isNotNull(), F.col("t"))), "last": lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("t"))),
}


def single(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """df, where a date that a key has twice raises an error when the rows are made."""
    names = values_of(df, keys)
    one = df.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*names)).alias("__row"))
    t = F.when(F.col("__n") == 1, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("duplicated date: "), F.col("t").cast("string"))).cast("long"))
    return with_freq(one.select(*keys, t.alias("t"), *[F.col("__row").getField(c).alias(c) for c in names]), freq_of(df), step_of(df))


def convert(df: DataFrame, freq: Freq | str, func: str | Callable | None = None, position: str = "END", keys: Sequence[str] = (), fill: bool = True, duplicates: str = "raise") -> DataFrame:
    """To a lower frequency: values of each new period reduced by func (a name of AGGREGATES, or any function of an array
    of values, which runs in pandas), or without func laid out as an array with a null for every missing cell. To a
    higher one: each value at the START or END of its period, the rest null. Periods between first and last that got
    nothing are null rows with fill.

    Gaps count as missing values. Repeated dates raise an error when the rows are made, or with duplicates="fold" all
    go into func, which saves a grouping by date. An undefined frequency on either side is an error."""
    a, b = freq_of(df), parse(freq)
    if a == b:
        return df
    if "U" in (a.base, b.base):
        raise TimeSeriesError("cannot convert from or to an undefined frequency")
    if position.upper() not in ("END", "START"):
        raise ValueError(f"position is END or START, not {position}")
    if duplicates == "raise":
        df = single(df, keys)
    if b.rank > a.rank:
        return _up(df, a, b, position, keys)
    own = df.withColumn("__p", P.asfreq("t", a, b))
    names = values_of(df, keys)
    if func is None:
        out = _laid_out(own, a, b, step_of(df), names, keys)
    elif isinstance(func, str):
        out = own.groupBy(*keys, "__p").agg(*[AGGREGATES[func](F.col(c)).alias(c) for c in names])
    else:
        out = _by_function(own, func, names, keys)
    out = with_freq(out.withColumnRenamed("__p", "t"), b)
    return with_freq(same_keys(spine(span_of(out, keys), keys), out, [*keys, "t"], "left").select(*keys, "t", *names), b) if fill else out


def _laid_out(own: DataFrame, a: Freq, b: Freq, step: int, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    width = row_width(a, b, step)
    pos = F.floor((F.col("t") - P.asfreq(P.asfreq("t", a, b), b, a, "START")) / step).cast("int")
    if a.rank <= parse("D").rank and b.base == "B":
        pos = F.lit(0)
    cells = own.withColumn("__pos", pos).groupBy(*keys, "__p").agg(*[F.map_from_entries(F.collect_list(F.struct("__pos", F.struct(c)))).alias(c) for c in names])
    lay = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at(F.col(c), i).getField(c))
    return cells.select(*keys, "__p", *[lay(c).alias(c) for c in names])


def _by_function(own: DataFrame, func: Callable, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    import pandas as pd

    fields = ", ".join([*(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys), "__p bigint", *(f"`{c}` double" for c in names)])

    def run(rows):
        rows = rows.sort_values("t")
        return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), rows["__p"].iloc[0], *(func(rows[c].to_numpy()) for c in names)]], columns=[*keys, "__p", *names])

    return own.select(*keys, "__p", "t", *names).groupBy(*keys, "__p").applyInPandas(run, fields)


def _up(df: DataFrame, a: Freq, b: Freq, position: str, keys: Sequence[str]) -> DataFrame:
    s = span_of(df, keys).select(*keys, P.asfreq("start_date", a, b, "START").alias("start_date"), P.asfreq("end_date", a, b, "END").alias("end_date"))
    if b.base == "B":  # only business days inside the first and last period
        s = span_of(df, keys).select(*keys, P.from_days(P.start_days(F.col("start_date"), a), b, "END").alias("start_date"), P.from_days(P.end_days(F.col("end_date"), a), b, "START").alias("end_date"))
    moved = df.withColumn("t", P.asfreq("t", a, b, position))
    return with_freq(same_keys(spine(s, keys), moved, [*keys, "t"], "left").select(*df.columns), b)


def convert_to_annual(df: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of years; the cells of 29 February are there in every year, null outside leap years. Daily and finer
    series have a cell for each unit; lower frequencies are converted as usual."""
    f = freq_of(df)
    if f.rank < parse("D").rank:
        return convert(df.select(*keys, "t", x), "A", keys=keys)
    date = P.end_date("t", f)
    per = row_width(f, parse("D")) if f.base in "HTS" else 1
    doy = F.dayofyear(date)
    day = doy + ((doy > 59) & ~P.isleapyear(F.year(date))).cast("int")
    slot = (day - 1) * per + F.pmod(F.col("t"), F.lit(per)) if per > 1 else day - 1
    cells = df.select(*keys, F.year(date).cast("long").alias("__p"), slot.cast("int").alias("s"), x).groupBy(*keys, "__p").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct(x)))).alias(x))
    out = cells.select(*keys, F.col("__p").alias("t"), F.transform(F.sequence(F.lit(0), F.lit(366 * per - 1)), lambda i: F.try_element_at(F.col(x), i).getField(x)).alias(x))
    return with_freq(out, "A")


def change_timestep(df: DataFrame, step: int, func: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """A larger multiple folds (as arrays, or reduced by func), a divisor of the present one inserts nulls."""
    old = step_of(df)
    names = values_of(df, keys)
    if step == old:
        return df
    if step > old:
        if step % old:
            raise TimeSeriesError("the new timestep must be a multiple of the old one")
        s = span_of(df, keys).select(*keys, F.col("start_date").alias("t0"))
        own = same_keys(df, s, keys) if keys else df.crossJoin(F.broadcast(s))  # one row without keys
        own = own.withColumn("__p", F.col("t0") + F.floor((F.col("t") - F.col("t0")) / step) * step).withColumn("__pos", ((F.col("t") - F.col("__p")) / old).cast("int"))
        if func:
            out = own.groupBy(*keys, "__p").agg(*[AGGREGATES[func](F.col(c)).alias(c) for c in names])
        else:
            cells = own.groupBy(*keys, "__p").agg(*[F.map_from_entries(F.collect_list(F.struct("__pos", F.struct(c)))).alias(c) for c in names])
            out = cells.select(*keys, "__p", *[F.transform(F.sequence(F.lit(0), F.lit(step // old - 1)), lambda i, c=c: F.try_element_at(F.col(c), i).getField(c)).alias(c) for c in names])
        return with_freq(out.withColumnRenamed("__p", "t"), freq_of(df), step)
    if old % step:
        raise TimeSeriesError("the new timestep must divide the old one")
    s = span_of(df, keys).withColumn("end_date", F.col("end_date") + (old - step))
    return with_freq(same_keys(spine(s, keys, step), df, [*keys, "t"], "left").select(*df.columns), freq_of(df), step)


def _cells(a: Freq, b: Freq) -> Column:
    """Periods of a inside the period p of b."""
    return P.asfreq("__p", b, a, "END") - P.asfreq("__p", b, a, "START") + 1


def count_missing(df: DataFrame, freq: Freq | str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Periods of each longer period that have no value; impossible dates don't count."""
    a, b = freq_of(df), parse(freq)
    own = df.withColumn("__p", P.asfreq("t", a, b)).groupBy(*keys, "__p").agg(F.count(x).alias("n"))
    return with_freq(own.select(*keys, F.col("__p").alias("t"), (_cells(a, b) - F.col("n")).alias("missing")), b)


def accept_atmost_missing(df: DataFrame, freq: Freq | str, x: str, max_missing: float, func: str = "mean", strict: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Longer periods reduced by func, null where as many periods are missing (strict: more). A number below 1 is a
    part of the row's full width, rounded."""
    a, b = freq_of(df), parse(freq)
    most = round(max_missing * row_width(a, b)) if max_missing < 1 else int(max_missing)
    own = df.withColumn("__p", P.asfreq("t", a, b)).groupBy(*keys, "__p").agg(F.count(x).alias("n"), AGGREGATES[func](F.col(x)).alias(x))
    gone = _cells(a, b) - F.col("n")
    bad = gone > most if strict else gone >= most
    return with_freq(own.select(*keys, F.col("__p").alias("t"), F.when(~bad, F.col(x)).alias(x)), b)
