"""The calendar on streams: conversion to a period as an aggregate whose state the watermark bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.errors import TimeSeriesError
from tidewheel.functions import period as P
from tidewheel.functions.freq import parse
from tidewheel.operators.core import with_freq
from tidewheel.operators.resample import AGGREGATES

_WIDTH = {"W": "7 days", "D": "1 day", "H": "1 hour", "T": "1 minute", "S": "1 second"}


def convert_stream(events: DataFrame, time: str, x: str, freq, func: str = "sum", late: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """t, x for each key and period of a stream (or a batch) of events. func is one of sum, mean, min, max, count, std
    or var. Rows more than `late` behind the newest are left out, and a period is given out (append mode) and forgotten
    once the watermark has passed its end.

    Weeks, days and finer units are windows of fixed width, in the session's time zone, which has to be UTC. Business
    days, months, quarters and years aren't; on a stream a group of these keeps its sums as state of its own, with a
    timer at the period's end.
    """
    f = parse(freq)
    own = events.withColumn("__ts", F.col(time).cast("timestamp"))
    if not events.isStreaming:
        out = own.groupBy(*keys, P.to_period("__ts", f).alias("t")).agg(AGGREGATES[func](F.col(x)).alias(x))
    elif f.base in _WIDTH:
        offset = f"{(f.anchor + 1 - P.EPOCH) % 7 if f.base == 'W' else 0} days"
        w = own.withWatermark("__ts", late).groupBy(*keys, F.window("__ts", _WIDTH[f.base], _WIDTH[f.base], offset)).agg(AGGREGATES[func](F.col(x)).alias(x))
        out = w.select(*keys, P.to_period("window.start", f).alias("t"), x)
    else:
        out = _by_state(own.withWatermark("__ts", late), x, f, func, keys)
    return with_freq(out, f)


def _by_state(own: DataFrame, x: str, f, func: str, keys: Sequence[str]) -> DataFrame:
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    if func not in ("sum", "mean", "min", "max", "count", "std", "var"):
        raise TimeSeriesError(f"{func} is not for streams")
    t = P.to_period("__ts", f)
    # the start of the next period, so weekends count for the business day they are converted to
    end = F.unix_millis(P.start_timestamp(P.to_period("__ts", f) + 1, f).cast("timestamp"))
    rows = own.select(*keys, "__ts", t.alias("t"), end.alias("__end"), F.col(x).cast("double").alias(x))
    own_keys = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " * bool(keys)

    def update(key, batches, state):
        if state.hasTimedOut:
            n, total, square, low, high = state.get
            state.remove()
            mean = total / n if n else None
            var = max(0.0, square / n) if n else None
            made = {"sum": total if n else None, "mean": mean, "min": low, "max": high, "count": float(n), "var": var, "std": var**0.5 if n else None}
            yield pd.DataFrame([[*key[:-1], made[func]]], columns=[*keys, "t", x]).astype({x: float})
            return
        n, total, square, low, high = state.get if state.exists else (0, 0.0, 0.0, None, None)
        for rows in batches:
            v = rows[x].dropna()
            if len(v):  # square: of the deviations from the mean, joined as two samples
                m, s = len(v), float(v.sum())
                apart = (s / m - total / n) ** 2 * n * m / (n + m) if n else 0.0
                square += float(((v - s / m) ** 2).sum()) + apart
                n, total = n + m, total + s
                low, high = (float(v.min()) if low is None else min(low, float(v.min()))), (float(v.max()) if high is None else max(high, float(v.max())))
        state.update((n, total, square, low, high))
        state.setTimeoutTimestamp(max(int(key[-1]), state.getCurrentWatermarkMs() + 1))

    out = rows.groupBy(*keys, "t", "__end").applyInPandasWithState(update, f"{own_keys}t bigint, `{x}` double", "n bigint, total double, square double, low double, high double", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*keys, "t", F.col(x).cast("long").alias(x) if func == "count" else x)


def sliding(events: DataFrame, time: str, x: str, width: str, slide: str, late: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Sliding sums, means and counts over event time."""
    own = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    w = own.groupBy(F.window("__ts", width, slide), *keys).agg(F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.count(x).alias("count"))
    return w.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "sum", "mean", "count")
