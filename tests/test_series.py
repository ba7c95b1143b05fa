"""Calendar values and series results known beforehand: fixed values, listed in FIXTURES.md (gaps and duplicates: its section E)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewheel.errors import TimeSeriesCompatibilityError
from tidewheel.functions import period as P
from tidewheel.operators import align as A
from tidewheel.operators import core as C
from tidewheel.operators import corr as R
from tidewheel.operators import interp as I
from tidewheel.operators import moving as M
from tidewheel.operators import resample as S


def series(spark, xs, freq="D", t0=732677, ts=None):
    ts = range(t0, t0 + len(xs)) if ts is None else ts
    return C.with_freq(spark.createDataFrame([(int(t), None if x is None else float(x)) for t, x in zip(ts, xs)], "t long, x double"), freq)


def xs(df, c="x"):
    return [None if r[c] is None else round(r[c], 6) for r in df.orderBy("t").collect()]


@pytest.mark.parametrize(("freq", "text", "want"), [("D", "2007-01-01", 732677), ("D", "2001-01-01", 730486), ("M", "2007-01-01", 24073), ("A", "2007-01-01", 2007), ("S", "2001-09-09 01:46:40", 10**9), ("S", "2038-01-19 03:14:07", 2147483647), ("H", "1970-01-01 00:00:00", 0)])
def test_to_period(spark, freq, text, want):
    df = spark.createDataFrame([(text,)], "s string").select(P.to_period(F.col("s").cast("timestamp_ntz"), freq).alias("t"))
    assert df.first().t == want


DAY = 719163


@pytest.mark.parametrize(
    ("freq", "value", "first", "last"),
    [("A", 2007, "2007-01-01", "2007-12-31"), ("A-JAN", 2007, "2006-02-01", "2007-01-31"), ("A-JUN", 2007, "2006-07-01", "2007-06-30"), ("A-NOV", 2007, "2006-12-01", "2007-11-30"), ("Q-E-JAN", 8025, "2006-02-01", "2006-04-30"), ("Q-E-JUN", 8025, "2006-07-01", "2006-09-30"), ("Q-S-JAN", 8029, "2007-02-01", "2007-04-30"), ("Q-S-JUN", 8029, "2007-07-01", "2007-09-30"), ("Q-S-DEC", 8025, "2007-01-01", "2007-03-31")],
)
def test_bounds(spark, freq, value, first, last):
    r = spark.range(1).select(P.asfreq(F.lit(value), freq, "D", "START").alias("a"), P.asfreq(F.lit(value), freq, "D", "END").alias("b")).first()
    of = lambda t: (dt.date(1970, 1, 1) + dt.timedelta(t - DAY)).isoformat()
    assert (of(r.a), of(r.b)) == (first, last)


def test_weekend_to_business_day(spark):
    sat = dt.date(2007, 1, 6).toordinal()
    r = spark.range(1).select(*[P.asfreq(P.asfreq(F.lit(sat), "D", "B", x), "B", "D").alias(x) for x in ("START", "END")]).first()
    assert (r.START, r.END) == (dt.date(2007, 1, 5).toordinal(), dt.date(2007, 1, 8).toordinal())


def test_shift(spark):
    a = series(spark, [None if i in (0, 5, 10) else i for i in range(15)])
    n = None
    assert xs(A.tshift(a, -1)) == [n, n, 1, 2, 3, 4, n, 6, 7, 8, 9, n, 11, 12, 13]
    assert xs(A.tshift(a, 1)) == [1, 2, 3, 4, n, 6, 7, 8, 9, n, 11, 12, 13, 14, n]
    assert xs(C.compressed(a)) == [1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14]
    assert A.adjust_endpoints(a, end=732677 + 30).count() == 31
    assert A.adjust_endpoints(a, 732677 + 5, 732677 + 30).count() == 26


def test_changes(spark):
    a = series(spark, [2, 1, 2, 3], "A", 2005)
    assert xs(A.pct(a)) == [None, -0.5, 1.0, 0.5]
    assert xs(A.pct(a, 2)) == [None, None, 0.0, 2.0]
    assert xs(A.pct_log(a)) == [None, -0.693147, 0.693147, 0.405465]
    assert xs(A.pct_symmetric(a)) == [None, -0.666667, 0.666667, 0.4]


def test_gaps_and_duplicates(spark):
    assert xs(A.fill_missing_dates(series(spark, [1, 2, 3, 5, 6], ts=[1, 2, 3, 5, 6]))) == [1, 2, 3, None, 5, 6]
    ts = [2000, 2001, 2002, 2003, 2003, 2003, 2004, 2005, 2005, 2006]
    a = series(spark, range(10), "A", ts=ts).withColumn("pos", F.col("x"))
    assert {r.t: r.n for r in A.find_duplicated_dates(a, "pos").collect()} == {2003: 3, 2005: 2}
    assert xs(A.remove_duplicated_dates(a, "pos")) == [0, 1, 2, 3, 6, 7, 9]
    a, b, c = series(spark, [1, 2, 3], t0=1), series(spark, [10, 20, 30, 40, 50], t0=1), series(spark, range(100, 800, 100), t0=3)
    assert xs(A.concatenate([a, b, c])) == [1, 2, 3, 40, 50, 400, 500, 600, 700]
    assert xs(A.concatenate([c, a, b])) == [1, 2, 100, 200, 300, 400, 500, 600, 700]
    assert [r.step for r in C.steps(series(spark, [0] * 10, ts=[1, 2, 3, 4, 8, 9, 10, 11, 12, 15])).orderBy("t").collect()][1:] == [1, 1, 1, 4, 1, 1, 1, 1, 3]


def test_frequencies_must_match(spark):
    with pytest.raises(TimeSeriesCompatibilityError):
        A.align_series(series(spark, [1], "D"), series(spark, [1], "M").withColumnRenamed("x", "y"))


def test_convert(spark):
    up = S.convert(series(spark, range(5), "D", 719163 - 365), "H")
    assert up.count() == 120 and [i for i, x in enumerate(xs(up)) if x is not None] == [23, 47, 71, 95, 119]
    a = series(spark, [None if i in (0, 8, 9, 10, 11, 21, 23) else i for i in range(24)], "M", 24001)
    assert xs(S.convert(a, "A", "last")) == [7, 22]
    assert xs(S.convert(series(spark, range(62), "D", dt.date(2005, 7, 1).toordinal()), "M", "sum")) == [465, 1426]


@pytest.mark.parametrize("k", [3, 4, 5])
def test_moving(spark, k):
    x = [None if i == 10 else float(i * i % 7) for i in range(25)]
    a = series(spark, x, "U", 0)
    want = [None if i < k - 1 or None in x[i - k + 1 : i + 1] else round(sum(x[i - k + 1 : i + 1]) / k, 6) for i in range(25)]
    assert xs(M.mov_mean(a, "x", k)) == want
    assert xs(M.mov_mean(a, "x", k, block=4)) == want


def test_exponential_average(spark):
    assert xs(M.mov_average_expw(series(spark, range(150), "U", 0), "x", 10))[-1] == 144.5


def test_fill(spark):
    mask = [1, 0, 1, 0, 0, 1, 1, 0, 0, 0]
    a = series(spark, [None if m else i for i, m in enumerate(mask)], "U", 0)
    n = None
    assert xs(I.forward_fill(a, "x", 1)) == [n, 1, 1, 3, 4, n, n, 7, 8, 9]
    assert xs(I.forward_fill(a, "x")) == [n, 1, 1, 3, 4, 4, 4, 7, 8, 9]
    assert xs(I.backward_fill(a, "x", 1)) == [1, 1, 3, 3, 4, n, n, 7, 8, 9]
    assert xs(I.interpolate(a, "x")) == [n, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_autocovariance_by_hand(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    d = [v - sum(x) / 8 for v in x]
    want = [round(sum(a * b for a, b in zip(d, d[k:])) / 8, 6) for k in range(4)]
    assert [round(r["cov"], 6) for r in R.avf(series(spark, x), "x", 3).orderBy("lag").collect()] == want


def test_empty_series(spark):
    a = series(spark, [])
    assert A.fill_missing_dates(a).count() == 0 and M.mov_mean(a, "x", 3).count() == 0 and S.convert(a, "M", "sum").count() == 0
