"""Blocks give what whole windows give; null keys, repeated dates and clashing names lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import series, xs
from tidewheel.errors import DateError, TimeSeriesCompatibilityError, TimeSeriesError
from tidewheel.operators import align as A
from tidewheel.operators import blocks as B
from tidewheel.operators import core as C
from tidewheel.operators import corr as R
from tidewheel.operators import interp as I
from tidewheel.operators import moving as M
from tidewheel.operators import resample as S


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(1)
    ts = sorted(rng.choice(400, 120, replace=False))
    rows = [(k, int(t), None if rng.random() < 0.25 else float(rng.integers(1, 50))) for k in ("a", None) for t in ts]
    return C.with_freq(spark.createDataFrame(rows, "k string, t long, x double"), "D").cache()


def rows(df):
    return sorted([tuple("" if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()], key=repr)


BOTH = {
    "cumsum": lambda d, b: A.cumsum(d, "x", ("k",), block=b),
    "cumprod": lambda d, b: A.cumprod(d.withColumn("x", 1 + F.col("x") / 1e4), "x", ("k",), block=b),
    "tshift": lambda d, b: A.tshift(d, -3, ("k",), block=b),
    "tshift ahead": lambda d, b: A.tshift(d, 2, ("k",), block=b),
    "pct": lambda d, b: A.pct(d, 2, ("k",), block=b),
    "pct_log": lambda d, b: A.pct_log(d, 1, ("k",), block=b),
    "ffill": lambda d, b: I.forward_fill(d, "x", keys=("k",), block=b),
    "ffill maxgap": lambda d, b: I.forward_fill(d, "x", 1, keys=("k",), block=b),
    "bfill maxgap": lambda d, b: I.backward_fill(d, "x", 1, keys=("k",), block=b),
    "linear": lambda d, b: I.interpolate(d, "x", keys=("k",), block=b),
    "mean": lambda d, b: M.mov_mean(d, "x", 3, ("k",), block=b),
    "median": lambda d, b: M.mov_median(d, "x", 3, ("k",), block=b),
    "std": lambda d, b: M.mov_std(d, "x", 4, 1, ("k",), block=b),
    "cov": lambda d, b: M.mov_cov(d.withColumn("y", F.col("x") ** 2), "x", "y", 3, keys=("k",), block=b),
    "centred": lambda d, b: M.cmov_window(d, "x", 5, "hamming", keys=("k",), block=b),
}


@pytest.mark.parametrize("name", BOTH)
def test_blocks_equal_whole_windows(gappy, name, monkeypatch):
    want = rows(BOTH[name](gappy, None))
    monkeypatch.setattr(B, "BLOCK", 3)  # levels of three blocks
    assert rows(BOTH[name](gappy, 7)) == want and len(want) == 240


@pytest.mark.parametrize("block", [2, 5, 256])
def test_exponential_average_in_any_blocks(spark, block):
    rng = np.random.default_rng(2)
    data = [(k, int(t), None if rng.random() < 0.2 else float(rng.integers(9)), f"{t}") for k in (None, 1) for t in [*range(40), 11, 11]]
    df = C.with_freq(spark.createDataFrame(data, "k int, t long, x double, note string"), "D")
    out = M.mov_average_expw(df, "x", 4, 1.0, ("k",), "e", block)
    assert out.count() == len(data) and out.where("note <> CAST(t AS STRING)").count() == 0
    want = {}
    for k in (None, 1):
        y = None
        for _, t, x, _ in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            y = y if x is None else x if y is None else y + 0.4 * (x - y)
            want.setdefault((k, t), []).append(y)
    got = {}
    for r in out.collect():
        got.setdefault((r.k, r.t), []).append(r.e)
    assert all(np.allclose(sorted(v or 0 for v in got[q]), sorted(v or 0 for v in want[q])) for q in want) and got.keys() == want.keys()


def test_plans_without_keys_have_no_whole_window(spark, monkeypatch):
    """Every window of the rows themselves is partitioned; the one over totals of totals is not of rows."""
    a = series(spark, range(50))
    for df in (A.cumsum(a, "x"), A.tshift(a, -1), I.forward_fill(a, "x"), M.mov_mean(a, "x", 3), C.positions(a, 1, 9)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "__b" in plan


def chronological(rows):
    ts = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0))]
    return not any(a is not None and b is not None and b < a for a, b in zip(ts, ts[1:]))


@pytest.mark.parametrize("block", [2, 4096])
def test_chronological_by_ranges_of_the_order(spark, block, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", block)
    rng = np.random.default_rng(5)
    data = {}
    for k in range(60):  # long runs upward with a step back, a null or nothing at one place; orders far apart
        n = int(rng.integers(1, 40))
        ts = [*range(n)]
        if k % 3:
            ts[int(rng.integers(n))] = None if k % 3 == 1 else -1
        data[k or None] = list(zip([int(o) for o in np.sort(rng.choice(10**12, n, replace=False))], ts))
    data[7].append((None, 99))
    data[8].append((None, -2))
    df = spark.createDataFrame([(k, o, t) for k, rs in data.items() for o, t in rs], "k int, o long, t long").repartition(5)
    got = {r.k: r.is_chronological for r in C.is_chronological(df, "o", ("k",)).collect()}
    assert got == {k: chronological(rs) for k, rs in data.items()} and len(set(got.values())) == 2
    for k in (1, 2, 3, 8):
        assert C.is_chronological(df.where(F.col("k") == k), "o").collect() == [(chronological(data[k]),)]
    assert C.is_chronological(df.where("k = 3").withColumn("o", F.format_string("%015d", "o")), "o").first()[0]
    assert C.is_chronological(df.limit(0), "o").collect() == [(True,)]


def test_no_task_holds_the_rows_of_an_order(spark):
    """Windows of the rows go by blocks; those over a whole key are over blocks of blocks."""
    a = series(spark, range(50)).withColumn("o", F.col("t"))
    for df in (C.is_chronological(a, "o"), C.guess_freq(a.select(F.timestamp_seconds(F.col("t")).alias("ts")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("__b" in w or "__p" in w for w in plan.splitlines() if "Window " in w) and plan.count("Window ") == 3 and "RepartitionByExpression" in plan


def test_null_keys_keep_their_values(spark):
    df = C.with_freq(spark.createDataFrame([(None, 1, 1.0), (None, 3, 3.0), ("a", 1, 5.0), ("a", 2, 6.0)], "k string, t long, x double"), "D")
    filled = A.fill_missing_dates(df, ("k",))
    assert rows(filled) == rows(spark.createDataFrame([(None, 1, 1.0), (None, 2, None), (None, 3, 3.0), ("a", 1, 5.0), ("a", 2, 6.0)], "k string, t long, x double"))
    assert [(r.k, r.t) for r in A.missing_dates(df, ("k",)).collect()] == [(None, 2)]
    assert A.adjust_endpoints(df, 0, 3, ("k",)).where("x IS NOT NULL").count() == 4
    both = A.align_series(df, df.withColumnRenamed("x", "y"), keys=("k",))
    assert both.where("x = y").count() == 4 and both.count() == 5
    assert A.binary(df, df, lambda x, y: x + y, "x", "x", keys=("k",)).agg(F.sum("x")).first()[0] == 30
    assert S.convert(df, "M", "sum", keys=("k",)).agg(F.sum("x")).first()[0] == 15
    assert A.anom(df, "x", ("k",)).count() == 4


def test_clashing_names(spark):
    df = C.with_freq(spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "t long, p double, pos double"), "D")
    assert S.convert(df, "M", "sum").select("p", "pos").first() == (4.0, 6.0)
    assert S.convert_to_annual(df.select("t", "p"), "p").count() == 1 and S.count_missing(df, "M", "p").first().missing == 29
    assert A.cumsum(df, "p").count() == 2


def test_convert_refuses_repeated_dates(spark):
    a = series(spark, [1, 2, 3], ts=[1, 1, 2])
    for make in (lambda: S.convert(a, "M", "sum"), lambda: S.convert(a, "M"), lambda: S.convert(a, "H")):
        with pytest.raises(Exception, match="duplicated date"):
            make().collect()
    assert S.convert(a, "M", "sum", duplicates="fold").first().x == 6
    with pytest.raises(TimeSeriesError):
        S.convert(series(spark, [1], "U"), "M")
    with pytest.raises(ValueError):
        S.convert(a, "M", "sum", position="MIDDLE")


def test_compatible_dates(spark):
    a = series(spark, [1, 2, 3])
    add = lambda b: A.binary(a, b, lambda x, y: x + y, "x", "x", check=True)
    assert xs(add(a)) == [2, 4, 6]
    for b, mode in ((series(spark, [1, 2, 3], t0=732678), "start_date"), (series(spark, [1, 2]), "size"), (series(spark, [1, 2, 3], ts=[732677, 732678, 732680]), "time_steps"), (series(spark, [1, 2, 3], "M"), "freq")):
        with pytest.raises(TimeSeriesCompatibilityError) as e:
            add(b)
        assert e.value.mode == mode
    with pytest.raises(TimeSeriesCompatibilityError):
        A.stack(a, a)
    with pytest.raises(Exception, match="dates differ"):
        A.stack(a, series(spark, [1, 2]).withColumnRenamed("x", "y")).collect()


def test_dates_of_other_units_and_missing_dates(spark):
    a = series(spark, [1, 2, 3])
    with pytest.raises(DateError):
        C.difference(F.col("t"), F.col("t"), "D", "M")
    with pytest.raises(DateError):
        C.compared(F.col("t"), F.col("t"), "D", "B")
    with pytest.raises(IndexError):
        C.at_dates(a, [732677, 5], check=True)
    assert C.at_dates(a, [732677], check=True).count() == 1


def test_windows_by_numpy():
    for n in (1, 4, 5, 8):
        for name, want in (("bartlett", np.bartlett(n)), ("blackman", np.blackman(n)), ("hamming", np.hamming(n)), (5.0, np.kaiser(n, 5.0)), ("boxcar", np.ones(n))):
            assert np.allclose(M.window_weights(name, n), want)


@pytest.mark.parametrize(("kind", "order"), [("cubic", 3), ("quintic", 5)])
def test_splines(spark, kind, order):
    x = np.arange(30.0)
    y = sum((-1) ** i * (x / 20) ** i for i in range(order + 1))
    a = series(spark, [v if i % 3 and 2 < i < 27 or i == 7 else None for i, v in enumerate(y)], "U", 0)
    got = [r.x for r in I.interpolate(a, "x", kind).sort("t").collect()]
    assert got[:4] == [None] * 4 and got[27:] == [None] * 3 and np.allclose(got[4:27], y[4:27])
    long = np.where(np.arange(6000) % 4 == 1, np.sin(np.arange(6000) / 50), np.nan)
    assert np.nanmax(np.abs(I.spline(long, order)[1:5990] - np.sin(np.arange(1, 5990) / 50))) < 1e-4
    assert [r.x for r in I.interpolate(series(spark, [None, 2, None, 4, None], "U", 0), "x", kind).sort("t").collect()] == [None, 2, 3, 4, None]


def test_durbin_recursion_solves_yule_walker():
    r = np.array([1.0, 0.5, 0.3, 0.2, -0.1, 0.05])
    got = R.levinson(r)
    for k in range(1, 6):
        m = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert np.isclose(got[k], np.linalg.solve(m, r[1 : k + 1])[-1])


@pytest.mark.parametrize("block", [4, 4096])
def test_covariances_with_gaps_and_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(3)
    data = {int(t): (float(rng.integers(9)), None if rng.random() < 0.2 else float(rng.integers(9))) for t in rng.choice(60, 40, replace=False)}
    df = C.with_freq(spark.createDataFrame([(t, x, y) for t, (x, y) in data.items()], "t long, x double, y double"), "D")
    mx, my = np.mean([x for x, _ in data.values()]), np.mean([y for _, y in data.values() if y is not None])
    got = {r.lag: (r.n, r["cov"]) for r in R.cvf(df, "x", "y", 7).collect()}
    for k in range(-7, 8):
        pairs = [(data[t + k][0] - mx) * (data[t][1] - my) for t in data if t + k in data and data[t][1] is not None]
        assert got[k][0] == len(pairs) and np.isclose(got[k][1], sum(pairs) / (len(pairs) + abs(k)))


def test_shapes(spark):
    a = C.with_freq(spark.createDataFrame([(1, [1, 2, 3, 4])], "t long, x array<int>"), "D")
    assert C.reshape(a, "x", 2).first().x == [[1, 2], [3, 4]]
    assert rows(C.transpose(A.stack(series(spark, [1], t0=1), series(spark, [2], t0=1).withColumnRenamed("x", "y")))) == [(1, 1.0, "x"), (1, 2.0, "y")]


def test_guess_of_frequencies(spark):
    import datetime as dt

    def guess(days):
        return C.guess_freq(spark.createDataFrame([(dt.datetime(2001, 1, 1) + dt.timedelta(d),) for d in days], "ts timestamp_ntz")).first().freq

    assert guess([0, 90, 181, 273, 365]) == "Q" and guess([0, 181, 365]) == "M" and guess([0, 365]) == "A" and guess([0, 7, 21]) == "W-MON" and guess([0, 31, 59]) == "M" and guess([0, 0.5]) == "H"
