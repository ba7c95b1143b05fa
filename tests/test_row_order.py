"""Sums whose last digit decides are those of the SQL run by one thread, over whatever files and tasks the rows lie."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.compare import same
from tidewheel.operators import align as A
from tidewheel.plans import catalogue
from tidewheel.sources.tables import ROW, in_rows


def table(d, name, rows, columns, files=4):
    """A table in files of very different sizes, so that tasks don't take them in order."""
    at = d / f"{name}.parquet"
    at.mkdir(parents=True)
    n = len(rows)
    cuts = [0, *[n * i * i // (files * files) for i in range(1, files + 1)]]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        pq.write_table(pa.table({c: pa.array([r[j] for r in rows[a:b]], t) for j, (c, t) in enumerate(columns.items())}), at / f"part {i}%.parquet")


def one_thread(d, *tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=1")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return con


def check(spark, d, name, *tables):
    same(catalogue.QUERIES[name](spark, str(d)), one_thread(d, *tables), catalogue.ORACLE_SQL[name])


EVENTS = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64()}


@pytest.fixture(scope="module")
def tenths(tmp_path_factory):
    """Days of a user whose sums are equal as decimals: 0.1 added ten times is less than 1.0, 0.5 + 0.5 is not; on other
    days 49.9 and ten times 0.01."""
    d = tmp_path_factory.mktemp("tenths")
    rows = []
    for i in range(10):
        for u in range(40):
            rows += [(dt.datetime(2024, 1, 2 + u % 3), u, v) for v in (0.1, 0.1 * (1 + u % 4))]
    rows += [(dt.datetime(2024, 1, 1 + k), u, v) for u in range(40) for k, v in ((0, 1.0), (6, 2.0), (7, 3.0), (8, 4.0), (9, 5.0))]
    rows += [(dt.datetime(2024, 1, 20 + k), u, 50.0 / n) for n, k in ((3, 0), (7, 1), (10, 2)) for i in range(n) for u in range(40)]
    table(d, "events", [(i, t, u, "purchase", v) for i, (t, u, v) in enumerate(rows)], EVENTS)
    return d


@pytest.mark.parametrize("name", ["argsort", "all_any"])
def test_sums_of_users(spark, tenths, name):
    check(spark, tenths, name, "events")


def ties(n):
    """Series of 16 days whose variances lie, as decimals, midway between two of six digits."""
    rng, out = np.random.default_rng(1), []
    while len(out) < n:
        cents = [int(c) for c in rng.integers(1, 30000, 16)]
        if (16 * sum(c * c for c in cents) - sum(cents) ** 2) % 64 == 32:
            out.append([c / 100 for c in cents])
    return out


def welford(xs):
    m = q = 0.0
    for n, x in enumerate(xs, 1):
        m, old = m + (x - m) / n, m
        q += (x - m) * (x - old)
    return q / len(xs)


def test_variances_of_users(spark, tmp_path):
    series = ties(100)
    rows = [(dt.datetime(2024, 1, 1 + k), u, x) for u, xs in enumerate(series) for k, x in enumerate(xs)]
    rows = sorted(rows, key=lambda r: (r[0].day * 7 % 17, r[1]))
    table(tmp_path, "events", [(i, t, u, "purchase", x) for i, (t, u, x) in enumerate(rows)], EVENTS)
    got = {r.user_id: r["var"] for r in catalogue.QUERIES["series_stats"](spark, str(tmp_path)).collect()}
    half_up = lambda v: float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    assert got == {u: half_up(welford(xs)) for u, xs in enumerate(series)}


def test_statistics_in_date_order(spark):
    rows = [(None, t, x) for t, x in enumerate(ties(1)[0])] + [(1, 5, None), (2, 3, 0.5), (2, 9, None), (2, 4, 1.5)]
    df = spark.createDataFrame(rows, "k int, t long, x double").repartition(5)
    want, got = ({r.k: r for r in A.stats(df, "x", ("k",), ordered).collect()} for ordered in (False, True))
    assert want.keys() == got.keys() == {None, 1, 2}
    for k, r in got.items():
        assert [v if v is None else pytest.approx(v) for v in want[k]] == list(r)
    assert A.stats(df.where("k = 1"), "x", (), True).drop("count").first() == (None,) * 10


def test_sums_of_orders(spark, tmp_path):
    """Days of 0.1 added ten or more times, in amounts whose whole part depends on the order."""
    days = [dt.datetime(1997, 1, 1) + dt.timedelta(i) for i in range(200)]
    rows = [(t, 0.1 * (1 + j % 3) + 0.7 * (k % 5)) for k in range(10) for j, t in enumerate(days)]
    rows += [(t, 1e5 - 1 + 0.01 * (k + 1)) for k in range(20) for t in days[::9]]
    table(tmp_path, "orders", [(i, t, x) for i, (t, x) in enumerate(rows)], {"o_orderkey": pa.int64(), "o_orderdate": pa.timestamp("us"), "o_totalprice": pa.float64()})
    at = in_rows(spark, f"{tmp_path}/orders.parquet", "o_orderkey").sort(*ROW).collect()
    assert [r.o_orderkey for r in at] == [*range(len(rows))] and {r["__file"] for r in at} == {0, 1, 2, 3}
    for name in ("unary", "clip_round", "mask_by_condition", "field_access", "report"):
        check(spark, tmp_path, name, "orders")
