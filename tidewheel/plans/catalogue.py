"""Registered queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import period as P
from tidewheel.functions.delta import TimeDelta, add
from tidewheel.operators import align as A
from tidewheel.operators import core as C
from tidewheel.operators import corr as R
from tidewheel.operators import interp as I
from tidewheel.operators import moving as M
from tidewheel.operators import resample as S
from tidewheel.sources.tables import ROW, in_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
U = ("user_id",)


def _read(spark, d, table, *columns):
    return spark.read.parquet(f"{d}/{table}.parquet").select(*columns)


def orders_daily(spark, d):
    o = _read(spark, d, "orders", "o_orderdate", "o_totalprice")
    return C.with_freq(o.groupBy(P.to_period("o_orderdate", "D").alias("t")).agg(F.sum("o_totalprice").alias("x")), "D")


def ship_daily(spark, d):
    li = _read(spark, d, "lineitem", "l_shipdate", "l_quantity")
    return C.with_freq(li.groupBy(P.to_period("l_shipdate", "D").alias("t")).agg(F.sum("l_quantity").alias("y")), "D")


def orders_monthly(spark, d):
    o = _read(spark, d, "orders", "o_orderdate", "o_totalprice")
    return C.with_freq(o.groupBy(P.to_period("o_orderdate", "M").alias("t")).agg(F.sum("o_totalprice").alias("x")), "M")


def users_daily(spark, d):
    """Sparse: purchases of a user on a day."""
    e = _read(spark, d, "events", "user_id", "ts", "event_type", "value").where("event_type = 'purchase'")
    return C.with_freq(e.groupBy("user_id", P.to_period("ts", "D").alias("t")).agg(F.sum("value").alias("x")), "D")


def users_full(spark, d):
    return A.fill_missing_dates(users_daily(spark, d), U)


# where the last digit of a sum decides (ranks, whole numbers, thresholds), it is added up in the order of the table's
# rows, as the SQL does in one thread


def orders_in_rows(spark, d, freq="D"):
    o = in_rows(spark, f"{d}/orders.parquet", P.to_period("o_orderdate", freq).alias("t"), F.col("o_totalprice").alias("x"))
    return C.with_freq(C.dealt(o, ["t"], ROW).groupBy("t").agg(F.sum("x").alias("x")), freq)


def users_in_rows(spark, d):
    e = in_rows(spark, f"{d}/events.parquet", "user_id", P.to_period("ts", "D").alias("t"), F.col("value").alias("x"), "event_type").where("event_type = 'purchase'").drop("event_type")
    sums = C.dealt(e, ["user_id", "t"], ROW).groupBy("user_id", "t").agg(F.sum("x").alias("x"))
    return A.fill_missing_dates(C.with_freq(sums, "D"), U)


def rounded(df, n=4):
    """Doubles rounded and without a negative zero."""
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def day(c):
    return f"(date_diff('day', DATE '1970-01-01', ({c})::DATE) + 719163)::BIGINT"


def of_day(t):
    return f"(DATE '1970-01-01' + ({t} - 719163)::INTEGER)"


WITH = {
    "od": f"od AS (SELECT {day('o_orderdate')} AS t, sum(o_totalprice) AS x FROM orders GROUP BY 1)",
    "ld": f"ld AS (SELECT {day('l_shipdate')} AS t, sum(l_quantity) AS y FROM lineitem GROUP BY 1)",
    "om": "om AS (SELECT ((year(o_orderdate) - 1) * 12 + month(o_orderdate))::BIGINT AS t, sum(o_totalprice) AS x FROM orders GROUP BY 1)",
    "ud": f"ud AS (SELECT user_id, {day('ts')} AS t, sum(value) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)",
}
WITH["uf"] = WITH["ud"] + ", uf AS (SELECT s.user_id, s.t, ud.x FROM (SELECT user_id, unnest(range(min(t), max(t) + 1)) AS t FROM ud GROUP BY user_id) s LEFT JOIN ud ON ud.user_id = s.user_id AND ud.t = s.t)"
WITH["of"] = WITH["od"] + ", of AS (SELECT s.t, od.x FROM (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM od) s LEFT JOIN od ON od.t = s.t)"


def query(name: str, f, sql: str | None = None, *tables: str, digits: int = 4):
    QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
    if sql is not None:
        ORACLE_SQL[name] = (f"WITH {', '.join(WITH[t] for t in tables)} " if tables else "") + sql


def monthly_revenue_trend(spark, d):
    """Monthly revenue, gaps filled, with its moving average of three months."""
    return rounded(M.mov_mean(A.fill_missing_dates(orders_monthly(spark, d)), "x", 3, out="trend"))


query("monthly_revenue_trend", monthly_revenue_trend, "SELECT s.t, round(om.x, 4) AS x, round(CASE WHEN count(om.x) OVER w = 3 THEN avg(om.x) OVER w END, 4) AS trend FROM (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM om) s LEFT JOIN om ON om.t = s.t WINDOW w AS (ORDER BY s.t ROWS 2 PRECEDING)", "om")

# calendar: the SQL goes by DuckDB's own date functions
_D = "SELECT DISTINCT o_orderdate::DATE AS o FROM orders"
_BDAY = "(CASE WHEN isodow({0}) = 6 THEN {0} - 1 WHEN isodow({0}) = 7 THEN {0} - 2 ELSE {0} END)"
_B = lambda o: f"((({day(o)}) // 7) * 5 + ({day(o)}) % 7)::BIGINT"
for _name, _freq, _rel, _sql in (
    ("d2a", "A", "END", "year(o)"), ("d2q", "Q", "END", "(year(o) - 1) * 4 + quarter(o)"), ("d2m", "M", "END", "(year(o) - 1) * 12 + month(o)"), ("d2w_sun", "W-SUN", "END", f"({day('o + (7 - isodow(o))::INTEGER')}) // 7"),
    ("d2w_wed", "W-WED", "END", f"({day('o + ((10 - isodow(o)) % 7)::INTEGER')} - 3) // 7"), ("a_jun", "A-JUN", "END", "year(o + INTERVAL 6 MONTH)"), ("q_jan", "Q-E-JAN", "END", "(year(date_trunc('month', o) - INTERVAL 1 MONTH)) * 4 + quarter(date_trunc('month', o) - INTERVAL 1 MONTH)"),
    ("d2b_start", "B", "START", _B(_BDAY.format("o"))), ("d2b_end", "B", "END", _B("(CASE WHEN isodow(o) = 6 THEN o + 2 WHEN isodow(o) = 7 THEN o + 1 ELSE o END)")), ("d2h_start", "H", "START", "date_diff('hour', TIMESTAMP '1970-01-01', o::TIMESTAMP)"), ("d2s_end", "S", "END", "date_diff('second', TIMESTAMP '1970-01-01', o::TIMESTAMP) + 86399"),
):
    query(f"period_asfreq_{_name}", lambda s, d, f=_freq, r=_rel: _read(s, d, "orders", P.to_period("o_orderdate", "D").alias("t")).distinct().select("t", P.asfreq("t", "D", f, r).alias("p")), f"SELECT {day('o')} AS t, ({_sql})::BIGINT AS p FROM ({_D})")
query("period_asfreq_m2d", lambda s, d: orders_monthly(s, d).select("t", P.asfreq("t", "M", "D", "START").alias("first"), P.asfreq("t", "M", "D").alias("last"), P.asfreq("t", "M", "B").alias("last_b")), f"SELECT t, {day('m')} AS first, {day('last_day(m)')} AS last, {_B(_BDAY.format('last_day(m)'))} AS last_b FROM (SELECT t, make_date(((t - 1) // 12 + 1)::INTEGER, ((t - 1) % 12 + 1)::INTEGER, 1) AS m FROM om)", "om")
query("period_fields", lambda s, d: orders_daily(s, d).select("t", *[P.field("t", "D", n).alias(n) for n in ("year", "quarter", "month", "week", "day", "day_of_week", "day_of_year")], P.toordinal("t", "D").alias("ordinal")), f"SELECT t, year(o)::INT AS year, quarter(o)::INT AS quarter, month(o)::INT AS month, weekofyear(o)::INT AS week, day(o)::INT AS day, (isodow(o) - 1)::INT AS day_of_week, dayofyear(o)::INT AS day_of_year, t AS ordinal FROM (SELECT t, {of_day('t')} AS o FROM od)", "od")
query("period_hms", lambda s, d: _read(s, d, "events", P.to_period("ts", "S").alias("t")).select("t", *[P.field("t", "S", n).alias(n) for n in ("hour", "minute", "second")], P.asfreq("t", "S", "H").alias("h"), P.asfreq("t", "S", "D").alias("d")), f"SELECT date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS t, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS h, {day('ts')} AS d FROM events")
query("period_strftime", lambda s, d: orders_daily(s, d).select("t", P.strftime("t", "D", "%a %d %B %Y %j %U %W %w %y-%m").alias("text"), P.tostring("t", "D").alias("short"), P.tostring(P.asfreq("t", "D", "Q"), "Q").alias("q")), f"SELECT t, strftime(o, '%a %d %B %Y %j %U %W %w %y-%m') AS text, strftime(o, '%d-%b-%Y') AS short, year(o)::VARCHAR || 'Q' || quarter(o)::VARCHAR AS q FROM (SELECT t, {of_day('t')} AS o FROM od)", "od")
query("period_tofloat", lambda s, d: orders_daily(s, d).select("t", P.tofloat("t", "D", "A").alias("a"), P.tofloat("t", "D", "M").alias("m"), P.tofloat(P.asfreq("t", "D", "Q"), "Q", "A").alias("q")), f"SELECT t, round(year(o) + (dayofyear(o) - 1) / dayofyear(make_date(year(o), 12, 31)), 8) AS a, round((year(o) - 1) * 12 + month(o) + (day(o) - 1) / day(last_day(o)), 8) AS m, round(year(o) + (quarter(o) - 1) / 4, 8) AS q FROM (SELECT t, {of_day('t')} AS o FROM od)", "od", digits=8)
query("leapyear", lambda s, d: _read(s, d, "orders", F.year("o_orderdate").alias("year")).distinct().select("year", P.isleapyear("year").alias("leap")), "SELECT DISTINCT year(o_orderdate)::INT AS year, dayofyear(make_date(year(o_orderdate), 12, 31)) = 366 AS leap FROM orders")
query("period_break", lambda s, d: orders_daily(s, d).where(P.period_break("t", "D", "month")).select("t"), f"SELECT t FROM od WHERE day({of_day('t')}) = 1", "od")
query("prevbusday", lambda s, d: _read(s, d, "events", "event_id", "ts").select("event_id", P.prevbusday(at=F.col("ts")).alias("b")), f"SELECT event_id, {_B(_BDAY.format('ts::DATE'))} - CASE WHEN isodow(ts) < 6 AND hour(ts) < 18 THEN 1 ELSE 0 END AS b FROM events")
query("timedelta_add", lambda s, d: orders_daily(s, d).select("t", add("t", "D", TimeDelta(months=1, days=3)).alias("u"), add("t", "D", -TimeDelta.of("Q", 1)).alias("v")), f"SELECT t, {day('(o + INTERVAL 1 MONTH)::DATE + 3')} AS u, {day('o - INTERVAL 3 MONTH')} AS v FROM (SELECT t, {of_day('t')} AS o FROM od)", "od")
query("guess_freq", lambda s, d: C.guess_freq(_read(s, d, "orders", F.col("o_orderdate").cast("date").alias("ts")).distinct()), "SELECT CASE WHEN bool_or(isodow(o) > 5) THEN 'D' ELSE 'B' END AS freq FROM (SELECT DISTINCT o_orderdate::DATE AS o FROM orders)")
query("string_to_period", lambda s, d: orders_daily(s, d).select("t", P.string_to_period(P.strftime("t", "D", "%d-%b-%Y"), "M").alias("m"), P.string_to_period(P.strftime("t", "D", "%Y-%m"), "Q").alias("q")), f"SELECT t, ((year(o) - 1) * 12 + month(o))::BIGINT AS m, ((year(o) - 1) * 4 + quarter(o))::BIGINT AS q FROM (SELECT t, {of_day('t')} AS o FROM od)", "od")

# element access
query("slice_by_date", lambda s, d: C.between(orders_daily(s, d), 728659, 729000), "SELECT t, round(x, 4) AS x FROM od WHERE t >= 728659 AND t < 729000", "od")
query("slice_pruned", lambda s, d: _read(s, d, "orders", "o_orderkey", "o_orderdate").where(P.in_periods("o_orderdate", "Q", 7985, 7986)).select("o_orderkey", P.to_period("o_orderdate", "Q").alias("t")), "SELECT o_orderkey, ((year(o_orderdate) - 1) * 4 + quarter(o_orderdate))::BIGINT AS t FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01'")
query("slice_positional", lambda s, d: C.positions(orders_daily(s, d), 10, 200, 3), "SELECT t, round(x, 4) AS x FROM (SELECT *, row_number() OVER (ORDER BY t) - 1 AS pos FROM od) WHERE pos >= 10 AND pos < 200 AND (pos - 10) % 3 = 0", "od")
query("find_dates", lambda s, d: C.find_dates(orders_daily(s, d), [728659, 728700, 1]), "SELECT t, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (ORDER BY t) - 1 AS pos FROM od) WHERE t IN (728659, 728700, 1)", "od")
query("mask_by_condition", lambda s, d: C.assign(orders_in_rows(s, d), F.col("x") > 1e6, None, "x"), "SELECT t, round(CASE WHEN x > 1e6 THEN NULL ELSE x END, 4) AS x FROM od", "od")
query("compressed", lambda s, d: C.compressed(users_full(s, d), U), "SELECT user_id, t, round(x, 4) AS x FROM ud", "ud")
query("filled", lambda s, d: C.filled(users_full(s, d), -1.0, U), "SELECT user_id, t, round(coalesce(x, -1), 4) AS x FROM uf", "uf")
query("first_last_valid", lambda s, d: C.first_last_valid(users_full(s, d), "x", U), "SELECT user_id, round(arg_min(x, t), 4) AS first_valid, round(arg_max(x, t), 4) AS last_valid FROM ud GROUP BY 1", "ud")
query("validity_flags", lambda s, d: C.validity(users_daily(s, d), U), "SELECT user_id, coalesce(min(g) = 0, FALSE) AS has_duplicates, NOT coalesce(max(g) = 1, TRUE) AS has_missing, coalesce(max(g) = 1, TRUE) AS is_full, coalesce(max(g) = 1, TRUE) AND NOT coalesce(min(g) = 0, FALSE) AS is_valid FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM ud) GROUP BY 1", "ud")
query("get_steps", lambda s, d: C.steps(users_daily(s, d), U), "SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM ud", "ud")
query("start_end_dates", lambda s, d: C.span_of(users_daily(s, d), U), "SELECT user_id, min(t) AS start_date, max(t) AS end_date FROM ud GROUP BY 1", "ud")
query("is_chronological", lambda s, d: C.is_chronological(_read(s, d, "orders", "o_orderkey", P.to_period("o_orderdate", "D").alias("t")), "o_orderkey"), f"SELECT count(*) FILTER (t < p) = 0 AS is_chronological FROM (SELECT t, lag(t) OVER (ORDER BY o_orderkey) AS p FROM (SELECT o_orderkey, {day('o_orderdate')} AS t FROM orders))")
query("asfreq_series", lambda s, d: C.as_freq(users_daily(s, d), "M"), f"SELECT user_id, ((year({of_day('t')}) - 1) * 12 + month({of_day('t')}))::BIGINT AS t, round(x, 4) AS x FROM ud", "ud")

# alignment and sets
query("fill_missing_days", lambda s, d: users_full(s, d), "SELECT user_id, t, round(x, 4) AS x FROM uf", "uf")
query("missing_dates", lambda s, d: A.missing_dates(users_daily(s, d), U), "SELECT user_id, t FROM uf WHERE x IS NULL", "uf")
query("align_two_series", lambda s, d: A.align_series(orders_daily(s, d), ship_daily(s, d)), "SELECT s.t, round(x, 4) AS x, round(y, 4) AS y FROM (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM (SELECT t FROM od UNION ALL SELECT t FROM ld)) s LEFT JOIN od ON od.t = s.t LEFT JOIN ld ON ld.t = s.t", "od", "ld")
query("align_with", lambda s, d: A.align_with(orders_daily(s, d), ship_daily(s, d)), "SELECT of.t, round(x, 4) AS x, round(y, 4) AS y FROM of LEFT JOIN ld ON ld.t = of.t", "of", "ld")
query("adjust_endpoints", lambda s, d: A.adjust_endpoints(orders_daily(s, d), 728000, 729000), "SELECT s.t, round(x, 4) AS x FROM (SELECT unnest(range(728000::BIGINT, 729001::BIGINT)) AS t) s LEFT JOIN od ON od.t = s.t", "od")
query("series_add", lambda s, d: A.binary(orders_daily(s, d), ship_daily(s, d), lambda a, b: a + b, "x", "y", "z"), "SELECT t, round(x + y, 4) AS z FROM od JOIN ld USING (t)", "od", "ld")
query("stack", lambda s, d: A.stack(orders_daily(s, d), ship_daily(s, d), check=False), "SELECT t, round(x, 4) AS x, round(y, 4) AS y FROM od JOIN ld USING (t)", "od", "ld")
query("concat_dedupe", lambda s, d: A.concatenate([C.between(orders_daily(s, d), None, 729000), ship_daily(s, d).withColumnRenamed("y", "x")]), "SELECT t, round(coalesce(CASE WHEN od.t < 729000 THEN od.x END, y), 4) AS x FROM od FULL JOIN ld USING (t) WHERE t < 729000 AND od.x IS NOT NULL OR y IS NOT NULL", "od", "ld")
_RAW = lambda s, d: C.with_freq(_read(s, d, "orders", P.to_period("o_orderdate", "D").alias("t"), "o_orderkey"), "D")
_RAW_SQL = f"r AS (SELECT {day('o_orderdate')} AS t, o_orderkey FROM orders)"
WITH["r"] = _RAW_SQL
query("find_dups", lambda s, d: A.find_duplicated_dates(_RAW(s, d), "o_orderkey").select("t", "n", F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last")), "SELECT t, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM r GROUP BY t HAVING count(*) > 1", "r")
query("remove_dups", lambda s, d: A.remove_duplicated_dates(_RAW(s, d), "o_orderkey"), "SELECT t, min(o_orderkey) AS o_orderkey FROM r GROUP BY t", "r")

# shifts
_LAG = "lag(x, {n}) OVER (PARTITION BY user_id ORDER BY t)"
query("tshift_neg", lambda s, d: A.tshift(users_full(s, d), -2, U), f"SELECT user_id, t, round({_LAG.format(n=2)}, 4) AS x FROM uf", "uf")
query("tshift_pos", lambda s, d: A.tshift(users_full(s, d), 1, U), "SELECT user_id, t, round(lead(x) OVER (PARTITION BY user_id ORDER BY t), 4) AS x FROM uf", "uf")
query("pct", lambda s, d: A.pct(users_full(s, d), 1, U), f"SELECT user_id, t, round(x / nullif({_LAG.format(n=1)}, 0) - 1, 4) AS x FROM uf", "uf")
query("pct_log", lambda s, d: A.pct_log(users_full(s, d), 1, U), f"SELECT user_id, t, round(CASE WHEN x / nullif({_LAG.format(n=1)}, 0) > 0 THEN ln(x / nullif({_LAG.format(n=1)}, 0)) END, 4) AS x FROM uf", "uf")
query("pct_symmetric", lambda s, d: A.pct_symmetric(users_full(s, d), 2, U), f"SELECT user_id, t, round(2 * (x - {_LAG.format(n=2)}) / nullif(x + {_LAG.format(n=2)}, 0), 4) AS x FROM uf", "uf")

# statistics
query("series_stats", lambda s, d: A.stats(users_in_rows(s, d), "x", U, ordered=True).drop("prod"), "SELECT user_id, round(sum(x), 6) AS sum, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var, round(stddev_pop(x), 6) AS std, count(x) AS count, round(min(x), 6) AS min, round(max(x), 6) AS max, round(max(x) - min(x), 6) AS ptp, arg_min(t, x) AS argmin, arg_max(t, x) AS argmax FROM uf GROUP BY 1", "uf", digits=6)
query("cumsum", lambda s, d: A.cumsum(users_full(s, d), "x", U), "SELECT user_id, t, round(CASE WHEN x IS NOT NULL THEN sum(x) OVER (PARTITION BY user_id ORDER BY t) END, 4) AS x FROM uf", "uf")
query("cumprod", lambda s, d: A.cumprod(users_full(s, d).withColumn("x", 1 + F.col("x") / 1e6), "x", U), "SELECT user_id, t, round(CASE WHEN x IS NOT NULL THEN product(1 + x / 1e6) OVER (PARTITION BY user_id ORDER BY t) END, 4) AS x FROM uf", "uf")
query("anom", lambda s, d: A.anom(users_full(s, d), "x", U), "SELECT user_id, t, round(x - avg(x) OVER (PARTITION BY user_id), 7) + 0.0 AS x FROM uf", "uf", digits=7)
query("across", lambda s, d: A.across(A.align_series(orders_daily(s, d), ship_daily(s, d)), ["x", "y"], "sum", "total").select("t", "total"), "SELECT s.t, round(CASE WHEN x IS NOT NULL OR y IS NOT NULL THEN coalesce(x, 0) + coalesce(y, 0) END, 4) AS total FROM (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM (SELECT t FROM od UNION ALL SELECT t FROM ld)) s LEFT JOIN od ON od.t = s.t LEFT JOIN ld ON ld.t = s.t", "od", "ld")
query("argsort", lambda s, d: A.ranked(users_in_rows(s, d), "x", U).select("user_id", "t", "rank"), "SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY x NULLS LAST, t) - 1 AS rank FROM uf", "uf")

# resampling
_M = f"((year({of_day('t')}) - 1) * 12 + month({of_day('t')}))::BIGINT"
_Q = f"((year({of_day('t')}) - 1) * 4 + quarter({of_day('t')}))::BIGINT"


def _spine(p: str, agg: str) -> str:
    return f", g AS (SELECT user_id, {p} AS t, {agg} AS x FROM uf GROUP BY 1, 2) SELECT s.user_id, s.t, round(g.x, 7) AS x FROM (SELECT user_id, unnest(range(min(t), max(t) + 1)) AS t FROM g GROUP BY 1) s LEFT JOIN g ON g.user_id = s.user_id AND g.t = s.t"


for _f, _agg in (("mean", "avg(x)"), ("sum", "sum(x)"), ("last", "arg_max(x, t) FILTER (x IS NOT NULL)"), ("std", "stddev_pop(x)"), ("median", "median(x)")):
    QUERIES[f"convert_d2m_{_f}"] = lambda s, d, f=_f: rounded(S.convert(users_full(s, d), "M", f, keys=U), 7)
    ORACLE_SQL[f"convert_d2m_{_f}"] = f"WITH {WITH['uf']}" + _spine(_M, _agg)
QUERIES["convert_d2q"] = lambda s, d: rounded(S.convert(users_full(s, d), "Q", "sum", keys=U), 7)
ORACLE_SQL["convert_d2q"] = f"WITH {WITH['uf']}" + _spine(_Q, "sum(x)")
QUERIES["convert_d2w"] = lambda s, d: rounded(S.convert(users_full(s, d), "W-SUN", "max", keys=U), 7)
ORACLE_SQL["convert_d2w"] = f"WITH {WITH['uf']}" + _spine("((t + 6) // 7)::BIGINT", "max(x)")
query("convert_h2d", lambda s, d: S.convert(C.with_freq(_read(s, d, "events", P.to_period("ts", "H").alias("t"), "value"), "H"), "D", "mean", duplicates="fold"), f"SELECT {day('ts')} AS t, round(avg(value), 4) AS value FROM events GROUP BY 1")
for _pos, _rule in (("START", "date_trunc('month', o)"), ("END", "last_day(o)")):
    query(f"convert_m2d_{_pos.lower()}", lambda s, d, p=_pos: S.convert(orders_monthly(s, d), "D", position=p), f", m AS (SELECT make_date(((t - 1) // 12 + 1)::INTEGER, ((t - 1) % 12 + 1)::INTEGER, 1) AS o, x FROM om) SELECT s.t, round(m.x, 4) AS x FROM (SELECT unnest(range(min({day('o')}), max({day('last_day(o)')}) + 1)) AS t FROM m) s LEFT JOIN m ON {day(_rule)} = s.t", "om")
_CELL = f"t - {day(f'date_trunc({chr(39)}month{chr(39)}, {of_day(chr(116))})')}"
query("convert_array_d2m", lambda s, d: S.convert(orders_daily(s, d), "M").select("t", F.posexplode("x").alias("cell", "x")), f", a AS (SELECT {_M} AS t, {_CELL} AS cell, x FROM od) SELECT s.t, c.cell::INT AS cell, round(a.x, 4) AS x FROM (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM a) s CROSS JOIN (SELECT unnest(range(31)) AS cell) c LEFT JOIN a ON a.t = s.t AND a.cell = c.cell", "od")
query("convert_to_annual", lambda s, d: S.convert_to_annual(orders_daily(s, d), "x").select("t", F.posexplode("x").alias("cell", "x")), f", a AS (SELECT year({of_day('t')}) AS y, dayofyear({of_day('t')}) - 1 + CASE WHEN dayofyear({of_day('t')}) > 59 AND dayofyear(make_date(year({of_day('t')}), 12, 31)) = 365 THEN 1 ELSE 0 END AS cell, x FROM od) SELECT s.y::BIGINT AS t, c.cell::INT AS cell, round(a.x, 4) AS x FROM (SELECT DISTINCT y FROM a) s CROSS JOIN (SELECT unnest(range(366)) AS cell) c LEFT JOIN a ON a.y = s.y AND a.cell = c.cell", "od")
query("convert_records", lambda s, d: S.convert(A.align_series(orders_daily(s, d), ship_daily(s, d)), "M", "sum"), f", b AS (SELECT t, x, NULL::DOUBLE AS y FROM od UNION ALL SELECT t, NULL, y FROM ld) SELECT {_M} AS t, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM b GROUP BY 1", "od", "ld")
query("change_timestep", lambda s, d: S.change_timestep(A.fill_missing_dates(orders_daily(s, d)), 7, "sum"), "SELECT t0 + ((t - t0) // 7) * 7 AS t, round(sum(x), 4) AS x FROM of, (SELECT min(t) AS t0 FROM of) GROUP BY 1", "of")
query("count_missing", lambda s, d: S.count_missing(orders_daily(s, d), "M", "x"), f"SELECT {_M} AS t, any_value(day(last_day({of_day('t')}))) - count(x) AS missing FROM od GROUP BY 1", "od")
query("accept_atmost_missing", lambda s, d: S.accept_atmost_missing(users_full(s, d), "M", "x", 25, "mean", keys=U), f"SELECT user_id, {_M} AS t, round(CASE WHEN any_value(day(last_day({of_day('t')}))) - count(x) < 25 THEN avg(x) END, 7) AS x FROM uf GROUP BY 1, 2", "uf", digits=7)

# moving windows, over users with gaps and over one long series in blocks
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS 2 PRECEDING)"
for _f, _agg in (("sum", "sum(x)"), ("mean", "avg(x)"), ("min", "min(x)"), ("max", "max(x)"), ("median", "median(x)"), ("var", "var_pop(x)"), ("std", "stddev_pop(x)")):
    query(f"mov_{_f}", lambda s, d, f=_f: getattr(M, f"mov_{f}")(users_full(s, d), "x", 3, keys=U), f"SELECT user_id, t, round(CASE WHEN count(x) OVER w = 3 THEN {_agg} OVER w END, 7) AS x FROM uf {_W}", "uf", digits=7)
query("mov_mean_blocked", lambda s, d: M.mov_mean(A.fill_missing_dates(orders_daily(s, d)), "x", 7, block=90), "SELECT t, round(CASE WHEN count(x) OVER w = 7 THEN avg(x) OVER w END, 4) AS x FROM of WINDOW w AS (ORDER BY t ROWS 6 PRECEDING)", "of")
_PAIR = ", p AS (SELECT t, x, y FROM od JOIN ld USING (t))"
_pair = lambda s, d: C.with_freq(A.stack(orders_daily(s, d), ship_daily(s, d), check=False), "D")
query("mov_cov", lambda s, d: M.mov_cov(_pair(s, d), "x", "y", 5).select("t", (F.col("cov") / 1e6).alias("cov")), f"{_PAIR} SELECT t, round(CASE WHEN count(*) OVER w = 5 THEN covar_samp(x, y) OVER w / 1e6 END, 4) + 0.0 AS cov FROM p WINDOW w AS (ORDER BY t ROWS 4 PRECEDING)", "od", "ld", digits=4)
query("mov_corr", lambda s, d: M.mov_corr(_pair(s, d), "x", "y", 5).select("t", "corr"), f"{_PAIR} SELECT t, round(CASE WHEN count(*) OVER w = 5 THEN covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) END, 6) + 0.0 AS corr FROM p WINDOW w AS (ORDER BY t ROWS 4 PRECEDING)", "od", "ld", digits=6)
query("mov_ewma", lambda s, d: M.mov_average_expw(users_full(s, d), "x", 4, tol=0.6, keys=U), ", recursive_n AS (SELECT user_id, t, x, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM uf) SELECT a.user_id, a.t, round(CASE WHEN 1 - a.e <= 0.6 THEN a.y END, 7) AS x FROM (WITH RECURSIVE e AS (SELECT user_id, n, t, x AS y, CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS e FROM recursive_n WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.t, CASE WHEN r.x IS NULL THEN e.y ELSE coalesce(e.y + 0.4 * (r.x - e.y), r.x) END, e.e + 0.4 * (CASE WHEN r.x IS NULL THEN 0 ELSE 1 END - e.e) FROM e JOIN recursive_n r ON r.user_id = e.user_id AND r.n = e.n + 1) SELECT * FROM e) a", "uf", digits=7)
query("cmov_mean", lambda s, d: M.cmov_mean(users_full(s, d), "x", 3, keys=U), "SELECT user_id, t, round(CASE WHEN count(x) OVER w = 3 THEN avg(x) OVER w END, 7) AS x FROM uf WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "uf", digits=7)
for _k in ("hamming", "triang"):
    _ws = [float(v) for v in M.window_weights(_k, 5)]
    _terms = " + ".join(f"{w!r} * {'lag' if i < 2 else 'lead'}(x, {abs(i - 2)}) OVER (ORDER BY t)" for i, w in enumerate(_ws))
    query(f"cmov_window_{_k}", lambda s, d, k=_k: M.cmov_window(A.fill_missing_dates(orders_daily(s, d)), "x", 5, k), f"SELECT t, round(({_terms}) / 5, 3) AS x FROM of", "of", digits=3)

# filling
_FF = "last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)"
query("ffill", lambda s, d: I.forward_fill(users_full(s, d), "x", keys=U), f"SELECT user_id, t, round({_FF}, 4) AS x FROM uf", "uf")
query("bfill", lambda s, d: I.backward_fill(users_full(s, d), "x", keys=U), "SELECT user_id, t, round(first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS x FROM uf", "uf")
query("ffill_maxgap", lambda s, d: I.forward_fill(users_full(s, d), "x", 2, keys=U), f", i AS (SELECT *, {_FF} AS v, count(x) OVER (PARTITION BY user_id ORDER BY t) AS g FROM uf) SELECT user_id, t, round(CASE WHEN x IS NOT NULL OR count(*) FILTER (x IS NULL) OVER (PARTITION BY user_id, g) <= 2 THEN v END, 4) AS x FROM i", "uf")
query("interp_linear", lambda s, d: I.interpolate(users_full(s, d), "x", keys=U), ", i AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS a, min(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM uf) SELECT i.user_id, i.t, round(coalesce(i.x, p.x + (n.x - p.x) * (i.t - i.a) / (i.b - i.a)), 7) AS x FROM i LEFT JOIN uf p ON p.user_id = i.user_id AND p.t = i.a LEFT JOIN uf n ON n.user_id = i.user_id AND n.t = i.b", "uf", digits=7)

# correlations
_DEV = ", a AS (SELECT t, x - (SELECT avg(x) FROM om) AS x FROM om)"
_AVF = f"{_DEV}, c AS (SELECT l.lag, sum(p.x * q.x) / (count(*) + l.lag) AS cov, count(*) AS n FROM (SELECT unnest(range(13)) AS lag) l JOIN a p ON TRUE JOIN a q ON p.t = q.t + l.lag GROUP BY l.lag)"
query("avf", lambda s, d: R.avf(orders_monthly(s, d), "x", 12), f"{_AVF} SELECT lag::BIGINT AS lag, round(cov, 0) + 0.0 AS cov, n FROM c", "om", digits=0)
query("acf", lambda s, d: R.acf(orders_monthly(s, d), "x", 12), f"{_AVF} SELECT lag::BIGINT AS lag, round(cov / (SELECT cov FROM c WHERE lag = 0), 6) + 0.0 AS acf FROM c", "om", digits=6)
query("acf_std", lambda s, d: R.acf_std(orders_monthly(s, d), "x", 12, confidence=0.9544997), f"{_AVF}, k AS (SELECT lag, cov / (SELECT cov FROM c WHERE lag = 0) AS r FROM c) SELECT lag::BIGINT AS lag, round(CASE WHEN lag = 0 THEN 0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r END) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (SELECT count(*) FROM om)) * 1.9999999725 END, 4) AS std FROM k", "om")
_CVF = ", p AS (SELECT t, x, y FROM od JOIN ld USING (t)), a AS (SELECT t, x - (SELECT avg(x) FROM p) AS x, y - (SELECT avg(y) FROM p) AS y FROM p), c AS (SELECT l.lag, sum(p.x * q.y) / (count(*) + abs(l.lag)) AS cov, count(*) AS n FROM (SELECT unnest(range(-5, 6)) AS lag) l JOIN a p ON TRUE JOIN a q ON p.t = q.t + l.lag GROUP BY l.lag)"
query("cvf", lambda s, d: R.cvf(_pair(s, d), "x", "y", 5), f"{_CVF} SELECT lag::BIGINT AS lag, round(cov, 1) + 0.0 AS cov, n FROM c", "od", "ld", digits=1)
query("ccf", lambda s, d: R.ccf(_pair(s, d), "x", "y", 5), f"{_CVF} SELECT lag::BIGINT AS lag, round(cov / (SELECT cov FROM c WHERE lag = 0), 5) + 0.0 AS ccf FROM c", "od", "ld", digits=5)

# tables, reports, ticks, streams
from tidewheel.sources.report import report  # noqa: E402
from tidewheel.sources.tables import tabulate  # noqa: E402
from tidewheel.streaming.windows import convert_stream, sliding  # noqa: E402

query("torecords", lambda s, d: tabulate(users_full(s, d), 0.0, U), "SELECT user_id, t AS _dates, round(coalesce(x, 0), 4) AS _data, x IS NULL AS _mask FROM uf", "uf")
query("report", lambda s, d: report(orders_in_rows(s, d, "M"), header=["month", "total"], width=12, fmt=lambda c: F.round(c, 0).cast("long").cast("string"), footer=F.max, footer_label="max", row_char="."), f", l AS (SELECT t, rpad(strftime(make_date(((t - 1) // 12 + 1)::INTEGER, ((t - 1) % 12 + 1)::INTEGER, 1), '%b-%Y'), 12, ' ') || ' | ' || lpad(round(x)::BIGINT::VARCHAR, 12, ' ') AS line FROM om) SELECT 0::INT AS section, NULL::BIGINT AS pos, 0::INT AS part, 'month        | total       ' AS line UNION ALL SELECT 1, NULL, 0, repeat('-', 27) UNION ALL SELECT 2, t, 0, line FROM l UNION ALL SELECT 2, t, 1, repeat('.', 27) FROM l WHERE t < (SELECT max(t) FROM l) UNION ALL SELECT 3, NULL, 0, repeat('-', 27) UNION ALL SELECT 4, NULL, 0, 'max          | ' || lpad((SELECT round(max(x))::BIGINT::VARCHAR FROM om), 12, ' ')", "om")
query("convert_stream", lambda s, d: convert_stream(_read(s, d, "events", "user_id", "ts", "value"), "ts", "value", "D", "sum", keys=U), f"SELECT user_id, {day('ts')} AS t, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
query("sliding", lambda s, d: sliding(_read(s, d, "events", "ts", "value"), "ts", "value", "2 hours", "1 hour").select(F.unix_timestamp("start").alias("start"), "count"), "SELECT epoch(h)::BIGINT AS start, count(*) AS count FROM (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS h FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1")

from . import elements  # noqa: E402, F401  registers more
