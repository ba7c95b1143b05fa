"""Registered queries of sources, dates and their parts, element access, shapes, windows, splines and ticks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from tidewheel.functions import freq as Q
from tidewheel.functions import period as P
from tidewheel.operators import align as A
from tidewheel.operators import core as C
from tidewheel.operators import corr as R
from tidewheel.operators import interp as I
from tidewheel.operators import moving as M
from tidewheel.operators import resample as S
from tidewheel.sources import tables, text

from .catalogue import _AVF, U, _read, day, of_day, orders_daily, orders_in_rows, orders_monthly, query, users_full, users_in_rows
from .ticks import ticks


def scratch(spark) -> str:
    """A folder for files of one query: in spark.checkpoint.dir, or where that is unset (local runs) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    return f"{at.rstrip('/')}/scratch-{uuid.uuid4().hex}"


# sources


def text_round_trip(spark, d):
    at = scratch(spark)
    text.to_text(C.filled(orders_daily(spark, d), 0.0).withColumn("x", F.round("x", 2)), at, ",", compression="gzip")
    return text.from_text(spark, at, "D", ",", names=["dates", "x"])


query("text_round_trip", text_round_trip, "SELECT t, round(x, 2) AS x FROM od", "od", digits=2)


def text_columns(spark, d):
    """Names from the first line, columns by name and by number from the end, missing strings, a type ladder."""
    at = scratch(spark)
    o = _read(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    cell = F.when(F.col("o_orderkey") % 5 == 0, F.lit("none")).otherwise(F.round("o_totalprice", 2).cast("string"))
    body = o.select(F.concat_ws(";", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey", cell, F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" # note"))).alias("value"))
    spark.range(1).select(F.lit("Order Date;key;price;state").alias("value")).union(body.coalesce(1)).coalesce(1).write.text(at)  # one file, the names first
    return text.from_text(spark, at, "M", ";", skip_header=0, names=True, datecols=["Order_Date"], missing_values=["none"], usecols=["key", "price", -1])


query("text_columns", text_columns, "SELECT ((year(o_orderdate) - 1) * 12 + month(o_orderdate))::BIGINT AS t, o_orderkey AS key, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS price, o_orderstatus AS state FROM orders", digits=2)
_LINES = lambda s, d: _read(s, d, "orders", "o_orderkey", F.concat(F.lit(" "), F.lpad("o_orderkey", 9, "0"), F.rpad("o_orderstatus", 4, " "), F.lit("-"), F.col("o_orderkey") % 7, F.lit("# rest")).alias("line"))
query("text_fixed_width", lambda s, d: _LINES(s, d).select("o_orderkey", text.split_line(F.col("line"), (10, 4, 2)).alias("c")).select("o_orderkey", text.typed(F.get("c", 0), "bigint").alias("a"), F.get("c", 1).alias("b"), text.typed(F.get("c", 2), "bigint", filling=9).alias("e")), "SELECT o_orderkey, o_orderkey AS a, o_orderstatus AS b, -(o_orderkey % 7) AS e FROM orders")
query("text_types", lambda s, d: _LINES(s, d).select("o_orderkey", *[text.typed(F.concat(F.lit(p), (F.col("o_orderkey") % 3).cast("string")), k, ("x2",), f).alias(n) for n, p, k, f in (("a", "x", "string", None), ("b", "", "boolean", None), ("c", "1.5e", "double", None), ("e", "n", "bigint", -1))]), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN 'x' || (o_orderkey % 3) END AS a, CASE o_orderkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS b, 1.5 * power(10, o_orderkey % 3) AS c, -1::BIGINT AS e FROM orders")
query("text_names", lambda s, d: s.createDataFrame(list(enumerate(text.valid_names(["a b", " x!y", "", "print", "a_b", "q"], ["q"], case="lower"))), "i int, name string"), "SELECT unnest([0, 1, 2, 3, 4, 5])::INT AS i, unnest(['a_b', 'xy', 'f2', 'print_', 'a_b_1', 'q_']) AS name")


def table_round_trip(spark, d):
    at = scratch(spark)
    whole = orders_daily(spark, d)
    tables.create_table(C.between(whole, None, 729000), at)
    tables.append(C.between(whole, 729000), at)
    return tables.read_table(spark, at, 5, 400, 3, "x")


query("table_round_trip", table_round_trip, "SELECT t, round(x, 4) AS x FROM (SELECT *, row_number() OVER (ORDER BY t) - 1 AS pos FROM od) WHERE pos >= 5 AND pos < 400 AND (pos - 5) % 3 = 0", "od")


def table_coordinates(spark, d):
    at = scratch(spark)
    tables.create_table(orders_daily(spark, d), at)
    return tables.read_coordinates(spark, at, [3, 1, 500])


query("table_coordinates", table_coordinates, "SELECT t, round(x, 4) AS x FROM (SELECT *, row_number() OVER (ORDER BY t) - 1 AS pos FROM od) WHERE pos IN (1, 3, 500)", "od")


def table_mask(spark, d):
    at = scratch(spark)
    tables.create_table(users_full(spark, d), at)
    return tables.read_table(spark, at, field="_mask", keys=U)


query("table_mask", table_mask, "SELECT user_id, t, x IS NULL AS x FROM uf", "uf")

# frequencies and dates
_ALIASES = {"A": 1000, "annually": 1000, "Y-JUN": 1006, "A-OCTOBER": 1010, "Q": 2000, "qtr-e-mar": 2003, "QUARTERLY-S-DEC": 2012, "Q-S-JAN": 2013, "month": 3000, "W": 4000, "week-tue": 4002, "WK-SATURDAY": 4006, "business": 5000, "dly": 6000, "hourly": 7000, "MINUTE": 8000, "secondly": 9000, "undef": -10000}  # fixed values
query("freq_aliases", lambda s, d: s.createDataFrame([(a, Q.check_freq(a), Q.get_freq_group(a), Q.check_freq(Q.check_freq_str(a))) for a in _ALIASES], "alias string, code int, grp int, again int"), "SELECT unnest([{}]) AS alias, unnest([{}])::INT AS code, unnest([{}])::INT AS grp, unnest([{}])::INT AS again".format(", ".join(f"'{a}'" for a in _ALIASES), *[", ".join(str(f(c)) for c in _ALIASES.values()) for f in (int, lambda c: c // 1000 * 1000, int)]))
query("date_from_parts", lambda s, d: s.range(1).select(P.date("A", year=1998).alias("a"), P.date("Q", year=1998, quarter=3).alias("q"), P.date("M", year=1998, month=2).alias("m"), P.date("D", year=1998, month=2, day=28).alias("d"), P.date("S", year=1998, month=2, day=28, hour=1, minute=2, second=3).alias("s"), P.date("B", string="1998-02-27").alias("b"), P.date("D", 7).alias("v")), f"SELECT 1998::BIGINT AS a, (1997 * 4 + 3)::BIGINT AS q, (1997 * 12 + 2)::BIGINT AS m, {day('DATE ' + chr(39) + '1998-02-28' + chr(39))} AS d, epoch(TIMESTAMP '1998-02-28 01:02:03')::BIGINT AS s, (({day('DATE ' + chr(39) + '1998-02-27' + chr(39))} // 7) * 5 + {day('DATE ' + chr(39) + '1998-02-27' + chr(39))} % 7)::BIGINT AS b, 7::BIGINT AS v")
query("period_to_datetime", lambda s, d: orders_monthly(s, d).select("t", F.unix_timestamp(P.start_timestamp("t", "M").cast("timestamp")).alias("first"), F.date_format(P.end_date("t", "M"), "yyyy-MM-dd").alias("last")), "SELECT t, epoch(m)::BIGINT AS first, strftime(last_day(m), '%Y-%m-%d') AS last FROM (SELECT t, make_date(((t - 1) // 12 + 1)::INTEGER, ((t - 1) % 12 + 1)::INTEGER, 1) AS m FROM om)", "om")
query("period_now", lambda s, d: s.range(1).select((P.now("D") - P.to_period(F.localtimestamp(), "D")).alias("diff"), (P.now("A") == F.year(F.localtimestamp())).alias("same")), "SELECT 0::BIGINT AS diff, TRUE AS same")
query("strftime_fiscal", lambda s, d: _read(s, d, "orders", P.to_period("o_orderdate", "Q-E-JUN").alias("t")).distinct().select("t", P.strftime("t", "Q-E-JUN", "%FQ%q %f").alias("text")), "SELECT DISTINCT (y * 4 + q)::BIGINT AS t, (y + 1)::VARCHAR || 'Q' || q || ' ' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS text FROM (SELECT year(o_orderdate + INTERVAL 6 MONTH) - 1 AS y, quarter(o_orderdate + INTERVAL 6 MONTH) AS q FROM (SELECT date_trunc('month', o_orderdate) AS o_orderdate FROM orders))")
query("date_arithmetic", lambda s, d: orders_daily(s, d).select("t", (F.col("t") + 3).alias("later"), C.difference(F.col("t"), F.lit(728000), "D", "D").alias("apart"), C.compared(F.col("t"), F.lit(729000), "D", "D", "<").alias("before"), C.compared(F.col("t"), F.lit(729000), "D", "D", ">=").alias("since")), "SELECT t, t + 3 AS later, t - 728000 AS apart, t < 729000 AS before, t >= 729000 AS since FROM od", "od")
query("date_array", lambda s, d: C.date_array(s, "M", 24000, length=40, step=3), "SELECT unnest(range(24000, 24118, 3))::BIGINT AS t")
query("time_series", lambda s, d: C.time_series(_read(s, d, "orders", F.date_format("o_orderdate", "yyyy-MM-dd").alias("when"), "o_orderkey"), "when", "M", ["o_orderkey"]), "SELECT ((year(o_orderdate) - 1) * 12 + month(o_orderdate))::BIGINT AS t, o_orderkey FROM orders")
query("records", lambda s, d: C.records(s, {"_dates": ["2007-01-31", "2007-03-01"], "a": [1, 2], "b": [0.5, None]}, "M"), "SELECT unnest([24073, 24075])::BIGINT AS t, unnest([1, 2])::BIGINT AS a, unnest([0.5, NULL])::DOUBLE AS b")
query("records_from_rows", lambda s, d: C.records(s, [(1, "u"), (2, "v")], "D", ["a", "b"], [732677, 732678]), "SELECT unnest([732677, 732678])::BIGINT AS t, unnest([1, 2])::BIGINT AS a, unnest(['u', 'v']) AS b")

# element access and shapes
query("at_dates", lambda s, d: C.at_dates(orders_daily(s, d), [728659, 728700, 1]), "SELECT t, round(x, 4) AS x FROM od WHERE t IN (728659, 728700, 1)", "od")
query("field_access", lambda s, d: A.stack(orders_daily(s, d), orders_in_rows(s, d).withColumnRenamed("x", "y")).select("t", "y").where("y > 1e5"), "SELECT t, round(x, 4) AS y FROM od WHERE x > 1e5", "od")
query("split_series", lambda s, d: C.split(A.stack(orders_daily(s, d), orders_daily(s, d).withColumn("y", -F.col("x")).drop("x")))[1], "SELECT t, round(-x, 4) AS y FROM od", "od")
query("flatten", lambda s, d: C.flatten(orders_daily(s, d).select("t", F.array("x", 2 * F.col("x")).alias("x")), "x"), "SELECT t, k::INT AS cell, round((k + 1) * x, 4) AS x FROM od, (SELECT unnest([0, 1]) AS k)", "od")
query("clip_round", lambda s, d: A.rounded(A.clip(orders_in_rows(s, d), "x", 1e5, 1e6), "x", -2), "SELECT t, round_even(least(greatest(x, 1e5), 1e6) / 100, 0) * 100 AS x FROM od", "od")
query("take", lambda s, d: A.take(orders_daily(s, d), [7, 2, 7]), "SELECT t, round(x, 4) AS x, place FROM (SELECT *, row_number() OVER (ORDER BY t) - 1 AS pos FROM od) JOIN (SELECT unnest([7, 2, 7]) AS pos, unnest([0, 1, 2])::BIGINT AS place) USING (pos)", "od")
query("repeat", lambda s, d: A.repeat(orders_monthly(s, d), 3), "SELECT t, round(x, 4) AS x FROM om, range(3)", "om")
query("searchsorted", lambda s, d: A.searchsorted(orders_daily(s, d), [728659, 729000, 1]), "SELECT date::BIGINT AS date, (SELECT count(*) FROM od WHERE t < date) AS pos FROM (SELECT unnest([728659, 729000, 1]) AS date)", "od")
query("unary", lambda s, d: orders_in_rows(s, d).select("t", (-F.col("x")).alias("neg"), F.abs(1e5 - F.col("x")).alias("abs"), F.pmod(F.floor("x"), F.lit(7)).alias("mod"), F.floor("x").bitwiseAND(F.lit(12)).alias("bits")), "SELECT t, round(-x, 4) AS neg, round(abs(1e5 - x), 4) AS abs, floor(x)::BIGINT % 7 AS mod, floor(x)::BIGINT & 12 AS bits FROM od", "od")
query("all_any", lambda s, d: A.all_any(users_in_rows(s, d).withColumn("x", F.col("x") > 50), "x", U), "SELECT user_id, bool_and(x > 50) AS all, bool_or(x > 50) AS any FROM uf GROUP BY 1", "uf")
query("product", lambda s, d: A.stats(users_full(s, d).withColumn("x", 1 + F.col("x") / 1e6), "x", U).select("user_id", "prod"), "SELECT user_id, round(product(1 + x / 1e6), 8) AS prod FROM uf GROUP BY 1", "uf", digits=8)

# conversion


def _spread(values):
    some = values[~np.isnan(values)]
    return float(some.max() - some.min()) if len(some) else None


query("convert_callable", lambda s, d: S.convert(users_full(s, d), "M", _spread, keys=U), f", g AS (SELECT user_id, ((year({of_day('t')}) - 1) * 12 + month({of_day('t')}))::BIGINT AS t, round(max(x) - min(x), 4) AS x FROM uf GROUP BY 1, 2) SELECT * FROM g", "uf")
query("convert_timestep", lambda s, d: S.convert(S.change_timestep(A.fill_missing_dates(orders_daily(s, d)), 7, "sum"), "M").select("t", F.size("x").alias("cells"), F.size(F.array_compact("x")).alias("full")), f", w AS (SELECT t0 + ((t - t0) // 7) * 7 AS t, sum(x) AS x FROM of, (SELECT min(t) AS t0 FROM of) GROUP BY 1) SELECT ((year({of_day('t')}) - 1) * 12 + month({of_day('t')}))::BIGINT AS t, 5::INT AS cells, count(x)::INT AS full FROM w GROUP BY 1", "of")

# windows by their formulas: names, parameters and the weights of span 5 written out (fixed values of their definitions)
_SPAN = {"boxcar": "boxcar", "bartlett": "bartlett", "blackman": "blackman", "kaiser": 5.0, "gaussian": ("gaussian", 1.5), "general_gaussian": ("general_gaussian", 1.5, 2.0), "parzen": "parzen", "bohman": "bohman", "blackmanharris": "blackmanharris", "nuttall": "nuttall", "barthann": "barthann", "slepian": ("slepian", 0.4)}
_FORMULA = {
    "boxcar": "1.0", "bartlett": "1 - abs(j - 2) / 2.0", "blackman": "0.42 - 0.5 * cos(pi() * j / 2) + 0.08 * cos(pi() * j)", "gaussian": "exp(-0.5 * power((j - 2) / 1.5, 2))", "general_gaussian": "exp(-0.5 * power(abs((j - 2) / 2.0), 3))",
    "parzen": "CASE WHEN abs(j - 2) <= 1.25 THEN 1 - 6 * power((j - 2) / 2.5, 2) + 6 * power(abs(j - 2) / 2.5, 3) ELSE 2 * power(1 - abs(j - 2) / 2.5, 3) END", "bohman": "(1 - abs(j - 2) / 2.0) * cos(pi() * abs(j - 2) / 2) + sin(pi() * abs(j - 2) / 2) / pi()",
    "blackmanharris": "0.35875 - 0.48829 * cos(pi() * j / 2) + 0.14128 * cos(pi() * j) - 0.01168 * cos(1.5 * pi() * j)", "nuttall": "0.3635819 - 0.4891775 * cos(pi() * j / 2) + 0.1365995 * cos(pi() * j) - 0.0106411 * cos(1.5 * pi() * j)", "barthann": "0.62 - 0.48 * abs(j / 4.0 - 0.5) + 0.38 * cos(2 * pi() * (j / 4.0 - 0.5))",
}
for _name, _kind in _SPAN.items():
    _ws = f"[{_FORMULA[_name]} FOR j IN range(5)]" if _name in _FORMULA else "[" + ", ".join(repr(float(v)) for v in M.window_weights(_kind, 5)) + "]::DOUBLE[]"
    _terms = " + ".join(f"CASE WHEN abs(w[{i + 1}]) > 1e-15 THEN w[{i + 1}] * {'lag' if i < 2 else 'lead'}(x, {abs(i - 2)}) OVER (ORDER BY t) ELSE 0 END" for i in range(5))
    query(f"cmov_window_{_name}", lambda s, d, k=_kind: M.cmov_window(A.fill_missing_dates(orders_daily(s, d)), "x", 5, k, True), f", k AS (SELECT {_ws} AS w) SELECT t, round(CASE WHEN min(n) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) IS NOT NULL AND count(*) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN ({_terms}) / list_sum(w) END, 4) AS x FROM (SELECT *, 1 AS n FROM of), k", "of", digits=4)


def _poly(c, n):
    return sum(((c - 728000) / F.lit(770.0)) ** i * (-1) ** i for i in range(n + 1))


def _poly_sql(n):
    return " + ".join(f"{(-1) ** i} * power((t - 728000) / 770.0, {i})" for i in range(n + 1))


for _name, _n in (("cubic", 3), ("quintic", 5)):  # a spline of this order is a polynomial of it, where it is given one
    query(f"interp_{_name}", lambda s, d, k=_name, n=_n: I.interpolate(A.fill_missing_dates(orders_daily(s, d)).withColumn("x", F.when(F.pmod("t", F.lit(7)).isin(0, 2, 5) & F.col("x").isNotNull(), _poly(F.col("t"), n))), "x", k), f", g AS (SELECT t, {_poly_sql(_n)} AS y, x IS NOT NULL AND t % 7 IN (0, 2, 5) AS has FROM of) SELECT t, CASE WHEN t BETWEEN (SELECT min(t) FROM g WHERE has) AND (SELECT max(t) FROM g WHERE has) THEN round(y, 5) END AS x FROM g", "of", digits=5)

# correlations
_ACF = f"{_AVF}, k AS (SELECT list(cov ORDER BY lag) AS c FROM c), r AS (SELECT [v / c[1] FOR v IN c] AS r FROM k)"
query("pacf", lambda s, d: R.pacf(orders_monthly(s, d), "x", 12), _ACF + ", p AS (WITH RECURSIVE d AS (SELECT 1 AS k, [r[2]] AS phi, 1 - r[2] * r[2] AS rest, r FROM r UNION ALL SELECT k + 1, [phi[i] - pk * phi[k + 1 - i] FOR i IN range(1, k + 1)] || [pk], rest * (1 - pk * pk), r FROM (SELECT *, (r[k + 2] - list_sum([phi[i] * r[k + 2 - i] FOR i IN range(1, k + 1)])) / rest AS pk FROM d WHERE k < 12)) SELECT * FROM d) SELECT 0::BIGINT AS lag, 0.0::DOUBLE AS pacf UNION ALL SELECT k::BIGINT, round(phi[k], 6) FROM p", "om", digits=6)
query("acf_std_full", lambda s, d: R.acf_std(orders_monthly(s, d), "x", 12, confidence=0.9544997, simplified=False), f"{_ACF}, e AS (SELECT k, i, coalesce(r[abs(i) + 1], 0) AS ri, CASE WHEN abs(i + k) <= 12 THEN r[abs(i + k) + 1] ELSE 0 END AS rp, CASE WHEN abs(i - k) <= 12 THEN r[abs(i - k) + 1] ELSE 0 END AS rm, r[k + 1] AS rk FROM r, (SELECT unnest(range(13)) AS k), (SELECT unnest(range(-12, 13)) AS i)) SELECT k::BIGINT AS lag, round(CASE WHEN k = 0 THEN 0 ELSE sqrt(greatest(sum(ri * ri + rp * rm - 4 * rk * ri * rm + 2 * rk * rk * ri * ri), 0) / (SELECT count(*) FROM om)) * 1.9999999725 END, 5) AS std FROM e GROUP BY k", "om", digits=5)
query("lags", lambda s, d: s.createDataFrame([(i, v) for i, v in enumerate(R.lags(6))], "i int, lag int"), "SELECT i::INT AS i, CASE WHEN i < 6 THEN i ELSE i - 11 END::INT AS lag FROM (SELECT unnest(range(11)) AS i)")

# ticks
_DAY0, _DAY1 = 732677, 732677 + 400
query("ticks_daily", lambda s, d: ticks(s, _DAY0, _DAY1, "D"), f"WITH t AS (SELECT unnest(range({_DAY0}, {_DAY1 + 1}))::BIGINT AS val), o AS (SELECT val, {of_day('val')} AS o FROM t) SELECT val, day(o) = 1 OR val IN ({_DAY0}, {_DAY1}) AS maj, isodow(o) = 1 AND day(o) <> 1 AS min, CASE WHEN day(o) = 1 AND month(o) = 1 THEN strftime(o, '%b' || chr(10) || '%Y') WHEN day(o) = 1 THEN strftime(o, '%b') ELSE '' END AS fmt FROM o")
_SUMMER = 732677 + 150
query("ticks_two_months", lambda s, d: ticks(s, _SUMMER, _SUMMER + 60, "D"), f"WITH t AS (SELECT unnest(range({_SUMMER}, {_SUMMER + 61}))::BIGINT AS val), o AS (SELECT val, {of_day('val')} AS o FROM t) SELECT val, day(o) = 1 OR val IN ({_SUMMER}, {_SUMMER + 60}) AS maj, TRUE AS min, CASE WHEN val = (SELECT min(val) FROM o WHERE day(o) = 1) THEN chr(10) || chr(10) || strftime(o, '%b') || chr(10) || '2007' WHEN day(o) = 1 THEN chr(10) || chr(10) || strftime(o, '%b') WHEN isodow(o) = 1 THEN strftime(o, '%d') ELSE '' END AS fmt FROM o")
query("ticks_hourly", lambda s, d: ticks(s, 324360, 324360 + 47, "H"), "WITH o AS (SELECT val::BIGINT AS val, TIMESTAMP '1970-01-01' + INTERVAL 1 HOUR * val AS o FROM (SELECT unnest(range(324360, 324408)) AS val)) SELECT val, hour(o) = 0 OR val IN (324360, 324407) AS maj, hour(o) % 6 = 0 AS min, CASE WHEN dayofyear(o) = 1 AND hour(o) = 0 THEN strftime(o, '%H:%M' || chr(10) || '%d-%b' || chr(10) || '%Y') WHEN hour(o) = 0 THEN strftime(o, '%H:%M' || chr(10) || '%d-%b') || CASE WHEN NOT (SELECT bool_or(dayofyear(o) = 1 AND hour(o) = 0) FROM o) AND val = (SELECT min(val) FROM o WHERE hour(o) = 0) THEN chr(10) || year(o) ELSE '' END WHEN hour(o) % 6 = 0 THEN strftime(o, '%H:%M') ELSE '' END AS fmt FROM o")
query("ticks_seconds", lambda s, d: ticks(s, 10**9, 10**9 + 20, "S"), "WITH o AS (SELECT val::BIGINT AS val, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * val AS o FROM (SELECT unnest(range(1000000000, 1000000021)) AS val)) SELECT val, second(o) = 0 OR val IN (1000000000, 1000000020) AS maj, second(o) % 5 = 0 AS min, CASE WHEN second(o) % 5 = 0 THEN strftime(o, '%H:%M:%S') ELSE '' END AS fmt FROM o")
query("ticks_monthly", lambda s, d: ticks(s, 24070, 24070 + 29, "M"), "WITH o AS (SELECT val::BIGINT AS val, make_date(((val - 1) // 12 + 1)::INTEGER, ((val - 1) % 12 + 1)::INTEGER, 1) AS o FROM (SELECT unnest(range(24070, 24100)) AS val)) SELECT val, month(o) = 1 AS maj, TRUE AS min, CASE WHEN month(o) = 1 THEN strftime(o, '%b' || chr(10) || '%Y') WHEN month(o) % 3 = 1 THEN strftime(o, '%b') ELSE '' END AS fmt FROM o")
query("ticks_quarterly", lambda s, d: ticks(s, 8001, 8010, "Q"), "SELECT val::BIGINT AS val, val % 4 = 1 AS maj, TRUE AS min, 'Q' || ((val - 1) % 4 + 1) || CASE WHEN val % 4 = 1 THEN chr(10) || ((val - 1) // 4 + 1) ELSE '' END AS fmt FROM (SELECT unnest(range(8001, 8011)) AS val)")
query("ticks_annual", lambda s, d: ticks(s, 1900, 2049, "A"), "SELECT val::BIGINT AS val, val % 25 = 0 AS maj, val % 5 = 0 AS min, CASE WHEN val % 25 = 0 THEN val::VARCHAR ELSE '' END AS fmt FROM (SELECT unnest(range(1900, 2051)) AS val)")
