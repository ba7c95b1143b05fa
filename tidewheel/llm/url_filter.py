"""URL filter: host/path rules, and for urls without a rule a ratio of character language models, native throughout.

Two variable-order Markov models (contexts of up to two characters, Witten-Bell smoothed down to a uniform one) are
counted from the urls that the rules allow and from those they block. A url is scored by the mean over its characters
of log P(allowed) - log P(blocked), in thousandths, and blocked below a threshold that is calibrated on the same urls:
the point as many standard deviations below the mean of the allowed as above that of the blocked.

The table of log ratios has SYMBOLS ** 3 entries whatever the data, so it travels as a constant in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, read

ALPHABET = "abcdefghijklmnopqrstuvwxyz9.-/?=&_%#:"
#: 0 stands before the url, the last for any other character.
SYMBOLS = len(ALPHABET) + 2
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ://."""
    at = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(at(1)), at(2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and its verdict, null without one."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def grams(url: Column) -> Column:
    """Codes of each character with the two before it."""
    text = F.regexp_replace(ascii_lower(url), "[0-9]", "9")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), _code)
    # zipped, not looked up by position: a lambda evaluates what it refers to once an element, which is quadratic
    before = F.zip_with(F.concat(F.array(F.lit(0), F.lit(0)), codes), F.concat(F.array(F.lit(0)), codes), lambda x, y: x * SYMBOLS + y)
    return F.filter(F.zip_with(before, codes, lambda xy, c: xy * SYMBOLS + c), lambda g: g.isNotNull())


def _code(c: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at).otherwise(SYMBOLS - 1)


def log_ratios(urls: DataFrame) -> DataFrame:
    """urls(url, verdict) -> (g, lr): for every gram the log ratio in thousandths. SYMBOLS ** 3 rows."""
    n = SYMBOLS
    seen = urls.select("verdict", F.explode(grams(F.col("url"))).alias("g")).groupBy("g").pivot("verdict", ["allow", "block"]).agg(F.count(F.lit(1)))
    every = urls.sparkSession.range(n**3).select(F.col("id").alias("g")).join(seen, "g", "left").na.fill(0)
    every = every.withColumns({"a": F.floor(F.col("g") / n**2), "b": F.floor(F.col("g") / n) % n, "c": F.col("g") % n})
    few = lambda v, *by: every.groupBy(*by).agg(F.sum(v).alias("n"))
    for v in ("allow", "block"):
        uni = few(v, "c")
        total = uni.agg(F.sum("n").alias("N0"), F.count_if(F.col("n") > 0).alias("T0"))
        p0 = uni.join(F.broadcast(total)).select("c", ((F.col("n") + F.col("T0") / n) / F.greatest(F.col("N0") + F.col("T0"), F.lit(1))).alias("p")).withColumn("p", F.when(F.col("p") > 0, F.col("p")).otherwise(1.0 / n))
        bi = few(v, "b", "c")
        ctx = bi.groupBy("b").agg(F.sum("n").alias("N1"), F.count_if(F.col("n") > 0).alias("T1"))
        p1 = bi.join(ctx, "b").join(p0, "c").select("b", "c", F.when(F.col("N1") > 0, (F.col("n") + F.col("T1") * F.col("p")) / (F.col("N1") + F.col("T1"))).otherwise(F.col("p")).alias("p1"))
        ctx2 = every.groupBy("a", "b").agg(F.sum(v).alias("N2"), F.count_if(F.col(v) > 0).alias("T2"))
        every = every.join(ctx2, ["a", "b"]).join(p1, ["b", "c"])
        every = every.withColumn(f"p_{v}", F.when(F.col("N2") > 0, (F.col(v) + F.col("T2") * F.col("p1")) / (F.col("N2") + F.col("T2"))).otherwise(F.col("p1"))).drop("N2", "T2", "p1")
    return every.select("g", F.round(1000 * (F.ln("p_allow") - F.ln("p_block"))).cast("int").alias("lr"))


def score(url: Column, table: Column) -> Column:
    """Mean log ratio of a character in thousandths; null for an empty url."""
    g = grams(url)
    return F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + F.get(table, x.cast("int"))) / F.nullif(F.size(g), F.lit(0))


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, score and verdict (columns of these names are replaced).

    Null, empty and strange urls are allowed where no rule fits and nothing can be scored; so is every url as long as
    the rules allow none or block none, as there is then nothing to compare. An empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    out = pages.drop("host", "path", "rule", "score", "verdict").withColumn("host", host).withColumn("path", path)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = out.select("url", verdict.alias("verdict")).where("verdict IS NOT NULL")
    table = log_ratios(ruled).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("g", "lr"))), lambda x: x["lr"].cast("string"))).alias("t")).first().t
    table = F.split(F.lit(table), ",").cast("array<int>")
    s = ruled.select("verdict", score(F.col("url"), table).alias("s")).groupBy("verdict").agg(F.avg("s").alias("m"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("d"))
    at = {r.verdict: r for r in s.collect()}  # two rows
    if len(at) == 2:
        a, b = at["allow"], at["block"]
        limit = (a.m * b.d + b.m * a.d) / (a.d + b.d) if a.d + b.d > 0 else (a.m + b.m) / 2
        other = F.when(score(F.col("url"), table) < F.lit(limit), "block").otherwise("allow")
    else:
        other = F.lit("allow")
    return out.withColumn("rule", rule).withColumn("score", score(F.col("url"), table)).withColumn("verdict", F.coalesce(verdict, other))


def op8(spark, sf_dir: str) -> DataFrame:
    return filtered(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


OP8_SQL = r"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                  regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '9', 'g') AS u FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                     WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                     WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
codes AS (SELECT DISTINCT u, [0, 0] || [CASE WHEN instr('abcdefghijklmnopqrstuvwxyz9.-/?=&_%#:', substr(u, i, 1)) > 0
          THEN instr('abcdefghijklmnopqrstuvwxyz9.-/?=&_%#:', substr(u, i, 1)) ELSE 38 END FOR i IN range(1, length(u) + 1)] AS c FROM v),
gs AS (SELECT u, unnest([(c[i] * 39 + c[i + 1]) * 39 + c[i + 2] FOR i IN range(1, len(c) - 1)]) AS g FROM codes),
cnt AS (SELECT g, count(*) FILTER (ruled = 'allow') AS na, count(*) FILTER (ruled = 'block') AS nb FROM gs JOIN v USING (u) WHERE ruled IS NOT NULL GROUP BY g),
e AS (SELECT g, g // 1521 AS a, (g // 39) % 39 AS b, g % 39 AS c, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT range AS g FROM range(59319)) LEFT JOIN cnt USING (g)),
long AS (SELECT 'allow' AS k, g, a, b, c, na AS n FROM e UNION ALL SELECT 'block', g, a, b, c, nb FROM e),
u1 AS (SELECT k, c, sum(n) AS n FROM long GROUP BY k, c),
p0 AS (SELECT k, c, CASE WHEN n + t / 39 > 0 THEN (n + t / 39) / greatest(s + t, 1) ELSE 1.0::DOUBLE / 39 END AS p FROM u1 JOIN (SELECT k, sum(n) AS s, count(*) FILTER (n > 0) AS t FROM u1 GROUP BY k) USING (k)),
b1 AS (SELECT k, b, c, sum(n) AS n FROM long GROUP BY k, b, c),
p1 AS (SELECT k, b, c, CASE WHEN s > 0 THEN (n + t * p) / (s + t) ELSE p END AS p FROM b1 JOIN (SELECT k, b, sum(n) AS s, count(*) FILTER (n > 0) AS t FROM b1 GROUP BY k, b) USING (k, b) JOIN p0 USING (k, c)),
p2 AS (SELECT k, g, CASE WHEN s > 0 THEN (n + t * p) / (s + t) ELSE p END AS p FROM long JOIN (SELECT k, a, b, sum(n) AS s, count(*) FILTER (n > 0) AS t FROM long GROUP BY k, a, b) USING (k, a, b) JOIN p1 USING (k, b, c)),
lr AS (SELECT x.g, round(1000 * (ln(x.p) - ln(y.p)))::BIGINT AS lr FROM p2 x JOIN p2 y ON x.g = y.g AND x.k = 'allow' AND y.k = 'block'),
sc AS (SELECT u, sum(lr)::DOUBLE / count(*) AS s FROM gs JOIN lr USING (g) GROUP BY u),
m AS (SELECT avg(s) FILTER (ruled = 'allow') AS ma, avg(s) FILTER (ruled = 'block') AS mb, coalesce(stddev_pop(s) FILTER (ruled = 'allow'), 0) AS da,
             coalesce(stddev_pop(s) FILTER (ruled = 'block'), 0) AS db FROM v JOIN sc USING (u)),
l AS (SELECT CASE WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db) ELSE (ma + mb) / 2 END AS lim FROM m)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN s < lim THEN 'block' ELSE 'allow' END) AS verdict, round(s, 6) AS score FROM v LEFT JOIN sc USING (u), l
"""
