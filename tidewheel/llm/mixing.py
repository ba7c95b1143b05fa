"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

At each training time a source's share is its scheduled weight over the sum of all sources' weights then. The integral
of that share, scaled to the source's target, is its cumulative token demand, and the inverse of the demand gives every
pass over every document a training position. The documents of a source are taken in a keyed pseudo-random order, so
what is taken of a pass is a prefix of that order.

The running word count inside a source never needs the source in one task: two levels of buckets by leading hex digits
of the key are summed first (partial aggregation), and only rows of one small bucket meet in a window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, read, written

#: Rows that meet in one window at most on average; more rows get more buckets.
BUCKET_ROWS = 2000
CYCLE = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: Factors of a source's weight at the start and the end of training, by turns as CYCLE; between them it is linear.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Parts of training time in which shares count as linear.
STEPS = 16


def keyed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc columns plus __size (words), __skey (source, null marked) and __key (order inside a source: a hash of doc_id and
    text, so that rows which share a doc_id, null too, are spread)."""
    return docs.withColumns(
        {
            "__size": n_words(F.col("text")),
            "__skey": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
            "__key": F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")),
        }
    )


def targets(totals: DataFrame, cycle: Sequence[float] = CYCLE, max_passes: int = MAX_PASSES, schedule: Mapping[str, Sequence[tuple[float, float]]] | None = None, ramps: Sequence[tuple[float, float]] = ((1.0, 1.0),)) -> DataFrame:
    """__skey, source_size and target of every source, and its demand curve.

    totals: __skey, source, source_size; a row a source, the only thing that is windowed without a key. A source's
    weight is the mean of its schedule, (time, weight) knots, or else the next of the cycle in code point order, which
    its ramp changes with time. Amounts go by weights: shares of the whole are capped at max_passes times the source's
    size and the excess is shared again: sources ordered by cap / weight are capped as long as the level of the rest
    reaches their cap. Curves go by time: curve is the part of the demand met at times.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    schedule = {s: sorted(knots) for s, knots in (schedule or {}).items()}
    grid = sorted({*(i / STEPS for i in range(STEPS + 1)), *(t for knots in schedule.values() for t, _ in knots if 0 <= t <= 1)})
    turn = F.row_number().over(w) - 1
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), turn % len(cycle) + 1)
    start, end = (F.element_at(F.array(*[F.lit(float(r[i])) for r in ramps]), turn % len(ramps) + 1) for i in (0, 1))
    at = F.array(*[weight * (start + (end - start) * F.lit(t)) for t in grid])
    for s, knots in schedule.items():
        values = [_weight(knots, t) for t in grid]
        mean = sum((b - a) * (x + y) / 2 for a, b, x, y in zip(grid, grid[1:], values, values[1:]))
        weight = F.when(F.col("source") == s, F.lit(mean)).otherwise(weight)
        at = F.when(F.col("source") == s, F.array(*[F.lit(v) for v in values])).otherwise(at)
    out = totals.withColumn("__w", weight).withColumn("__at", at)
    share = F.array(*[F.col("__at")[i] / F.nullif(F.sum(F.col("__at")[i]).over(every), F.lit(0.0)) for i in range(len(grid))])
    out = out.withColumn("__share", F.transform(share, lambda v: F.coalesce(v, F.lit(0.0))))
    area = F.array(*[F.lit((b - a) / 2) * (F.col("__share")[i] + F.col("__share")[i + 1]) for i, (a, b) in enumerate(zip(grid, grid[1:]))])
    sums = F.aggregate(area, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    out = out.withColumn("__sums", sums).withColumn("curve", F.transform("__sums", lambda v: v / F.nullif(F.element_at("__sums", -1), F.lit(0.0)))).withColumn("times", F.array(*[F.lit(t) for t in grid]))
    cap = F.col("source_size") * F.lit(float(max_passes))
    out = out.withColumn("__cap", cap).withColumn("__level", F.col("__cap") / F.col("__w"))
    by = Window.orderBy("__level", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumns(
        {
            "__left": F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
            "__rest": F.sum("__w").over(after),
        }
    ).withColumn("__capped", F.col("__cap") * F.col("__rest") <= F.col("__left") * F.col("__w"))
    level = F.max(F.when(~F.col("__capped"), F.struct(F.col("__rest").alias("r"), F.col("__left").alias("l")))).over(every)
    out = out.withColumn("__top", level)
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__w") * F.col("__top.l") / F.col("__top.r"))
    return out.select("__skey", "source_size", target.alias("target"), "curve", "times")


def _weight(knots: Sequence[tuple[float, float]], t: float) -> float:
    if t <= knots[0][0]:
        return knots[0][1]
    for (a, x), (b, y) in zip(knots, knots[1:]):
        if t <= b:
            return x + (y - x) * (t - a) / (b - a) if b > a else y
    return knots[-1][1]


def mixed(docs: DataFrame, cycle: Sequence[float] = CYCLE, max_passes: int = MAX_PASSES, schedule: Mapping[str, Sequence[tuple[float, float]]] | None = None, ramps: Sequence[tuple[float, float]] = ((1.0, 1.0),), seed: str = "mix") -> DataFrame:
    """docs (or what keyed() made of them) with __size, source_size, target, __before (words of the source before it in a pass) and taken.

    taken is size times the whole passes, plus what the last, partial pass reaches of the document; one document of a
    source is cut there, so the words taken of a source are its target, rounded. Empty and null texts take 0. Rows
    alike in doc_id and text are interchangeable. An empty table gives no rows.
    """
    all_rows = docs if "__key" in docs.columns else keyed(docs, seed)
    sizes = all_rows.groupBy("__skey", "source", F.substring("__key", 1, 6).alias("__six")).agg(F.sum("__size").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    rows = sizes.agg(F.sum("__n")).first()[0] or 0
    digits = max(1, min(6, math.ceil(math.log(max(rows, 2) / BUCKET_ROWS, 16)) + 1))
    half = digits // 2
    fine = sizes.groupBy("__skey", "source", F.substring("__six", 1, digits).alias("__fine")).agg(F.sum("__sum").alias("__sum"))
    coarse = fine.groupBy("__skey", "source", F.substring("__fine", 1, half).alias("__coarse")).agg(F.sum("__sum").alias("__sum"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    at_coarse = coarse.withColumn("__c0", F.coalesce(F.sum("__sum").over(up_to(Window.partitionBy("__skey").orderBy("__coarse"))), F.lit(0)))
    totals = coarse.groupBy("__skey", "source").agg(F.sum("__sum").alias("source_size"))
    goal = targets(totals, cycle, max_passes, schedule, ramps)
    base = (
        fine.withColumn("__coarse", F.substring("__fine", 1, half))
        .withColumn("__f0", F.coalesce(F.sum("__sum").over(up_to(Window.partitionBy("__skey", "__coarse").orderBy("__fine"))), F.lit(0)))
        .join(at_coarse.select("__skey", "__coarse", "__c0"), ["__skey", "__coarse"])
        .join(goal, "__skey")
        .select("__skey", "__fine", (F.col("__c0") + F.col("__f0")).alias("__base"), "source_size", "target", "curve", "times")
    )
    w = Window.partitionBy("__skey", "__fine").orderBy("__key", "doc_id", "__size")
    clash = [c for c in ("source_size", "target", "curve", "times", "taken") if c in docs.columns]
    out = all_rows.drop(*clash).withColumn("__fine", F.substring("__key", 1, digits)).join(base, ["__skey", "__fine"])
    out = out.withColumn("__before", F.col("__base") + F.coalesce(F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goal_words = F.floor(F.col("target") + 0.5)
    size = F.when(F.col("source_size") > 0, F.col("source_size"))
    passes = F.coalesce(F.floor(goal_words / size), F.lit(0))
    part = F.least(F.col("__size"), F.greatest(F.lit(0), goal_words - passes * F.col("source_size") - F.col("__before")))
    return out.withColumn("__passes", passes).withColumn("taken", (passes * F.col("__size") + part).cast("long"))


def position(words) -> F.Column:
    """Training time at which the demand of the row's source reaches so many words: the curve is inverted by segments."""
    x = words / F.when(F.col("target") > 0, F.col("target"))
    i = F.greatest(F.lit(1), F.least(F.size("curve") - 1, F.size(F.filter("curve", lambda v: v <= x))))
    a, b = F.element_at("curve", i), F.element_at("curve", i + 1)
    s, t = F.element_at("times", i), F.element_at("times", i + 1)
    return s + (t - s) * F.coalesce((x - a) / F.when(b > a, b - a), F.lit(0.0))


def _passes(docs: DataFrame, **how) -> DataFrame:
    """A row for every pass over a document that takes at least half of it, in training order: columns of docs, whose
    names begin with __own_ here, then __pass and __at."""
    need = ("doc_id", "source", "text")
    own = docs.select(*need, *[F.col(f"`{c}`").alias(f"__own_{c}") for c in docs.columns if c not in need])
    out = mixed(own, **how)
    copies = F.when(F.col("__size") > 0, F.floor(F.col("taken") / F.col("__size") + 0.5)).otherwise(0).cast("int")
    out = out.withColumn("__copies", copies).where("__copies > 0").withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    middle = (F.col("__pass") - 1) * F.col("source_size") + F.col("__before") + F.col("__size") / 2
    back = [F.col(c if c in need else f"`__own_{c}`").alias(c) for c in docs.columns]
    return out.withColumn("__at", position(middle)).sort("__at", "__key").select(*back, "__pass", "__at")


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The training order: a row for every pass over a document that takes at least half of it, range-sorted by its
    position. Columns of docs, then pass_no (from 1) and position (0 to 1), which replace columns of these names."""
    gone = [c for c in ("pass_no", "position") if c in docs.columns]
    out = _passes(docs.drop(*gone), **how)
    return out.withColumnsRenamed({"__pass": "pass_no", "__at": "position"})


def ordered(docs: DataFrame, **how) -> DataFrame:
    """curriculum() with the columns of docs alone, whatever their names."""
    return _passes(docs, **how).drop("__pass", "__at")


def op2(spark, sf_dir: str) -> DataFrame:
    """The schedule of RAMPS; words are counted once, and rows come range-sorted by their first position."""
    docs = keyed(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    out = mixed(written(docs, "sizes"), ramps=RAMPS)
    first = F.when(F.col("taken") > 0, position(F.col("__before") + F.col("__size") / 2))
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken", F.round(first, 9).alias("first_position")).sort("first_position", "doc_id")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][i] AS w, [1.5::DOUBLE, 1.0, 0.5][i] AS r0, [0.5::DOUBLE, 1.0, 1.5][i] AS r1, source_size * 3.0::DOUBLE AS cap
      FROM (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT AS i FROM s)),
h AS (SELECT source, j, w * (r0 + (r1 - r0) * j / 16.0::DOUBLE) / sum(w * (r0 + (r1 - r0) * j / 16.0::DOUBLE)) OVER (PARTITION BY j) AS share FROM n, (SELECT unnest(range(17)) AS j)),
q AS (SELECT source, j, sum(a) OVER (PARTITION BY source ORDER BY j) AS area FROM (SELECT source, j, coalesce((share + lag(share) OVER (PARTITION BY source ORDER BY j)) / 32.0::DOUBLE, 0) AS a FROM h)),
v AS (SELECT source, list(area ORDER BY j) AS curve, max(area) AS whole FROM q GROUP BY source),
l AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)),
c AS (SELECT *, cap * rest <= rem * w AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * (SELECT max_by(rem, rest) FROM c WHERE NOT capped) / (SELECT max(rest) FROM c WHERE NOT capped) END AS target FROM c),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes FROM t),
r AS (SELECT d.*, g.source_size, g.target, g.goal, g.passes,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
x AS (SELECT *, (passes * size + least(size, greatest(0, goal - passes * source_size - before)))::BIGINT AS taken FROM r),
y AS (SELECT x.*, v.curve, v.whole, (before + size / 2) / target * v.whole AS need FROM x JOIN v ON x.source IS NOT DISTINCT FROM v.source),
z AS (SELECT *, greatest(1, least(16, len([c FOR c IN curve IF c <= need]))) AS seg FROM y)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round((seg - 1 + (need - curve[seg]) / (curve[seg + 1] - curve[seg])) / 16, 9) END AS first_position FROM z
"""
