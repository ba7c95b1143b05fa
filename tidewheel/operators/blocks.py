"""Running totals and row windows of long series without a window over a whole series.

A scan is made in levels: inside blocks of periods, over the totals of blocks inside blocks of blocks, and over the few
totals of those. A task holds a block, or one row for every BLOCK * BLOCK periods of a key. Row windows go by blocks of
positions, each with the rows around it that its frames reach, so gaps and repeated dates don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods of a block (rows, where blocks go by position).
BLOCK = 4096


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined to right where all of on are equal, nulls of keys equal to each other; columns of on are left's (of a
    full join: of either). Periods and block numbers are never null, so Spark can reuse a partitioning by them."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    ok = F.lit(True)
    for c in on:
        ok = ok & (left[c] == other[f"__r_{c}"] if c in ("t", "__b", "__s") else left[c].eqNullSafe(other[f"__r_{c}"]))
    out = left.join(other, ok, how) if on else left.crossJoin(other)
    if how == "full":
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in on})
    return out.drop(*[f"__r_{c}" for c in on])


@dataclass(frozen=True)
class Scan:
    """An aggregate of all rows up to a row (back: from it on): agg of values, join of what is farther and nearer."""

    value: Column
    agg: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    back: bool = False


def total(v: Column) -> Scan:
    return Scan(v, F.sum, lambda far, near: F.coalesce(far + near, far, near))


def product(v: Column) -> Scan:
    return Scan(v, F.product, lambda far, near: F.coalesce(far * near, far, near))


def latest(v: Column, back: bool = False) -> Scan:
    """The value nearest by its order: a struct that begins with a position or date."""
    return Scan(v, F.min if back else F.max, lambda far, near: F.coalesce(near, far), back)


def _others(totals: DataFrame, keys: Sequence[str], scans: Mapping[str, Scan], level: int) -> DataFrame:
    """keys, __b and, for each scan, its aggregate over the blocks before (back: after) the block."""
    sides = {n: (1, Window.unboundedFollowing) if s.back else (Window.unboundedPreceding, -1) for n, s in scans.items()}
    if not level:
        w = Window.partitionBy(*keys).orderBy("__b")
        return totals.select(*keys, "__b", *[s.agg(F.col(n)).over(w.rowsBetween(*sides[n])).alias(n) for n, s in scans.items()])
    up = totals.withColumn("__s", F.floor(F.col("__b") / BLOCK).cast("long"))
    tops = up.groupBy(*keys, "__s").agg(*[s.agg(F.col(n)).alias(n) for n, s in scans.items()]).withColumnRenamed("__s", "__b")
    far = _others(tops, keys, scans, level - 1).select(*keys, F.col("__b").alias("__s"), *[F.col(n).alias(f"__far_{n}") for n in scans])
    w = Window.partitionBy(*keys, "__s").orderBy("__b")
    near = up.select(*keys, "__s", "__b", *[s.agg(F.col(n)).over(w.rowsBetween(*sides[n])).alias(n) for n, s in scans.items()])
    return same_keys(near, far, [*keys, "__s"]).select(*keys, "__b", *[s.join(F.col(f"__far_{n}"), F.col(n)).alias(n) for n, s in scans.items()])


def scanned(df: DataFrame, keys: Sequence[str], scans: Mapping[str, Scan], block: int = BLOCK, order: Sequence[str] = ("t",)) -> DataFrame:
    """df with a column for each scan. The first column of order makes the blocks."""
    own = df.withColumn("__b", F.floor(F.col(order[0]) / block).cast("long")).withColumns({f"__v_{n}": s.value for n, s in scans.items()})
    totals = own.groupBy(*keys, "__b").agg(*[s.agg(F.col(f"__v_{n}")).alias(n) for n, s in scans.items()])
    far = _others(totals, keys, scans, 1).select(*keys, "__b", *[F.col(n).alias(f"__far_{n}") for n in scans])
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    sides = {n: (0, Window.unboundedFollowing) if s.back else (Window.unboundedPreceding, 0) for n, s in scans.items()}
    out = same_keys(own, far, [*keys, "__b"])
    out = out.withColumns({n: s.join(F.col(f"__far_{n}"), s.agg(F.col(f"__v_{n}")).over(w.rowsBetween(*sides[n]))) for n, s in scans.items()})
    return out.drop("__b", *[f"__{k}_{n}" for n in scans for k in ("v", "far")])


def numbered(df: DataFrame, keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Positions from 0 in the order of dates."""
    return scanned(df, keys, {name: total(F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def neighbours(df: DataFrame, keys: Sequence[str], order: str, x: str, made: Mapping[str, Callable]) -> DataFrame:
    """A row for each key: aggregates over pairs of neighbouring rows in an order of any type, nulls last, rows alike in
    it by x. made gives, by name, a function of x in the row before and in the row that makes a Scan. Rows are dealt out
    by ranges of the order and numbered; a block of them is then its aggregates, its first x and its last x, and so is a
    block of blocks. The topmost level has a row for every BLOCK * BLOCK rows and one for every range."""
    at = F.col("__o").asc_nulls_last()
    own = df.select(*keys, F.col(order).alias("__o"), F.col(x).alias("__first")).repartitionByRange(*keys, at).sortWithinPartitions(*keys, at, "__first")
    out = own.select(*keys, F.monotonically_increasing_id().alias("__p"), "__first", F.col("__first").alias("__last"))
    have: list[str] = []
    for level in (1, 2, 0):
        out = out.withColumn("__b", F.expr(f"__p div {BLOCK**level}")) if level else out
        part = [*keys, "__b"] if level else keys
        before = F.lag("__last").over(Window.partitionBy(*part).orderBy("__p"))
        pairs = {n: f(F.col("__before"), F.col("__first")) for n, f in made.items()}
        rows = out.withColumn("__before", before).withColumns({f"__v_{n}": s.value for n, s in pairs.items()})
        ends = [F.min_by("__first", "__p").alias("__first"), F.max_by("__last", "__p").alias("__last"), F.min("__p").alias("__p")] if level else []
        out = rows.groupBy(*part).agg(*[s.join(s.agg(F.col(n)), s.agg(F.col(f"__v_{n}"))).alias(n) if n in have else s.agg(F.col(f"__v_{n}")).alias(n) for n, s in pairs.items()], *ends)
        have = list(made)
    return out.select(*keys, *made)


def framed(df: DataFrame, keys: Sequence[str], before: int, after: int, make: Mapping[str, Callable], block: int = BLOCK) -> DataFrame:
    """df with row-window columns that look at most so many rows back and ahead. make gives, by name, a
    function of the ordered window."""
    block = max(block, before, after, 1)
    own = numbered(df, keys, "__p").withColumn("__home", F.floor(F.col("__p") / block).cast("long"))
    first, last = F.floor((F.col("__p") - after) / block).cast("long"), F.floor((F.col("__p") + before) / block).cast("long")
    out = own.withColumn("__block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "__block").orderBy("__p")
    return out.withColumns({n: f(w) for n, f in make.items()}).where("__home = __block").drop("__home", "__block", "__p")
