"""Date ticks for a span of periods: val, maj, min and fmt, for any plotting front end.

A case has conditions for major and minor ticks and a list of labels, of which the last that holds counts. Where the
span begins no year (or month), the first tick of the next smaller unit gets the full label: that needs the first break
of each unit, one aggregate over the span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.errors import DateError
from tidewheel.functions import period as P
from tidewheel.functions.freq import PER_DAY, Freq, parse

#: Periods of a year and of a month (fixed values); sub-daily units have 365 and 28 days.
_PER_YEAR = {"A": 1, "Q": 4, "M": 12, "W": 52, "B": 261, "D": 365, "U": 100}
_PER_MONTH = {"W": 3, "B": 19, "D": 28, "U": 10}
#: Spacing of minor and major ticks for fewer than so many years (fixed values).
_SPACING = ((11, (1, 1)), (20, (1, 2)), (50, (1, 5)), (100, (5, 10)), (200, (5, 25)), (600, (10, 50)))
#: Spans of less than a day divided by the number: unit and step of minor ticks (fixed values).
_WITHIN_DAY = ((12000, "second", 1), (6000, "second", 2), (2400, "second", 5), (1200, "second", 10), (800, "second", 15), (400, "second", 30), (150, "minute", 1), (70, "minute", 2), (24, "minute", 5), (12, "minute", 15), (6, "minute", 30), (2.5, "hour", 1), (1.5, "hour", 2), (1 / 1.25, "hour", 3), (1 / 2.5, "hour", 6), (1 / 4, "hour", 12))


def annual_spacing(years: float) -> tuple[int, int]:
    """Years between minor and between major ticks."""
    for most, out in _SPACING:
        if years < most:
            return out
    n = int(years // 1000) + 1
    return n * 20, n * 100


@dataclass
class Case:
    major: Column
    minor: Column
    #: (condition, format), later ones first in rank.
    labels: list[tuple[Column, str]]
    #: Units, from the smallest, of which the first break gets full if the span has no year, and none of the larger.
    first: tuple[str, ...] = ()
    full: str = ""
    ends: bool = False


def _years(f: Freq, span: int, at_year: Column, year: Column, label: str) -> Case:
    low, high = annual_spacing(span / _per_year(f))
    major = at_year & (F.pmod(year, F.lit(high)) == 0)
    return Case(major, at_year & (F.pmod(year, F.lit(low)) == 0), [(major, label)])


def _per_year(f: Freq) -> int:
    return 365 * PER_DAY[f.base] if f.base in PER_DAY else _PER_YEAR[f.base]


def _days(f: Freq, span: int) -> Case:
    t = F.col("val")
    year = _per_year(f)
    month = 28 * PER_DAY[f.base] if f.base in PER_DAY else _PER_MONTH[f.base]
    brk = lambda n: P.period_break(t, f, n)
    if span <= month:
        per = PER_DAY.get(f.base, 0)
        for part, unit, step in _WITHIN_DAY:
            if span < per / part:
                here = brk(unit) & (F.pmod(P.field(t, f, unit), F.lit(step)) == 0)
                clock = "%H:%M:%S" if unit == "second" else "%H:%M"
                above = {"second": "minute", "minute": "hour", "hour": "day"}[unit]
                return Case(brk(above), here, [(here, clock), (brk("day"), f"{clock}\n%d-%b"), (brk("year"), f"{clock}\n%d-%b\n%Y")], ("day",) if unit == "hour" and step >= 6 else (), f"{clock}\n%d-%b\n%Y")
        return Case(brk("month"), brk("day"), [(brk("day"), "%d"), (brk("month"), "%d\n%b"), (brk("year"), "%d\n%b\n%Y")], ("day", "month"), "%d\n%b\n%Y")
    if span <= year // 4:
        minor = brk("day") if f.base in PER_DAY else F.lit(True)
        return Case(brk("month"), minor, [(brk("week"), "%d"), (brk("month"), "\n\n%b"), (brk("year"), "\n\n%b\n%Y")], ("week", "month"), "\n\n%b\n%Y")
    if span <= 1.15 * year:
        return Case(brk("month"), brk("week") & ~brk("month") & ~brk("year"), [(brk("month"), "%b"), (brk("year"), "%b\n%Y")], ("month",), "%b\n%Y")
    if span <= 2.5 * year:
        return Case(brk("quarter"), brk("month"), [(brk("quarter"), "%b"), (brk("year"), "%b\n%Y")])
    if span <= 4 * year:
        return Case(brk("year"), brk("month") & ~brk("year"), [(brk("month") & P.field(t, f, "month").isin(1, 7), "%b"), (brk("year"), "%b\n%Y")])
    if span <= 11 * year:
        return Case(brk("year"), brk("quarter") & ~brk("year"), [(brk("year"), "%Y")])
    return _years(f, span, brk("year"), P.field(t, f, "year"), "%Y")


def _months(f: Freq, span: int) -> Case:
    t, on = F.col("val"), lambda n, k=1: F.pmod(F.col("val"), F.lit(n)) == k
    if span <= 1.15 * 12:
        return Case(on(12), F.lit(True), [(F.lit(True), "%b"), (on(12), "%b\n%Y")], ("second row",), "%b\n%Y")
    if span <= 4 * 12:
        steps = on(3) if span <= 2.5 * 12 else on(12) | on(12, 7)
        return Case(on(12), F.lit(True), [(steps, "%b"), (on(12), "%b\n%Y")])
    if span <= 11 * 12:
        return Case(on(12), on(3), [(on(12), "%Y")])
    return _years(f, span, on(12), F.floor(t / 12) + 1, "%Y")


def _quarters(f: Freq, span: int) -> Case:
    first = F.pmod(F.col("val"), F.lit(4)) == 1
    if span <= 3.5 * 4:
        return Case(first, F.lit(True), [(F.lit(True), "Q%q"), (first, "Q%q\n%F")], ("second row",), "Q%q\n%F")
    if span <= 11 * 4:
        return Case(first, F.lit(True), [(first, "%F")])
    return _years(f, span, first, F.floor(F.col("val") / 4) + 1, "%F")


def ticks(spark: SparkSession, start: int, end: int, freq) -> DataFrame:
    """A row for each period from start to end (annual: one more); fmt is the label, empty where there is none."""
    f = parse(freq)
    if f.base == "U":
        raise DateError("an undefined frequency has no dates")
    end = end + (f.base == "A")
    span, t = end - start + 1, F.col("val")
    rows = spark.range(start, end + 1).select(F.col("id").alias("val"))
    if f.base == "A":
        low, high = annual_spacing(span)
        major = F.pmod(t, F.lit(high)) == 0
        case = Case(major, F.pmod(t, F.lit(low)) == 0, [(major, "%Y")])
    else:
        case = _quarters(f, span) if f.base == "Q" else _months(f, span) if f.base == "M" else _days(f, span)
    major = case.major if f.base in "AQM" else case.major | t.isin(start, end)
    text = F.lit("")
    for cond, label in case.labels:
        text = F.when(cond, P.strftime(t, f, label)).otherwise(text)
    if case.first:
        year = F.pmod(t, F.lit({"M": 12, "Q": 4}[f.base])) == 1 if f.base in "MQ" else P.period_break(t, f, "year")
        if case.first == ("second row",):
            found = rows.agg(F.min(F.when(year, t)).alias("__year"), F.lit(min(start + 1, end)).cast("long").alias("__first"))
        else:
            breaks = [F.min(F.when(P.period_break(t, f, n), t)) for n in reversed(case.first)]
            found = rows.agg(F.min(F.when(year, t)).alias("__year"), F.coalesce(*breaks).alias("__first"))
        rows = rows.crossJoin(F.broadcast(found))  # one row
        text = F.when(F.col("__year").isNull() & (t == F.col("__first")), P.strftime(t, f, case.full)).otherwise(text)
    return rows.select("val", major.alias("maj"), case.minor.alias("min"), text.alias("fmt"))
