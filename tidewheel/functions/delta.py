"""Differences of dates: months, days and seconds; seconds carry into days, days never into months."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import period as P
from .freq import PER_DAY, parse


@dataclass(frozen=True)
class TimeDelta:
    months: int = 0
    days: int = 0
    seconds: int = 0

    def __post_init__(self):
        days, seconds = divmod(self.seconds, 86400)
        object.__setattr__(self, "days", self.days + days)
        object.__setattr__(self, "seconds", seconds)

    @classmethod
    def of(cls, unit: str, n: int) -> TimeDelta:
        """n periods of a unit."""
        base = parse(unit).base
        if base in "AQM":
            return cls(months=n * {"A": 12, "Q": 3, "M": 1}[base])
        if base in PER_DAY:
            return cls(seconds=n * (86400 // PER_DAY[base]))
        return cls(days=n * (7 if base == "W" else 1))

    def __add__(self, o: TimeDelta) -> TimeDelta:
        return TimeDelta(self.months + o.months, self.days + o.days, self.seconds + o.seconds)

    def __neg__(self) -> TimeDelta:
        return self * -1

    def __sub__(self, o: TimeDelta) -> TimeDelta:
        return self + -o

    def __mul__(self, n: int) -> TimeDelta:
        return TimeDelta(self.months * n, self.days * n, self.seconds * n)

    __rmul__ = __mul__

    @property
    def total_days(self) -> int:
        """A month counts as 30.4375 days."""
        return int(self.months * 30.4375) + self.days


def add(t, freq, delta: TimeDelta) -> Column:
    """Calendar arithmetic from the period's first instant: months clamp to the month's end, then days and seconds."""
    f = parse(freq)
    ts = P.start_timestamp(t, f)
    moved = F.add_months(ts.cast("date"), delta.months).cast("timestamp_ntz")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) + delta.seconds + delta.days * 86400
    return P.to_period(moved + F.make_dt_interval(secs=clock.cast("decimal(18,6)")), f)
