"""Frequencies: a base unit, the month or weekday it closes on, and for quarters whether they are labelled by their start."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

from tidewheel.errors import DateError

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
WEEKDAYS = "SUN MON TUE WED THU FRI SAT".split()
_CODES = {"A": 1000, "Q": 2000, "M": 3000, "W": 4000, "B": 5000, "D": 6000, "H": 7000, "T": 8000, "S": 9000, "U": -10000}
_UNITS = {
    "A": "A Y ANN ANNUAL ANNUALLY YR YEAR YEARLY",
    "Q": "Q QTR QUARTER QUARTERLY Q-E QTR-E QUARTER-E QUARTERLY-E",
    "Q-S": "Q-S QTR-S QUARTER-S QUARTERLY-S",
    "M": "M MTH MONTH MONTHLY",
    "W": "W WK WEEK WEEKLY",
    "B": "B BUS BUSINESS BUSINESSLY",
    "D": "D DAY DLY DAILY",
    "H": "H HR HOUR HRLY HOURLY",
    "T": "T MIN MINUTE MINUTELY",
    "S": "S SEC SECOND SECONDLY",
    "U": "U UND UNDEF UNDEFINED",
}
#: Sub-units of a day.
PER_DAY = {"H": 24, "T": 1440, "S": 86400}
_ORDER = {b: i for i, b in enumerate("AQMWBDHTS")}


@dataclass(frozen=True)
class Freq:
    base: str
    #: Closing month 1-12 of A and Q, closing weekday 0 (Sunday) - 6 of W; else 0.
    anchor: int = 0
    start_based: bool = False

    @property
    def code(self) -> int:
        if self.base == "Q":
            return 2000 + self.anchor % 12 + 12 * self.start_based
        return _CODES[self.base] + (self.anchor % 12 if self.base == "A" else self.anchor)

    @property
    def name(self) -> str:
        if self.base == "Q":
            return f"Q-{'S' if self.start_based else 'E'}-{MONTHS[self.anchor - 1]}"
        return f"A-{MONTHS[self.anchor - 1]}" if self.base == "A" else f"W-{WEEKDAYS[self.anchor]}" if self.base == "W" else self.base

    @property
    def rank(self) -> int:
        """Finer units have higher ranks; undefined counts as days."""
        return _ORDER.get(self.base, _ORDER["D"])

    @property
    def group(self) -> int:
        return self.code // 1000 * 1000

    def __str__(self) -> str:
        return self.name


@cache
def aliases() -> dict[str, Freq]:
    out = {}
    for unit, names in _UNITS.items():
        for n in names.split():
            if unit in ("A", "Q", "Q-S"):
                f = Freq(unit[0], 12, unit == "Q-S")
                out[n] = f
                out |= {f"{n}-{m}": replace(f, anchor=i + 1) for i, m in enumerate(MONTHS)}
                if unit == "A":
                    out |= {f"{n}-{full}": replace(f, anchor=i + 1) for i, full in enumerate("JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split())}
            elif unit == "W":
                out[n] = Freq("W", 0)
                out |= {f"{n}-{d}": Freq("W", i) for i, d in enumerate(WEEKDAYS)}
                out |= {f"{n}-{d}": Freq("W", i) for i, d in enumerate("SUNDAY MONDAY TUESDAY WEDNESDAY THURSDAY FRIDAY SATURDAY".split())}
            else:
                out[n] = Freq(unit)
    return out


@cache
def _by_code() -> dict[int, Freq]:
    return {f.code: f for f in aliases().values()}


def parse(spec: Freq | str | int | None) -> Freq:
    """A frequency from its name (any case), alias, code or None (undefined)."""
    if isinstance(spec, Freq):
        return spec
    found = Freq("U") if spec is None else _by_code().get(spec) if isinstance(spec, int) else aliases().get(spec.strip().upper())
    if found is None:
        raise DateError(f"unknown frequency {spec!r}")
    return found


def check_freq(spec) -> int:
    return parse(spec).code


def check_freq_str(spec) -> str:
    return parse(spec).name


def get_freq_group(spec) -> int:
    return parse(spec).group


_WIDTH = {"Q": {"A": 4}, "M": {"A": 12, "Q": 3}, "W": {"A": 53, "Q": 14, "M": 5}, "B": {"A": 262, "Q": 66, "M": 23, "W": 5, "D": 1}, "D": {"A": 366, "Q": 92, "M": 31, "W": 7, "B": 1}}


def row_width(source: Freq, target: Freq, step: int = 1) -> int:
    """Cells of a row when periods of source are laid out by periods of target."""
    base = "D" if source.base in ("U", *PER_DAY) else source.base
    days = _WIDTH.get(base, {}).get(target.base, 1)
    if source.base in PER_DAY:
        days = PER_DAY[source.base] // PER_DAY[target.base] if target.base in PER_DAY and target.rank < source.rank else days * PER_DAY[source.base] if target.rank <= _ORDER["D"] else 1
    return -(-days // step)
