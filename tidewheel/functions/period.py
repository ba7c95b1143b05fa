"""The period calendar as Column expressions: a period is a BIGINT counted in a frequency's unit.

All are built-in functions, so they run inside generated code. Days count from 0001-01-01 as 1, sub-daily units from
1970-01-01 00:00. Weekend days become business days by the relation: Friday for START, Monday for END, and Friday for
both when a longer period is converted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.errors import DateError

from .freq import PER_DAY, Freq, parse

EPOCH = 719163
_EPOCH_DATE = "1970-01-01"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("long")


def date_to_days(date) -> Column:
    return (F.datediff(_c(date).cast("date"), F.lit(_EPOCH_DATE).cast("date")) + EPOCH).cast("long")


def days_to_date(days: Column) -> Column:
    return F.date_add(F.lit(_EPOCH_DATE).cast("date"), (days - EPOCH).cast("int"))


def _month_first(index: Column) -> Column:
    """First day of month year * 12 + month - 1."""
    return date_to_days(F.make_date(_div(index, 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1)))


def _seconds(ts: Column) -> Column:
    """Seconds since 1970 of a DATE, TIMESTAMP_NTZ or (session zone) TIMESTAMP."""
    ts = ts.cast("timestamp_ntz")
    return (date_to_days(ts) - EPOCH) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_days(days: Column, freq: Freq | str, relation: str = "END", friday: bool = False) -> Column:
    """Period of a day."""
    f = parse(freq)
    date = days_to_date(days)
    if f.base == "A":
        return (F.year(date) + (F.month(date) > f.anchor).cast("int")).cast("long")
    if f.base == "Q":
        return _div(F.year(date).cast("long") * 12 + F.month(date) - 1 + (12 - f.anchor) % 12 - 12, 3) + 1
    if f.base == "M":
        return (F.year(date).cast("long") - 1) * 12 + F.month(date)
    if f.base == "W":
        return _div(days - (1 + f.anchor), 7) + 1
    if f.base == "B":
        over = F.pmod(days - 1, F.lit(7)) - 4  # 1 on Saturday, 2 on Sunday
        day = F.when(over > 0, days - over if friday or relation == "START" else days + 3 - over).otherwise(days)
        return _div(day - 1, 7) * 5 + F.pmod(day - 1, F.lit(7)) + 1
    if f.base in PER_DAY:
        n = PER_DAY[f.base]
        return ((days - EPOCH) * n + (0 if relation == "START" else n - 1)).cast("long")
    return days.cast("long")


def start_days(t: Column, freq: Freq | str) -> Column:
    return _days(t, parse(freq), False)


def end_days(t: Column, freq: Freq | str) -> Column:
    return _days(t, parse(freq), True)


def _days(t: Column, f: Freq, end: bool) -> Column:
    if f.base in "AQM":
        n = {"A": 12, "Q": 3, "M": 1}[f.base]
        first = t * 12 - 12 + f.anchor if f.base == "A" else (t - 1) * 3 + 12 - (12 - f.anchor) % 12 if f.base == "Q" else t + 11
        return _month_first(first + n) - 1 if end else _month_first(first)
    if f.base == "W":
        return t * 7 + f.anchor - (0 if end else 6)
    if f.base == "B":
        return _div(t - 1, 5) * 7 + F.pmod(t - 1, F.lit(5)) + 1
    if f.base in PER_DAY:
        return _div(t, PER_DAY[f.base]) + EPOCH
    return t


def asfreq(t, source: Freq | str, target: Freq | str, relation: str = "END") -> Column:
    """The period of target at the START or END of a period of source."""
    t, a, b = _c(t), parse(source), parse(target)
    relation = {"BEFORE": "START", "AFTER": "END", "S": "START", "E": "END"}.get(relation.upper(), relation.upper())
    if relation not in ("START", "END"):
        raise DateError(f"unknown relation {relation!r}")
    if a == b:
        return t
    if a.base in PER_DAY and b.base in PER_DAY:
        x, y = PER_DAY[a.base], PER_DAY[b.base]
        return _div(t, x // y) if x >= y else t * (y // x) + (0 if relation == "START" else y // x - 1)
    day = _days(t, a, relation == "END")
    return from_days(day, b, relation, friday=a.base in "AQMW")


def to_period(ts, freq: Freq | str, relation: str = "END") -> Column:
    """The period that contains a date or timestamp."""
    f, ts = parse(freq), _c(ts)
    return _div(_seconds(ts), 86400 // PER_DAY[f.base]) if f.base in PER_DAY else from_days(date_to_days(ts), f, relation)


def start_timestamp(t, freq: Freq | str) -> Column:
    """First instant of a period as TIMESTAMP_NTZ."""
    f, t = parse(freq), _c(t)
    if f.base in PER_DAY:
        s = t * (86400 // PER_DAY[f.base])
        return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    return days_to_date(start_days(t, f)).cast("timestamp_ntz")


def in_periods(ts, freq: Freq | str, first, last) -> Column:
    """ts lies in periods first to last (literals): the condition is on the raw column, so it reaches the Parquet scan."""
    f = parse(freq)
    return (_c(ts) >= start_timestamp(F.lit(int(first)).cast("long"), f)) & (_c(ts) < start_timestamp(F.lit(int(last) + 1).cast("long"), f))


def end_date(t, freq: Freq | str) -> Column:
    """Last day of a period: what fields are read from."""
    return days_to_date(end_days(_c(t), parse(freq)))


def field(t, freq: Freq | str, name: str) -> Column:
    """year qyear quarter month week day day_of_week day_of_year hour minute second of the period's last instant."""
    f, t = parse(freq), _c(t)
    name = {"weekday": "day_of_week", "years": "year", "quarters": "quarter", "months": "month", "weeks": "week", "days": "day", "yearday": "day_of_year", "hours": "hour", "minutes": "minute", "seconds": "second", "qyears": "qyear"}.get(name, name)
    date = end_date(t, f)
    if name in ("quarter", "qyear") and f.base == "Q":
        return (F.pmod(t - 1, F.lit(4)) + 1).cast("int") if name == "quarter" else (_div(t - 1, 4) + 1 - int(f.start_based and f.anchor != 12)).cast("int")
    per = PER_DAY.get(f.base, 1)
    second = F.pmod(t, F.lit(per)) * (86400 // per) if f.base in PER_DAY else F.lit(0)
    made = {
        "year": lambda: F.year(date), "qyear": lambda: F.year(date), "quarter": lambda: F.quarter(date), "month": lambda: F.month(date), "week": lambda: F.weekofyear(date), "day": lambda: F.dayofmonth(date),
        "day_of_week": lambda: F.weekday(date), "day_of_year": lambda: F.dayofyear(date), "hour": lambda: _div(second, 3600).cast("int"), "minute": lambda: F.pmod(_div(second, 60), F.lit(60)).cast("int"), "second": lambda: F.pmod(second, F.lit(60)).cast("int"),
    }
    if name not in made:
        raise DateError(f"unknown field {name!r}")
    return made[name]()


def toordinal(t, freq: Freq | str) -> Column:
    return end_days(_c(t), parse(freq)).cast("long")


_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD"}


def strftime(t, freq: Freq | str, fmt: str) -> Column:
    """C directives, and %q quarter, %f / %F fiscal year of two / four digits. English names."""
    f, t = parse(freq), _c(t)
    date, parts, text = end_date(t, f), [], ""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    get = lambda n: field(t, f, n)
    special = {
        "q": lambda: get("quarter").cast("string"), "F": lambda: F.lpad(get("qyear").cast("string"), 4, "0"), "f": lambda: two(F.pmod(get("qyear"), F.lit(100))), "H": lambda: two(get("hour")), "M": lambda: two(get("minute")), "S": lambda: two(get("second")),
        "I": lambda: two(F.pmod(get("hour") + 11, F.lit(12)) + 1), "p": lambda: F.when(get("hour") < 12, "AM").otherwise("PM"), "w": lambda: (F.pmod(F.weekday(date) + 1, F.lit(7))).cast("string"),
        "U": lambda: two(_div(F.dayofyear(date) + 6 - F.pmod(F.weekday(date) + 1, F.lit(7)), 7)), "W": lambda: two(_div(F.dayofyear(date) + 6 - F.weekday(date), 7)), "c": lambda: strftime(t, f, "%a %b %d %H:%M:%S %Y"), "x": lambda: strftime(t, f, "%m/%d/%y"), "X": lambda: strftime(t, f, "%H:%M:%S"), "Z": lambda: F.lit(""),
    }
    i = 0
    while i < len(fmt):
        c, n = fmt[i], fmt[i + 1 : i + 2]
        if c != "%" or not n or n == "%":
            text += c
            i += 1 + (c == "%" and n == "%")
            continue
        if text:
            parts.append(F.lit(text))
            text = ""
        if n in _DIRECTIVES:
            parts.append(F.date_format(date, _DIRECTIVES[n]))
        elif n in special:
            parts.append(special[n]())
        else:
            raise DateError(f"unknown directive %{n}")
        i += 2
    if text:
        parts.append(F.lit(text))
    return F.concat(*parts) if parts else F.lit("")


def tostring(t, freq: Freq | str) -> Column:
    f, t = parse(freq), _c(t)
    fmt = {"A": "%Y", "Q": "%FQ%q", "M": "%b-%Y", "W": "%d-%b-%Y", "B": "%d-%b-%Y", "D": "%d-%b-%Y", "H": "%d-%b-%Y %H:00", "T": "%d-%b-%Y %H:%M", "S": "%d-%b-%Y %H:%M:%S"}.get(f.base)
    return strftime(t, f, fmt) if fmt else t.cast("string")


def tofloat(t, source: Freq | str, target: Freq | str) -> Column:
    """Periods as fractions of periods of a lower frequency; to the same or a higher one the number itself."""
    a, b, t = parse(source), parse(target), _c(t)
    if b.rank >= a.rank:
        return asfreq(t, a, b).cast("double")
    date = end_date(t, a)
    days = lambda: F.when(isleapyear(F.year(date)), 366).otherwise(365)
    if b.base == "A" and a.base == "Q":
        return field(t, a, "qyear") + (field(t, a, "quarter") - 1) / F.lit(4.0)
    if b.base == "A" and a.base == "M":
        return F.year(date) + (F.month(date) - 1) / F.lit(12.0)
    if b.base == "A" and a.base == "D":
        return F.year(date) + (F.dayofyear(date) - 1) / days().cast("double")
    if b.base == "M" and a.base == "D":
        return asfreq(t, a, b) + (F.dayofmonth(date) - 1) / F.dayofmonth(F.last_day(date)).cast("double")
    raise DateError(f"no conversion of {a} to fractions of {b}")


def isleapyear(year) -> Column:
    y = _c(year)
    return (F.pmod(y, F.lit(400)) == 0) | ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0))


def period_break(t, freq: Freq | str, name: str) -> Column:
    """The field differs from that of the period before: no window is needed."""
    return field(t, freq, name) != field(_c(t) - 1, freq, name)


def now(freq: Freq | str) -> Column:
    return to_period(F.localtimestamp(), freq)


def prevbusday(day_end_hour: int = 18, day_end_min: int = 0, at: Column | None = None) -> Column:
    """The last business day that has ended: before the cut-off yesterday's, on weekends Friday."""
    at = F.localtimestamp() if at is None else at
    early = F.hour(at) * 60 + F.minute(at) < day_end_hour * 60 + day_end_min
    b = to_period(at, "B", "START")
    return F.when(early & (F.weekday(at) < 5), b - 1).otherwise(b)


FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy", "d-MMM-yyyy", "d-MMM-yyyy HH:mm:ss", "dd/MM/yyyy")


def parse_date(text, formats=FORMATS) -> Column:
    """TIMESTAMP_NTZ of a string in the first format that fits; null if none does. Month names are read in any case."""
    s = F.initcap(F.trim(_c(text)))
    s = F.regexp_replace(s, "(?<=\\d)t(?=\\d)", "T")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in formats])


def string_to_period(text, freq: Freq | str) -> Column:
    return to_period(parse_date(text), freq)


def date(freq: Freq | str, value: int | None = None, string: str | None = None, year: int | None = None, quarter: int | None = None, month: int | None = None, day: int | None = None, hour: int = 0, minute: int = 0, second: int = 0) -> Column:
    """A literal period from a number, a string, or the parts its unit needs."""
    from tidewheel.errors import InsufficientDateError

    f = parse(freq)
    if value is not None:
        return F.lit(int(value)).cast("long")
    if string is not None:
        return string_to_period(F.lit(string), f)
    need = {"A": [year], "Q": [year, quarter], "M": [year, month]}.get(f.base, [year, month, day])
    if any(x is None for x in need):
        raise InsufficientDateError(f"{f} needs more parts")
    if f.base == "A":
        return F.lit(year).cast("long")
    if f.base == "Q":
        return F.lit((year + (f.start_based and f.anchor != 12) - 1) * 4 + quarter).cast("long")
    return to_period(F.lit(f"{year:04d}-{month:02d}-{day or 1:02d} {hour:02d}:{minute:02d}:{second:02d}").cast("timestamp_ntz"), f)
