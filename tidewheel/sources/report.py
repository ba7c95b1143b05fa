"""Text reports: a line for each date, a column for each series."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import period as P
from tidewheel.operators.align import align_series
from tidewheel.operators.core import freq_of, values_of


def wrap_onspace(text: str, width: int, nls: str = "\n") -> str:
    """Lines broken at spaces; a longer word has its own line. nls separates lines, present ones too."""
    words = text.split(" ")
    out, room = words[0], len(words[0].rsplit(nls, 1)[-1])
    for word in words[1:]:
        parts = word.split(nls)
        broken = room + len(parts[0]) >= width
        out += (nls if broken else " ") + word
        room = len(parts[-1]) if len(parts) > 1 or broken else room + 1 + len(word)
    return out


def wrap_always(text: str, width: int, nls: str = "\n") -> str:
    return nls.join(text[i : i + width] for i in range(0, len(text), width))


def wrap_onspace_strict(text: str, width: int, nls: str = "\n") -> str:
    """As wrap_onspace, and words longer than a line are cut."""
    return wrap_onspace(re.sub(rf"\S{{{width},}}", lambda m: wrap_always(m[0], width, nls), text), width, nls)


def wrapped(width: int, kind: str = "onspace", nls: str = "\n") -> Callable[[Column], Column]:
    """The wrappers (onspace, strict, always) as functions of a column."""
    chunk = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1)), nls)
    if kind == "always":
        return chunk

    def onspace(c: Column) -> Column:
        if kind == "strict":  # a separator behind every full run that goes on
            c = F.regexp_replace(c, rf"(?<=(?<!\S)(?:\S{{{width}}}){{1,1000}})(?=\S)", nls)
        start = F.struct(F.lit(None).cast("string").alias("out"), F.lit(0).alias("room"))

        def add(s, word):
            last = F.length(F.substring_index(word, nls, -1))
            broken = s["room"] + F.length(F.substring_index(word, nls, 1)) >= width
            room = F.when(broken | F.contains(word, F.lit(nls)), last).otherwise(s["room"] + 1 + F.length(word))
            more = F.struct(F.concat(s["out"], F.when(broken, nls).otherwise(" "), word).alias("out"), room.alias("room"))
            return F.when(s["out"].isNull(), F.struct(word.alias("out"), last.alias("room"))).otherwise(more)

        return F.aggregate(F.split(c, " "), start, add)["out"]

    return onspace


def _each(spec, n: int, first=None) -> list:
    """One entry for the date column and each of n others: a list may leave out the first."""
    out = list(spec) if isinstance(spec, (list, tuple)) else [first if first is not None else spec, *[spec] * n]
    return [first, *out] if len(out) == n else out


def report(
    *series: DataFrame, header: Sequence[str] | None = None, header_char: str | None = "-", header_justify: str | Sequence[str] | None = None, row_char: str | None = None, footer: Callable[[Column], Column] | Sequence[Callable[[Column], Column] | None] | None = None, footer_char: str | None = "-", footer_label: str = "",
    justify: str | Sequence[str] | None = None, width: int | Sequence[int | None] | None = None, delim: str = " | ", prefix: str = "", postfix: str = "", mask_rep: str = "--", datefmt: str | None = None, fmt: Mapping[str, Callable[[Column], Column]] | Callable[[Column], Column] | None = None, wrap: Callable[[Column], Column] | Sequence[Callable[[Column], Column] | None] | None = None, fixed_width: bool = True, dates: tuple[int, int] | None = None,
) -> DataFrame:
    """section (0 header, 1 its separator, 2 dates, 3 separator, 4 footer), pos (the date), part and line, in that order.

    Series are aligned. fmt formats values (default: as text), wrap breaks cells into lines, footer aggregates columns.
    Columns are as wide as their widest line, and width at least; without fixed_width cells aren't padded. Headers
    stand left, dates and text left, other values right, unless told otherwise. Sorting is left to the reader.
    """
    df = align_series(*series, start=dates and dates[0], end=dates and dates[1]) if len(series) > 1 or dates else series[0]
    f, names = freq_of(df), values_of(df, ())
    kinds, n = dict(df.dtypes), len(names)
    sides = _each(justify, n, "left") if justify is not None else ["left", *("left" if kinds[c] == "string" else "right" for c in names)]
    head_sides = _each(header_justify, n, "left") if header_justify is not None else ["left"] * (n + 1)
    least, wraps = _each(width, n) if isinstance(width, (list, tuple)) else [width] * (n + 1), _each(wrap, n) if isinstance(wrap, (list, tuple)) else [wrap] * (n + 1)

    def text(name: str, c: Column) -> Column:
        g = fmt.get(name) if isinstance(fmt, Mapping) else fmt
        return F.coalesce((g(c) if g else c.cast("string")), F.lit(mask_rep))

    def row(section: int, cells: Sequence[Column]) -> list[Column]:
        return [F.lit(section).alias("section"), *[F.split(g(c) if g else c, "\n").alias(f"c{i}") for i, (c, g) in enumerate(zip(cells, wraps))]]

    date = P.strftime("t", f, datefmt) if datefmt else P.tostring("t", f)
    rows = df.select(F.col("t").alias("pos"), *row(2, [date, *[text(c, F.col(c)) for c in names]]))
    if header:
        titles = [""] * (n + 1 - len(header)) + list(header)
        rows = rows.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("long").alias("pos"), *row(0, [F.lit(x) for x in titles])))
    if footer:
        made = footer if isinstance(footer, (list, tuple)) else [footer] * n
        foot = df.agg(*[(g(F.col(c)) if g else F.lit(None)).alias(c) for c, g in zip(names, made)])
        rows = rows.unionByName(foot.select(F.lit(None).cast("long").alias("pos"), *row(4, [F.lit(footer_label), *[text(c, F.col(c)) if g else F.lit("") for c, g in zip(names, made)]])))
    cols = [f"c{i}" for i in range(n + 1)]
    sizes = rows.agg(F.max("pos").alias("last"), *[F.greatest(F.max(F.array_max(F.transform(c, F.length))), F.lit(w or 0)).alias(f"w_{c}") for c, w in zip(cols, least)])
    all_ = rows.crossJoin(F.broadcast(sizes))  # one row

    def pad(c: Column, w: Column, side: str) -> Column:
        if not fixed_width:
            return c
        before = F.floor((w - F.length(c)) / 2).cast("int") if side == "center" else w - F.length(c) if side == "right" else F.lit(0)
        return F.rpad(F.concat(F.repeat(F.lit(" "), before), c), w, " ")

    lines = all_.withColumn("z", F.arrays_zip(*cols)).select("section", "pos", "last", *[f"w_{c}" for c in cols], F.posexplode("z").alias("part", "z"))
    cell = lambda c, i: (lambda v: F.when(F.col("section") == 0, pad(v, F.col(f"w_{c}"), head_sides[i])).otherwise(pad(v, F.col(f"w_{c}"), sides[i])))(F.coalesce(F.col(f"z.{c}"), F.lit("")))
    line = F.concat(F.lit(prefix), F.concat_ws(delim, *[cell(c, i) for i, c in enumerate(cols)]), F.lit(postfix))
    out = lines.select("section", "pos", "part", line.alias("line"))
    rule = sum((F.col(f"w_{c}") for c in cols), F.lit(len(prefix) + len(postfix) + len(delim) * n))
    for section, char, there in ((1, header_char, header), (3, footer_char, footer)):
        if char and there:
            out = out.unionByName(sizes.select(F.lit(section).alias("section"), F.lit(None).cast("long").alias("pos"), F.lit(0).alias("part"), F.repeat(F.lit(char), rule).alias("line")))
    if row_char:
        most = F.greatest(*[F.size(c) for c in cols])
        out = out.unionByName(all_.where((F.col("section") == 2) & (F.col("pos") < F.col("last"))).select("section", "pos", most.alias("part"), F.repeat(F.lit(row_char), rule).alias("line")))
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """Lines in order, as text."""
    lines.sort("section", "pos", "part").select("line").write.text(path)
