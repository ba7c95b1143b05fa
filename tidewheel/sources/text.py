"""Series from and to delimited text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.errors import deprecated_for
from tidewheel.functions import period as P
from tidewheel.functions.freq import parse
from tidewheel.operators.core import freq_of, values_of, with_freq

_DATES = re.compile(r"_?dates?$", re.I)
#: Reserved names and deleted characters (fixed values).
_RESERVED = {"return", "file", "print"}
DELETED = "~!@#$%^&*()-=+~\\|]}[{';: /?.>,<\"'"


def valid_names(names: Sequence[str], exclude: Sequence[str] = (), delete: str = DELETED, case: str | None = None, default: str = "f%i") -> list[str]:
    """Trimmed, blanks to _, odd characters out, reserved names with _, empty ones numbered, repeats suffixed."""
    out, seen = [], {}
    for i, n in enumerate(names):
        n = "".join(c for c in n.strip().replace(" ", "_") if c not in delete) or default % i
        n = n.upper() if case == "upper" else n.lower() if case == "lower" else n
        n += "_" * (n in _RESERVED or n in exclude)
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def split_line(line: Column, delimiter: str | int | Sequence[int] | None = None, comments: str = "#", strip: bool = True) -> Column:
    """Cells of a line: by a string, white space (None), a width, or a list of widths."""
    s = F.substring_index(line, comments, 1) if comments else line
    if delimiter is None:
        cells = F.split(F.trim(s), r"\s+")
    elif isinstance(delimiter, str):
        cells = F.split(s, re.escape(delimiter))
    else:
        if isinstance(delimiter, int):
            cells = F.regexp_extract_all(s, F.lit(f"(.{{1,{delimiter}}})"), F.lit(1))
        else:
            at, parts = 1, []
            for w in delimiter:
                parts.append(F.substring(s, at, w))
                at += w
            cells = F.array(*parts)
    return F.transform(cells, lambda c: F.trim(c))  # not F.trim itself: it would take the index as what to trim if strip else cells


#: Cells that are missing values by themselves.
MISSING = ("N/A", "NA", "nan", "--")


def typed(cell: Column, kind: str, missing: Sequence[str] = (), filling=None, loose: bool = True) -> Column:
    """A cell as a type; missing strings and blanks are null (or the filling); loose: so is what can't be read."""
    c = F.when((F.trim(cell) != "") & ~F.trim(cell).isin(*MISSING, *missing), F.trim(cell))
    v = c if kind == "string" else c.try_cast(kind) if loose else c.cast(kind)
    return v if filling is None else F.coalesce(v, F.lit(filling).cast(kind))


def guess_type(df: DataFrame, column: str) -> str:
    """The first of boolean, bigint, double, string that reads every cell: one aggregate over the column."""
    c = F.trim(F.col(column))
    c = F.when((c != "") & ~c.isin(*MISSING), c)
    row = df.agg(*[F.bool_and(c.isNull() | c.try_cast(k).isNotNull()).alias(k) for k in ("boolean", "bigint", "double")]).first()
    return next((k for k in ("bigint", "double", "boolean") if row[k] is True), "string")


def from_text(
    spark: SparkSession, path: str | Sequence[str], freq, delimiter=",", comments: str = "#", skip_header: int = 0, skip_footer: int = 0, names: Sequence[str] | bool | None = None, types: Mapping[str, str] | None = None, datecols: Sequence[int | str] | int | str | None = None,
    dateconverter: Callable[..., Column] | None = None, usecols: Sequence[int | str] | None = None, missing_values: Sequence[str] | Mapping[str, Sequence[str]] = (), filling_values: Mapping[str, object] | None = None, converters: Mapping[str, Callable[[Column], Column]] | None = None, invalid_raise: bool = True, loose: bool = True, exclude: Sequence[str] = (), case: str | None = None,
) -> DataFrame:
    """A series from text (compressed by extension too). Date columns are named, numbered (negative from the end), or
    those called date(s); the converter gets their cells, by default the first is read as a date. Lines of a wrong
    width raise when read, or are left out. Types that aren't given are found by one pass over the column."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("__pos"), F.substring_index("value", comments, 1).alias("value") if comments else "value").where("trim(value) <> ''")
    head = [r.value for r in lines.orderBy("__pos").limit(skip_header + 1).collect()]
    cut = skip_header + (names is True)
    for n, order in ((cut, F.col("__pos")), (skip_footer, F.desc("__pos"))):
        if n:
            gone = [r[0] for r in lines.select("__pos").orderBy(order).limit(n).collect()]
            lines = lines.where(~F.col("__pos").isin(gone))
    cells = lines.select("__pos", split_line(F.col("value"), delimiter, "").alias("c"))
    first = head[skip_header] if len(head) > skip_header else ""
    raw = spark.createDataFrame([(first,)], "v string").select(split_line(F.col("v"), delimiter, "")).first()[0] if first else []
    width = len(raw)
    titles = [x.strip("'\" ") for x in raw] if names is True else list(names) if names else [""] * width
    if usecols is not None and len(titles) < width:
        full = [""] * width
        for u, n in zip(usecols, titles):
            full[u] = n
        titles = full
    titles = valid_names(titles, exclude, case=case)
    if len(titles) < width:
        titles += [f"f{i}" for i in range(len(titles), width)]
    wrong = F.size("c") != width
    cells = cells.withColumn("c", F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of columns: "), F.array_join("c", "|"))).cast("array<string>")).otherwise(F.col("c"))) if invalid_raise else cells.where(~wrong)
    table = cells.select("__pos", *[F.get("c", i).alias(n) for i, n in enumerate(titles)])
    index = lambda u: titles[u] if isinstance(u, int) else u
    if datecols is None:
        found = [n for n in titles if _DATES.fullmatch(n)]
    else:
        found = [index(u) for u in (datecols if isinstance(datecols, (list, tuple)) else [datecols])]
    make = dateconverter or (lambda *c: P.string_to_period(c[0], freq))
    keep = [n for n in ([index(u) for u in usecols] if usecols is not None else titles) if n not in found]
    cols = []
    for n in keep:
        gone = missing_values.get(n, ()) if isinstance(missing_values, Mapping) else missing_values
        if converters and n in converters:
            cols.append(converters[n](F.col(n)).alias(n))
        else:
            kind = (types or {}).get(n) or guess_type(table.select(F.when(~F.col(n).isin(*gone), F.col(n)).alias(n)) if gone else table, n)
            cols.append(typed(F.col(n), kind, tuple(map(str, gone)), (filling_values or {}).get(n), loose).alias(n))
    t = make(*[F.col(n) for n in found]).cast("long") if found else F.col("__pos").cast("long")
    return with_freq(table.select(t.alias("t"), *cols), parse(freq))


def to_text(df: DataFrame, path: str, separator: str = "\t", precision: int | None = None, header: bool = False, compression: str | None = None) -> None:
    """A line for each date: the formatted date and the values; missing values are --."""
    f = freq_of(df)
    cell = lambda c, k: F.coalesce(F.format_number(c, precision) if precision is not None and k in ("double", "float") else F.col(c).cast("string"), F.lit("--"))
    kinds = dict(df.dtypes)
    names = values_of(df, ())
    df.sort("t").select(P.tostring("t", f).alias("dates"), *[cell(c, kinds[c]).alias(c) for c in names]).write.option("sep", separator).option("header", header).option("compression", compression or "none").csv(path)


@deprecated_for("from_text")
def from_text_file(spark: SparkSession, path: str, freq, **how) -> DataFrame:
    return from_text(spark, path, freq, **how)


# schemas of records


def str2bool(text: str) -> bool:
    """TRUE or FALSE in any case; anything else is an error."""
    found = {"TRUE": True, "FALSE": False}.get(text.strip().upper())
    if found is None:
        raise ValueError(f"not a boolean: {text!r}")
    return found


def easy_schema(kinds: str | Sequence[str], names: Sequence[str] | str | None = None, default: str = "f%i", **how) -> T.StructType:
    """A schema from types (a DDL string with or without names, or a list of them) and names, which are made valid."""
    if isinstance(names, str):
        names = names.split(",")
    parts = re.findall(r"(?:[^,<(]|<[^>]*>|\([^)]*\))+", kinds) if isinstance(kinds, str) else list(kinds)
    named = [re.match(r"\s*(\w+)\s*[: ]\s*(\w.*)", p, re.S) for p in parts]
    found = [m[1] if m else "" for m in named]
    types = [T.StructType.fromDDL(f"x {m[2] if m else p.strip()}")[0].dataType for m, p in zip(named, parts)]
    if names is not None:
        found = [*names, *[""] * (len(types) - len(names))][: len(types)]
    return T.StructType([T.StructField(n, k) for n, k in zip(valid_names(found, default=default, **how), types)])


def has_nested_fields(schema: T.StructType) -> bool:
    return any(isinstance(f.dataType, T.StructType) for f in schema.fields)


def flat_types(schema: T.StructType) -> list[T.DataType]:
    """Types of the leaves, in order."""
    return [t for f in schema.fields for t in (flat_types(f.dataType) if isinstance(f.dataType, T.StructType) else [f.dataType])]
