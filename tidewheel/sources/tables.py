"""Series as Parquet tables: frequency and timestep travel in the column's metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.core import numbered, values_of


def create_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None, step: int = 1, field: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows start to stop by step in date order; field: a column, _dates, _data, _mask, or everything."""
    df = spark.read.parquet(path)
    if field == "_dates":
        df = df.select(*keys, "t")
    elif field in ("_data", "_mask"):
        names = values_of(df, keys)
        df = df.select(*keys, "t", *([F.col(c).isNull().alias(c) for c in names] if field == "_mask" else names))
    elif field not in (None, "_series"):
        df = df.select(*keys, "t", field)
    if start is None and stop is None and step == 1:
        return df
    pos = F.col("pos")
    ok = (pos >= (start or 0)) & (F.pmod(pos - (start or 0), F.lit(step)) == 0)
    return numbered(df, keys).where(ok if stop is None else ok & (pos < stop)).drop("pos")


def read_coordinates(spark: SparkSession, path: str, at: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    return numbered(spark.read.parquet(path), keys).where(F.col("pos").isin(list(at))).drop("pos")


def tabulate(df: DataFrame, fill: float = 0, keys: Sequence[str] = ()) -> DataFrame:
    """_dates, then _data and _mask: flat for one value column, a struct for each of several."""
    names = values_of(df, keys)
    kinds = dict(df.dtypes)
    pair = lambda c: (F.coalesce(F.col(c), F.lit(fill).cast(kinds[c])).alias("_data"), F.col(c).isNull().alias("_mask"))
    if len(names) == 1:
        return df.select(*keys, F.col("t").alias("_dates"), *pair(names[0]))
    return df.select(*keys, F.col("t").alias("_dates"), *[F.struct(*pair(c)).alias(c) for c in names])


to_records = tabulate


def to_list(df: DataFrame, x: str) -> list[tuple]:
    """(period, value or None) pairs on the driver: for small series."""
    return [tuple(r) for r in df.sort("t").select("t", x).collect()]


def write_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    tabulate(df).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.select(F.col("_dates").cast("long").alias("t"), F.when(~F.col("_mask").cast("boolean"), F.col("_data")).alias("x"))


#: Where a row of a Parquet table stands: its file by name, its place in the file.
ROW = ("__file", "__row")

#: A path's scheme and the slashes after it, which Spark writes in two ways.
_ROOT = "^[^:/]*:/*"


def in_rows(spark: SparkSession, path: str, *columns) -> DataFrame:
    """Columns of a Parquet table, and ROW."""
    df = spark.read.parquet(path)
    files = sorted({re.sub(_ROOT, "", f) for f in df.inputFiles()}, key=unquote)
    out = df.select(*columns, F.regexp_replace("_metadata.file_path", _ROOT, "").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    if len(files) < 2:
        return out.withColumn("__file", F.lit(0)).drop("__path")
    names = spark.createDataFrame(list(enumerate(files)), "__file int, __path string")
    return out.join(F.broadcast(names), "__path", "left").drop("__path")
