"""What the operators of this subpackage share: inputs, written intermediate tables, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the mixing and near-duplicate contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset, which only a
    local session may do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Keys of at most so many rows are broadcast (some 16 bytes each); more are joined by shuffle.
FEW = 500_000


def few(keys: DataFrame, most: int | None = None) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= (FEW if most is None else most) else keys


def text_hash() -> Column:
    """With the doc_id it tells a row from others, but for repeated ones."""
    return F.xxhash64("text")


def without(docs: DataFrame, marks: DataFrame, most: int | None = None) -> DataFrame:
    """docs less the rows of marks(doc_id, th, stays, n) that don't stay. Of rows alike in doc_id and text_hash that stay,
    n of them, one stays: the first of their JSON. Only where marks are many are texts moved for it."""
    keyed = docs.withColumn("__th", text_hash())
    keys = marks.select(F.col("doc_id").alias("__id"), F.col("th").alias("__h"), "stays", "n")
    ok = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h"))
    out = keyed.join(few(keys.where("NOT stays").select("__id", "__h"), most), ok, "left_anti")
    again = keys.where("stays AND n > 1").select("__id", "__h")
    if again.limit(1).count():
        again = few(again, most)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = out.join(again, ok, "left_semi").groupBy("doc_id", "__th").agg(F.min_by(row, F.to_json(row)).alias("__row"))
        out = out.join(again, ok, "left_anti").select(*docs.columns).unionByName(one.select("__row.*"))
    return out.select(*docs.columns)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null is empty. Pure ASCII takes the fast path of lower()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with about so many bytes of text each (one text at least), with their texts; null is empty."""
    text = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
    start = total = 0
    for i, n in enumerate([*sizes, chars + 1]):
        if i > start and total + n > chars:
            yield batch.slice(start, i - start), pa.compute.fill_null(text.slice(start, i - start), "")
            start, total = i, 0
        total += n


def spans(batch: pa.RecordBatch, column: str, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """slices() with their texts as a list."""
    for part, text in slices(batch, column, chars):
        yield part, text.to_pylist()


#: What a worker keeps from task to task, by name: a function that lets go of it.
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, let_go: Callable[[], None]) -> None:
    _kept[name] = let_go


def only_keep(name: str) -> None:
    """Lets go of what tasks of other kinds kept."""
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """df.mapInArrow(run, schema), after which a worker gives its free memory back: workers outlive tasks and stages.
    keeps: the name of what run keeps from task to task; tasks of other kinds let go of it."""

    def released(batches):
        only_keep(keeps)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return df.mapInArrow(released, schema)
