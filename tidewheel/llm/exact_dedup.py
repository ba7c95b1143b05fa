"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so (after white space that follows one of a few letters and precedes another),
so equal passages give equal chunks wherever they stand. Chunks are deduplicated in their map task and once more by
identifier; the identifier is verified: no two different chunks may share it. A document is then the ordered list of
its chunk identifiers, and only these lists are compared and moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, ascii_lower, drop_written, read, text_hash, without, written

#: Least and most characters of a chunk; between them the content decides.
LEAST, MOST = 256, 4096
_CUT = r"(?s).{%d,%d}?(?<=[dehnrs][ \n,.])(?=[aeit])|.{1,%d}"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text cut by content; their concatenation is the text. An empty text has no chunk."""
    return F.regexp_extract_all(text, F.lit(_CUT % (least, most, most)), F.lit(0))


def recipes(docs: DataFrame, normalise=ascii_lower) -> DataFrame:
    """doc_id, th (text_hash), text_sha256, recipe (array of chunk identifiers). Identifiers are 128 bits of each chunk, or more where
    two chunks turn out to share them: see verified()."""
    text = docs.select("doc_id", text_hash().alias("th"), normalise(F.col("text")).alias("__t"))
    return text.select("doc_id", "th", F.sha2(F.col("__t").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("__t")), lambda c: F.unhex(F.md5(c.cast("binary")))).alias("recipe"))


def clashing(docs: DataFrame, normalise=ascii_lower) -> DataFrame:
    """Identifiers that stand for two different chunks: each distinct chunk moves once from a map task, its text with it."""
    distinct = docs.select(F.explode(chunks(normalise(F.col("text")))).alias("chunk")).select(F.unhex(F.md5(F.col("chunk").cast("binary"))).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


#: Recipes of groups of at most so many bytes together are broadcast.
FEW_BYTES = 16 << 20


def _grouped(docs: DataFrame, normalise, few_bytes: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """recipes() with keep (doc_id and th of the row that stays) and group_size; and the written tables under it.

    Recipes of single texts go no further than the aggregate. The groups of several are few or small enough to be
    broadcast, so that no row moves, or meet their rows by a join of two written tables, of which Spark splits hot keys.
    """
    bad = [r.id for r in clashing(docs, normalise).take(1)]
    rows = recipes(docs, normalise)
    if bad:  # never seen with 128 bits: the ordered list then carries the whole text's own digest too
        rows = rows.withColumn("recipe", F.concat("recipe", F.array(F.unhex("text_sha256"))))
    rows = written(rows, "recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "th")).alias("keep"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = written(groups, "groups")
    n, size = groups.agg(F.count(F.lit(1)), F.sum(F.size("recipe") * 16)).first()
    fits = n <= FEW and (size or 0) <= (FEW_BYTES if few_bytes is None else few_bytes)
    both = rows.join(F.broadcast(groups) if fits else groups, "recipe", "left").drop("recipe")
    return both.withColumns({"keep": F.coalesce("keep", F.struct("doc_id", "th")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))}), [rows, groups]


def exact_groups(docs: DataFrame, normalise=ascii_lower, few_bytes: int | None = None) -> DataFrame:
    """A row for every row of docs: doc_id, keep_id (largest doc_id of equal texts), group_size, kept, text_sha256.

    Null counts as empty; empty texts are equal to each other. A null doc_id is smaller than any other: it stays only
    where all of its group are null. Of repeated rows with the doc_id that stays, all are marked kept; deduplicated()
    keeps one. An empty table gives no rows.
    """
    rows, _ = _grouped(docs, normalise, few_bytes)
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, normalise=ascii_lower) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest doc_id; other columns untouched. Of
    several rows with that doc_id the one with the largest text_hash stays, of repeated ones the first of their JSON."""
    rows, under = _grouped(docs, normalise)
    rows = rows.where("group_size > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th"))
    marks = rows.select("doc_id", "th", stays.alias("stays")).groupBy("doc_id", "th").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = written(marks, "marks")
    for table in under:
        drop_written(table)
    return without(docs, marks)


def op4(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
