"""Exact top-k search by inner product over an impact-ordered index, score-at-a-time.

Components are integers. A block of vectors is indexed by segments of postings: those whose |impact| falls in one
quantisation level, the highest level first, each as a list of vectors and impacts for every dimension, with the norm of
what each vector still has below that level. A level that holds most components of its block is kept as a matrix, which
is the shorter form. A batch of queries is scored segment by segment; after each, query norm times remaining norm bounds
what is missing (Cauchy-Schwarz), so a vector is out as soon as its upper bound is below the k-th best lower bound. A
query stops only when no more than the possible members are left, and those are rescored exactly from whole vectors.

Index blocks stay where they are; query blocks, which are fewer, are copied to each of them: an equi-join on block
numbers, of a stated query set with all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read

QUERY_ROWS, INDEX_ROWS = 512, 8192
#: Levels begin at these parts of the largest impact; part of the components from which a level is a matrix.
LEVELS, DENSE = (1 / 2, 1 / 4, 1 / 8), 1 / 4
_RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v = floor(scale * component); rows null, or with null, NaN or infinite components, or without a vec_id, go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.forall("__x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select("vec_id", x.alias("__x")).where(F.col("vec_id").isNotNull() & F.col("__x").isNotNull() & ok)
    return rows.select("vec_id", F.transform("__x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


class Index:
    """Posting segments of one block of integer vectors (rows), and bounds on what follows each segment."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: Sequence[float] = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        size = np.abs(self.rows)
        top = int(size.max(initial=0))
        self.segments, self.left, high = [], [], top + 1
        for cut in [*sorted({int(top * x) + 1 for x in levels} - {1, top + 1}, reverse=True), 1]:
            inside = (size >= cut) & (size < high)
            self.segments.append(np.where(inside, self.rows, 0) if inside.sum() > DENSE * size.size else self.postings(inside))
            self.left.append(np.sqrt((np.where(size < cut, self.rows, 0).astype(float) ** 2).sum(1)))
            high = cut
        #: (query, segment) pairs scored, and those that a query without early stop would take.
        self.done = self.all = 0

    def postings(self, inside: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each dimension that has any: the vectors, and their impacts."""
        dim, at = np.nonzero(inside.T)
        cuts = np.searchsorted(dim, np.arange(inside.shape[1] + 1))
        return [(d, at[a:b], self.rows[at[a:b], d]) for d, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(vec_ids, scores) of each query's best k, its own id left out."""
        big = int(np.abs(queries).max(initial=0)) * int(np.abs(self.rows).max(initial=0)) * max(1, self.rows.shape[1])
        kind = np.float32 if big < 1 << 24 else np.float64 if big < 1 << 53 else np.int64
        norm = np.sqrt((queries.astype(float) ** 2).sum(1))
        q, found = np.ascontiguousarray(queries.T.astype(kind)), [None] * len(ids)  # a column a query, as in score
        score, open_ = np.zeros((len(self.ids), len(ids)), kind), np.arange(len(ids))
        self.all += len(ids) * len(self.segments)
        for s, (part, left) in enumerate(zip(self.segments, self.left)):
            self.done += len(open_)
            if isinstance(part, np.ndarray):
                score += part.astype(kind) @ q
            else:
                for d, at, impact in part:
                    score[at] += impact.astype(kind)[:, None] * q[d]
            rest = []
            for c, i in enumerate(open_.tolist()):
                lo = hi = score[:, c]
                if norm[i] * left.max(initial=0) > 0:
                    slack = norm[i] * left * (1 + 1e-9)
                    lo, hi = lo - slack, hi + slack
                keep = self.members(lo, hi, ids[i], k)
                if s + 1 < len(self.segments) and len(keep) > max(4 * k, len(self.ids) // 64):
                    rest.append(c)
                    continue
                exact = self.rows[keep] @ queries[i]
                best = np.lexsort((self.ids[keep], -exact))[:k]
                found[i] = (self.ids[keep][best], exact[best])
            if not rest:
                break
            if len(rest) < len(open_):
                open_, q, score = open_[rest], q[:, rest], score[:, rest]
        return found

    def members(self, lo: np.ndarray, hi: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows that may be among the best k: all whose upper bound reaches the k-th best lower bound."""
        other = self.ids != own
        if k < int(other.sum()):
            low = np.where(other, lo, -np.inf)
            other &= hi >= np.partition(low, -k)[-k]
        return np.flatnonzero(other)


def _blocked(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """Blocks of about n rows: no (block number), ids and vectors packed as bytes, width of the widest vector."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= n:
                yield block(ids[:n], rows[:n])
                ids, rows = ids[n:], rows[n:]
        if ids:
            yield block(ids, rows)

    def block(ids, rows):
        width = max(map(len, rows))
        flat = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            flat[i, : len(r)] = r
        small = flat.astype(np.int16)
        data = b"s" + small.tobytes() if (small == flat).all() else b"l" + flat.tobytes()
        return pa.record_batch([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([width], pa.int32())], [f"{kind}_ids", f"{kind}_rows", f"{kind}_width"])

    return rows.mapInArrow(packed, f"{kind}_ids binary, {kind}_rows binary, {kind}_width int")


def _unpacked(ids: bytes, data: bytes, width: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    rows = np.frombuffer(data, np.int16 if data[:1] == b"s" else np.int64, offset=1).reshape(len(ids), width).astype(np.int64)
    return ids, np.pad(rows, ((0, 0), (0, to - width)))


def top_k(vectors: DataFrame, is_query, k: int = 20, query_rows: int = QUERY_ROWS, index_rows: int = INDEX_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for each query row; ties to smaller ids.

    vectors: vec_id, v (long array); shorter vectors count as padded with zeros. Fewer than k others give all of them;
    rows repeated under one vec_id are candidates each, but none for queries of that id. Empty tables give no rows.
    """
    n, m = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    parts, q_parts = max(1, -(-n // index_rows)), max(1, -(-m // query_rows))
    # whole blocks a task: rows are dealt round so that every task has about as many
    index = _blocked(vectors.select("vec_id", "v").repartition(parts), index_rows, "i").withColumn("no", F.spark_partition_id())
    queries = _blocked(vectors.where(is_query).select("vec_id", "v").repartition(q_parts), query_rows, "q")
    copies = queries.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(batches):
        last, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                width = max(r["i_width"], r["q_width"])
                if last != (r["no"], r["i_ids"], width):  # the same for all query blocks that follow
                    last, index = (r["no"], r["i_ids"], width), Index(*_unpacked(r["i_ids"], r["i_rows"], r["i_width"], width))
                ids, rows = _unpacked(r["q_ids"], r["q_rows"], r["q_width"], width)
                found = index.search(ids, rows, k)
                of = np.repeat(ids, [len(f[0]) for f in found])
                yield pa.record_batch([pa.array(of), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    # as many tasks as index blocks, however small: the work is in the products
    pairs = index.repartition(parts, "no").join(copies.repartition(parts, "no").hint("shuffle_hash"), "no").select("no", "i_ids", "i_rows", "i_width", "q_ids", "q_rows", "q_width")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.mapInArrow(search, _RESULT).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return top_k(quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


OP10_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
