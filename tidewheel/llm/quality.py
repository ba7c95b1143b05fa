"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a histogram of hashed byte pairs over its whole length, and shares of repeated words, capitals, digits and
symbols. The labelled sample's histograms, weighted by inverse document frequency, give a latent space by singular value
decomposition. Every document's vector is compared with all labelled vectors by exact cosine products, block by block;
the K most similar vote, weighted by similarity. Equal similarities count by the sample's order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, read, spans
from .learning import held_out, sample

#: Rows of either label at most; size of the histogram, of the latent space, and of the vote.
SAMPLE, BINS, LATENT, K, THRESHOLD = 2000, 2048, 48, 15, 0.3
_HASH = np.uint32(2654435761)


def histogram(text: str) -> np.ndarray:
    """Counts of hashed byte pairs, then shares that tell prose from junk."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(BINS + 8)
    if len(data) > 1:
        pairs = data[:-1].astype(np.uint32) << 8 | data[1:]
        out[:BINS] = np.bincount((pairs * _HASH) >> np.uint32(21), minlength=BINS)[:BINS]
    n = max(1, len(data))
    kinds = np.bincount(_KIND[data], minlength=5) / n
    words = text.split()
    distinct = len(set(words))
    follows = sum(a == b for a, b in zip(words, words[1:]))
    out[BINS:] = [*kinds, distinct / max(1, len(words)) ** 0.8, follows / max(1, len(words)), np.log1p(len(words)) / 10]
    return out


_KIND = np.full(256, 4, np.int64)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[128:] = 2
_KIND[ord("0") : ord("9") + 1] = 3


class Space:
    def __init__(self, idf: np.ndarray, axes: np.ndarray, spread: tuple[np.ndarray, np.ndarray], rows: np.ndarray, y: np.ndarray, weight: tuple[float, float]):
        self.idf, self.axes, self.spread, self.rows, self.y, self.weight = idf, axes, spread, rows, y, weight

    def latent(self, h: np.ndarray) -> np.ndarray:
        """Unit vectors: log counts by idf on the axes, then the shares on their own scale."""
        x = np.log1p(h[:, :BINS]) * self.idf
        x = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)
        v = np.column_stack([x @ self.axes * 4, (h[:, BINS:] - self.spread[0]) / self.spread[1]])
        return v / np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-12)

    def nearest(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines of the K most similar labelled rows; of equal cosines (to 12 digits) the first of the sample."""
        cosine = np.round(self.latent(h) @ self.rows.T, 12)
        k = min(K, len(self.y))
        best = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(self.y) else np.tile(np.arange(k), (len(h), 1))
        own = np.take_along_axis(cosine, best, 1)
        least = own.min(1, keepdims=True)
        for i in np.flatnonzero((cosine == least).sum(1) > (own == least).sum(1)):
            best[i] = np.argsort(-cosine[i], kind="stable")[:k]
        return best, np.take_along_axis(cosine, best, 1)

    def score(self, h: np.ndarray) -> np.ndarray:
        best, cosine = self.nearest(h)
        vote = (cosine + 1) ** 4 * np.where(self.y[best] == 1, self.weight[1], self.weight[0])
        return np.where(self.y[best] == 1, vote, 0).sum(1) / np.maximum(vote.sum(1), 1e-12)


def fit(texts: Sequence[str], y: np.ndarray, share: float) -> Space | float:
    """A space, or without both labels the share of label 1 as everyone's score."""
    if not 0 < y.sum() < len(y):
        return float(share)
    h = np.array([histogram(t) for t in texts])
    idf = np.log((1 + len(h)) / (1 + (h[:, :BINS] > 0).sum(0))) + 0.1
    x = np.log1p(h[:, :BINS]) * idf
    x = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)
    _, axes = np.linalg.eigh(x.T @ x)
    spread = (h[:, BINS:].mean(0), h[:, BINS:].std(0) + 1e-3)
    space = Space(idf, axes[:, ::-1][:, :LATENT].copy(), spread, np.zeros((0, 0)), y, (1.0, 1.0))
    space.rows = space.latent(h)
    ratio = share / (1 - share) / (y.sum() / (len(y) - y.sum()))
    space.weight = (1.0, float(ratio)) if ratio < 1 else (1 / float(ratio), 1.0)
    return space


def scored(docs: DataFrame, space: Space | float) -> DataFrame:
    """doc_id and score of every row; null is the empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(space if isinstance(space, float) else (space.idf, space.axes, space.spread, space.rows, space.y, space.weight))  # sized by SAMPLE, BINS and LATENT

    def run(batches):
        own = sent.value if isinstance(sent.value, float) else Space(*sent.value)
        for batch in batches:
            for part, texts in spans(batch, "text"):
                for i in range(0, len(texts), 256):
                    h = np.array([histogram(t) for t in texts[i : i + 256]])
                    s = np.full(len(h), own) if isinstance(own, float) else own.score(h)
                    yield pa.record_batch([part.column(0).slice(i, len(h)), pa.array(s, pa.float64())], ["doc_id", "score"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def trained(docs: DataFrame, labels: DataFrame) -> Space | float:
    return fit(*sample(docs, labels, "quality", 5, 0, SAMPLE))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
