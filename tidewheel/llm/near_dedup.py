"""Near-duplicate detection by DartMinHash signatures, banded joining and exact verification.

A text is the set (or the weighted set) of its shingles of five lower-cased words. Hashed darts are thrown at the plane
of every element: a dart lands at a weight and a rank, hits the element if its weight is no more than the element's, and
belongs to one of SLOTS coordinates; each coordinate keeps the dart of the earliest rank. Regions are dyadic, so a dart
is the same whatever text throws it, and a text of many shingles looks at few ranks. Two texts agree in a coordinate with
the probability of their (weighted) Jaccard similarity.

ROWS coordinates make a band; texts that agree in a band are candidates. Equal shingle sets are one node first. Buckets
of at most SMALL nodes give all their pairs. The nodes of larger ones are compared with LEADERS of them; where that
leaves several classes, the rest is found exactly by prefix shingles, so no link is lost and no bucket's pairs are all
made. Every candidate pair is verified on the whole shingle sets; classes are the connected components.

With weighting "count" an element's weight is how often the text has the shingle. Sets are then of shingles with the
number of their occurrence, whose Jaccard similarity is the weighted one of the counts, so the same checks hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, drop_written, few, in_arrow, read, spans, text_hash, without, written

SHINGLE, SIMILAR = 5, 0.8
ROWS, BANDS = 4, 20
SLOTS = ROWS * BANDS
SMALL, LEADERS = 24, 4
_FIRST = 0  # the first rank region ends at 2 ** -_FIRST; texts of a few hundred shingles mostly need no other
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 150_000:
            self.clear()
        out = self[w] = xxhash.xxh64_intdigest(w)
        return out


def shingles(texts: list[str], words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of each text's shingles, repeats included; a text of fewer words is one shingle, one without words none."""
    lists = [t.lower().split() for t in texts]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))
    upto = max(0, len(flat) - size + 1)
    with np.errstate(over="ignore"):
        every = mix(sum(flat[i : upto + i] * _ODD[i % SHINGLE] for i in range(size)))
        at = 0
        for ws in lists:
            n = len(ws)
            if n >= size:
                yield every[at : at + n - size + 1]
            elif n:
                yield mix(np.array([(flat[at : at + n] * _ODD[np.arange(n) % SHINGLE]).sum() + np.uint64(n)], np.uint64))
            else:
                yield flat[:0]
            at += n


_CDF: dict[float, np.ndarray] = {}


def _poisson(u: np.ndarray, area: float) -> np.ndarray:
    if area not in _CDF:
        p, total, out = np.exp(-area), 0.0, []
        for i in range(1, 16):
            total += p
            out.append(total)
            p *= area / i
        _CDF[area] = np.array(out)
    return np.searchsorted(_CDF[area], u, side="right")


def darts(elements: np.ndarray, weights: np.ndarray | None = None, slots: int = SLOTS) -> np.ndarray:
    """Signature of distinct elements: the earliest dart of each coordinate. Empty or weightless sets have zeros."""
    signature, ranks = np.zeros(slots, np.uint64), np.full(slots, np.inf)
    if weights is not None:
        elements, weights = elements[weights > 0], weights[weights > 0]
    if not len(elements):
        return signature
    with np.errstate(over="ignore"):
        region = 0
        while np.isinf(ranks).any():
            low, high = (0.0, 2.0**-_FIRST) if region == 0 else (2.0 ** (region - 1 - _FIRST), 2.0 ** (region - _FIRST))
            layer, base, top = 0, 0.0, 1.0
            while True:
                inside, ws = (elements, None) if weights is None else (elements[weights > base], weights[weights > base])
                if not len(inside):
                    break
                parts = max(1, int((high - low) * (top - base)))  # of unit area at most
                area = (high - low) * (top - base) / parts
                for first in range(0, parts, 64):  # a text of one shingle needs many ranks, but bounded arrays
                    cells = np.arange(first, min(parts, first + 64), dtype=np.uint64)
                    seed = mix(cells + np.uint64((region * 64 + layer) << 32))
                    cell = mix(inside[:, None] ^ seed[None, :])
                    count = _poisson(uniform(cell), area)
                    if not count.any():
                        continue
                    i, c = np.nonzero(count)
                    many = count[i, c]
                    each = np.repeat(np.arange(len(i)), many)
                    nth = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                    dart = mix(cell[i, c][each] + (nth.astype(np.uint64) + np.uint64(1)) * _M2)
                    rank = low + (high - low) * (cells[c][each].astype(float) + uniform(mix(dart ^ _M1))) / parts
                    if ws is not None:
                        hit = base + (top - base) * uniform(mix(dart ^ _GOLD)) <= ws[i][each]
                        dart, rank = dart[hit], rank[hit]
                    slot = ((dart & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
                    better = rank < ranks[slot]
                    dart, rank, slot = dart[better], rank[better], slot[better]
                    order = np.argsort(-rank, kind="stable")
                    signature[slot[order]], ranks[slot[order]] = dart[order], rank[order]
                if weights is None:
                    break
                layer, base, top = layer + 1, top, top * 2
            region += 1
    return signature


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature.reshape(-1, rows)
        out = np.arange(len(parts), dtype=np.uint64)
        for i in range(rows):
            out = mix(out * _GOLD + parts[:, i])
    return out.view(np.int64)


def occurrences(every: np.ndarray) -> np.ndarray:
    """Distinct elements for shingles with repeats: the first occurrence is the shingle's own hash."""
    own, first, count = np.unique(every, return_index=True, return_counts=True)
    if len(own) == len(every):
        return own
    nth = np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        again = np.repeat(own, count)
        return np.unique(np.where(nth == 0, again, mix(again ^ (nth.astype(np.uint64) * _M2))))


def elements(every: np.ndarray, weighting: str) -> np.ndarray:
    return occurrences(every) if weighting == "count" else np.unique(every)


def signed(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """doc_id, th (text_hash), k1 and k2 (of the elements), n (how many), bands. weighting: "set", or "count"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, texts in spans(batch, "text"):
                k1, k2, sizes, keys = [], [], [], []
                for all_ in shingles(texts, words):
                    own = elements(all_, weighting)
                    with np.errstate(over="ignore"):
                        a, b = mix(own).sum(dtype=np.uint64), mix(own ^ _M1).sum(dtype=np.uint64)
                    k1.append(int(a.view(np.int64)))
                    k2.append(int(b.view(np.int64)))
                    sizes.append(len(own))
                    if weighting == "count":
                        thrown = darts(*(lambda u, c: (u, c.astype(float)))(*np.unique(all_, return_counts=True)))
                    else:
                        thrown = darts(own)
                    keys.append(bands(thrown) if len(own) else np.zeros(0, np.int64))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "k1", "k2", "n", "bands"])

    return in_arrow(docs.select("doc_id", text_hash().alias("th"), "text"), run, "doc_id long, th long, k1 long, k2 long, n long, bands array<long>")


class Texts:
    """Where the text of a node is found: docs, nodes(nid, rep: doc_id and th of one of its rows), and whether rows of
    docs are repeated."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, repeated: bool, weighting: str):
        self.docs, self.nodes, self.repeated, self.weighting = docs, nodes, repeated, weighting

    def sets(self, ids: DataFrame) -> DataFrame:
        """id and sorted element hashes of these nodes; written."""
        held = written(self.nodes.select("nid", F.col("rep.doc_id").alias("__id"), F.col("rep.th").alias("__h")).join(ids.select(F.col("id").alias("nid")), "nid", "left_semi"), "wanted")
        rows = self.docs.select("doc_id", text_hash().alias("th"), "text").join(few(held, FEW), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__h"))).select("nid", "text")
        weighting = self.weighting

        def run(batches):
            words = Words()
            for batch in batches:
                for part, texts in spans(batch, "text"):
                    yield pa.record_batch([part.column(0), pa.array([elements(s, weighting).tobytes() for s in shingles(texts, words)], pa.binary())], ["id", "set"])

        out = in_arrow(rows, run, "id long, set binary")
        out = written(out.groupBy("id").agg(F.first("set").alias("set")) if self.repeated else out, "sets")
        drop_written(held)
        return out


def verified(sets: DataFrame, pairs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """pairs(a, b) whose sets(id, set) have a Jaccard similarity of at least similar; written."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similar * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return written(in_arrow(both, run, "a long, b long").distinct(), "links")


def prefixes(sets: DataFrame, similar: float = SIMILAR, few: int = FEW) -> DataFrame:
    """nid, n, tok and pos: of each set, in the order of their frequency among the sets, the first
    n - ceil(similar * n) + 1 shingles with their positions, those of one set alone left out; written.

    Sets that are similar enough share one of them at least, and what each has from the first of these on is no less
    than what they must have in common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.record_batch([pa.array(toks), pa.array(n)], ["tok", "df"])

    shared = written(in_arrow(sets.select("set"), count, "tok long, df long").groupBy("tok").agg(F.sum("df").alias("df")).where("df > 1"), "tokens")
    length = lambda n: n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1
    if shared.count() <= few:
        own = shared.orderBy("tok").toPandas()
        sent = sets.sparkSession.sparkContext.broadcast((own["tok"].to_numpy(), own["df"].to_numpy()))

        def run(batches):
            toks, df = sent.value
            for batch in batches:
                ids, sizes, out, at_ = [], [], [], []
                for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = np.frombuffer(b, np.int64)
                    at = np.minimum(np.searchsorted(toks, s), max(0, len(toks) - 1))
                    hit = toks[at] == s if len(toks) else np.zeros(len(s), bool)
                    alone = int((~hit).sum())
                    if (most := int(length(np.int64(len(s)))) - alone) > 0:
                        s, at = s[hit], at[hit]
                        first = s[np.lexsort((s, df[at]))[:most]]
                        ids += [i] * len(first)
                        sizes += [len(b) // 8] * len(first)
                        out += first.tolist()
                        at_ += range(alone, alone + len(first))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, sizes, out, at_)], ["nid", "n", "tok", "pos"])

        return written(in_arrow(sets.select("id", "set"), run, "nid long, n long, tok long, pos long"), "prefixes")

    def each(batches):
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.frombuffer(b, np.int64)
                yield pa.record_batch([pa.array(np.full(len(s), i, np.int64)), pa.array(np.full(len(s), len(s), np.int64)), pa.array(s)], ["nid", "n", "tok"])

    held = in_arrow(sets.select("id", "set"), each, "nid long, n long, tok long").join(shared, "tok").groupBy("nid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("m"))
    alone = F.col("n") - F.size("m")
    most = F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1 - alone
    first = held.where(most > 0).select("nid", "n", alone.alias("alone"), F.posexplode(F.slice("m", F.lit(1), most.cast("int"))).alias("i", "x"))
    return written(first.select("nid", "n", F.col("x.tok").alias("tok"), (F.col("alone") + F.col("i")).alias("pos")), "prefixes")


def components(links: DataFrame) -> DataFrame:
    """nid and comp (smallest id of its connected component) of every node of links(a, b): labels spread to neighbours,
    then to the label's own label, until nothing changes."""
    edges = written(links.union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    label = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("nid"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = edges.join(label.select(F.col("nid").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        spread = label.join(near, F.col("nid") == F.col("u")).select("nid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("nid").alias("comp"), F.col("comp").alias("further"))
        after = written(spread.join(jump, "comp", "left").select("nid", "old", F.coalesce("further", "comp").alias("comp")), "labels")
        changed = after.where("comp <> old").limit(1).count()
        drop_written(label)
        label = after.select("nid", "comp")
        if not changed:
            drop_written(edges)
            return label


def _joined_within(texts: Texts, big: DataFrame, label: DataFrame, similar: float) -> DataFrame:
    """label(nid, comp) after all links inside the buckets of big(h, nid, n).

    Only buckets that still hold several classes matter. Similar sets among their nodes share a prefix shingle, so nodes
    meet again by these: a group's leaders are compared with its nodes of other classes and are then done; a group ends
    with one class, or when all of it has led. Leaders are eight times as many each round, so rounds are few.
    """
    at = big.join(label, "nid")
    live = at.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("h")
    sets = texts.sets(at.join(written(live, "live"), "h", "left_semi").select(F.col("nid").alias("id")).distinct())
    rest, leaders = prefixes(sets, similar), SMALL
    while True:
        held = rest.join(label, "nid")
        live = held.groupBy("tok").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1").select("tok", "size")
        held = written(held.join(written(live, "live"), "tok").select("tok", "size", "nid", "n", "pos", "comp"), "rest")
        if held.limit(1).count() == 0:
            return label
        slot = F.when(F.col("size") <= leaders, F.col("nid")).otherwise(F.pmod(F.xxhash64("nid"), F.lit(leaders)))
        leads = held.groupBy("tok", slot.alias("slot")).agg(F.min(F.struct("nid", "n", "pos", "comp")).alias("l")).select("tok", F.col("l.nid").alias("a"), F.col("l.n").alias("an"), F.col("l.pos").alias("apos"), F.col("l.comp").alias("ac"))
        leads = written(leads, "leads")
        near = F.least(F.col("n") - F.col("pos"), F.col("an") - F.col("apos")) >= F.lit(similar / (1 + similar)) * (F.col("n") + F.col("an")) - 1e-9
        pairs = held.join(leads, "tok").where((F.col("ac") != F.col("comp")) & near).select(F.least("a", "nid").alias("a"), F.greatest("a", "nid").alias("b"))
        links = verified(sets, written(pairs.distinct(), "pairs"), similar)
        of = lambda c: label.select(F.col("nid").alias(c), F.col("comp").alias(f"c{c}"))
        merged = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        merged = merged.select(F.col("nid").alias("comp"), F.col("comp").alias("to"))
        label = written(label.join(merged, "comp", "left").select("nid", F.coalesce("to", "comp").alias("comp")), "classes")
        rest = held.select("tok", "nid", "n", "pos").join(leads.select("tok", F.col("a").alias("nid")), ["tok", "nid"], "left_anti")
        leaders *= 8


def _classes(docs: DataFrame, similar: float, weighting: str) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, th, class_id, class_size, keep (doc_id and th of the row that stays); and the written tables under it."""
    rows = written(signed(docs, weighting), "signatures")
    repeated = rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count() > 0
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("rep")
    nodes = rows.groupBy("k1", "k2").agg(rep, F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    texts = Texts(docs, nodes, repeated, weighting)
    banded = nodes.select("nid", "n", F.explode("bands").alias("h"))
    size = written(banded.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = written(banded.join(size, "h"), "buckets")
    ratio = lambda x, y: F.least(x, y) >= similar * F.greatest(x, y)  # noqa: E731  no smaller set can be that similar
    small = shared.where(F.col("size") <= SMALL).groupBy("h").agg(F.collect_list(F.struct("nid", "n")).alias("m"))
    pairs = small.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.nid < y.nid").where(ratio(F.col("x.n"), F.col("y.n")))
    pairs = pairs.select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"))
    big = shared.where(F.col("size") > SMALL).select("h", "nid", "n")
    slot = F.pmod(F.xxhash64("nid"), F.lit(LEADERS))
    leads = big.groupBy("h", slot.alias("slot")).agg(F.min(F.struct("nid", "n")).alias("l")).select("h", "l")
    led = big.join(leads, "h").where(F.col("nid") != F.col("l.nid")).where(ratio(F.col("n"), F.col("l.n")))
    pairs = written(pairs.union(led.select(F.least("nid", "l.nid"), F.greatest("nid", "l.nid"))).distinct(), "pairs")
    sets = texts.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = verified(sets, pairs, similar)
    comp = components(links)
    label = written(nodes.select("nid").join(comp, "nid", "left").select("nid", F.coalesce("comp", "nid").alias("comp")), "classes")
    for table in (sets, pairs, links, comp):
        drop_written(table)
    if big.limit(1).count():
        label = _joined_within(texts, big, label, similar)
    for table in (size, shared):
        drop_written(table)
    ids = nodes.select("k1", "k2", "nid", "rows", "rep").join(label, "nid")
    classes = ids.groupBy("comp").agg(F.sum("rows").alias("class_size"), F.min("rep").alias("keep"), F.min("k1").alias("k"))
    class_id = F.coalesce("keep.doc_id", -1 - F.abs(F.shiftright("k", 1))).alias("class_id")
    classes = written(classes.select("comp", "class_size", "keep", class_id), "class-sizes")  # so that Spark can split the joins' large classes
    ids = written(ids.join(classes, "comp").select("k1", "k2", "class_id", "class_size", "keep"), "class-nodes")
    for table in (nodes, label, classes):
        drop_written(table)
    return rows.select("doc_id", "th", "k1", "k2").join(ids, ["k1", "k2"]).select("doc_id", "th", "class_id", "class_size", "keep"), [rows, ids]


def near_classes(docs: DataFrame, similar: float = SIMILAR, weighting: str = "set") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size (rows) and kept for every row.

    Null and empty texts, which have no shingle, are one class. Rows are judged by their own texts, also where they share
    a doc_id or have none; a class of rows without doc_id has a negative class_id. The row with the smallest doc_id of a
    class is kept, of several with it the one of the smallest text_hash; repeated rows of it are all marked kept. An
    empty table gives no rows.
    """
    return _classes(docs, similar, weighting)[0].select("doc_id", "class_id", "class_size", _stays().alias("kept"))


def _stays():
    return F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th"))


def distinct_documents(docs: DataFrame, similar: float = SIMILAR, weighting: str = "set") -> DataFrame:
    """One row of each class, the one that near_classes() keeps; of repeated rows the first of their JSON."""
    rows, under = _classes(docs, similar, weighting)
    rows = rows.where("class_size > 1").select("doc_id", "th", _stays().alias("stays"))
    marks = written(rows.groupBy("doc_id", "th").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "marks")
    for table in under:
        drop_written(table)
    return without(docs, marks)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))
