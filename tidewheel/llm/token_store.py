"""Token-id files: canonical length-limited Huffman blocks with bit-offset checkpoints.

Texts are encoded once (each distinct word of a worker once) and written; global counts of ids give code lengths of at
most LIMIT bits by package-merge; the ids, range-sorted by doc_id, are written as blocks that can be decoded alone.
A block has the bit offset of every STEP-th symbol, so its segments are decoded in lockstep from one table.

Files: <path>/header (one row: code length of every id) and <path>/blocks, Parquet rows of part, block, doc_ids, ends
(ids up to each document's end), first (ids before the block in its part), n, checkpoints and the payload.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, in_arrow, keep, read, shared_dir, slices, written
from .words import WordTable, gather

LIMIT, STEP, BLOCK, PART = 18, 256, 1 << 18, 1 << 23
_BLOCKS = "part int, block int, first long, n long, doc_ids array<long>, ends array<long>, checkpoints array<int>, payload binary"
#: Bytes of text that are encoded together.
SPAN = 1 << 22
#: How the public tokenizer cuts a text (fixed values of its file).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII marks but the apostrophe. A text is plain if its letters are those of Latin-1, it has no other marks, no
#: apostrophe touches a mark and no special token can begin: then it can be cut around runs of marks.
_MARKS = r"!-&(-/:-@\[-`{-~"
_NOT_PLAIN = rf"[^\x00-\x7FÀ-ÖØ-öø-ÿ]|'[{_MARKS}]|[{_MARKS}]'|<\|"
_RUN = re.compile(rf"[{_MARKS}]+")


class Encoder:
    """Ids of texts by the tokenizers library. The tokenizer drops white space, so words between spaces and line ends are
    encoded alone, each distinct word of a worker once. Plain texts are in lower case and cut around marks first, as the
    tokenizer would do itself, which leaves fewer words; these go to its model alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.cuts = kinds == ["NFC", "Replace", "Lowercase"] and json.dumps(_CUT) in json.dumps(spec["pre_tokenizer"]) and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.cuts:
            self.model = Tokenizer(self.whole.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)
            self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
            self.plain = WordTable(self.of_plain)
        self.table = WordTable(self.of_words)

    def of_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        return _ragged([e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)])

    def of_plain(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters only, or marks only, are one part, which ends with its one id that has the sign of a word's end."""
        single = np.fromiter((w.isalpha() or _RUN.fullmatch(w) is not None for w in words), bool, len(words))
        ascii_ = np.fromiter(map(str.isascii, words), bool, len(words))
        parts = []
        for at, level in ((np.flatnonzero(single & ascii_), None), (np.flatnonzero(single & ~ascii_), self.level)):
            if len(at):
                joined = [" ".join([words[i] for i in at[k : k + 1000].tolist()]) for k in range(0, len(at), 1000)]
                joined = [j.translate(level) for j in joined] if level else joined
                ids = np.concatenate([np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
                parts.append((at, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)))
        if len(rest := np.flatnonzero(~single)):
            parts.append((rest, *self.of_words([words[i] for i in rest.tolist()])))
        return _in_order(parts)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pc = pa.compute
        texts = pc.replace_substring(texts, "\n", " ")
        if not self.cuts:
            return self.table.ids(pc.split_pattern(texts, " "))
        odd = pc.match_substring_regex(texts, _NOT_PLAIN)
        plain = pc.replace_substring_regex(pc.utf8_lower(texts.filter(pc.invert(odd))), rf"([{_MARKS}]+) ?", r" \1 ")
        ids, counts = self.plain.ids(pc.split_pattern(plain, " "))
        if len(counts) == len(texts):
            return ids, counts
        odd_ids, odd_counts = self.table.ids(pc.split_pattern(texts.filter(odd), " "))
        odd = odd.to_numpy(zero_copy_only=False)
        return _in_order([(np.flatnonzero(~odd), ids, counts), (np.flatnonzero(odd), odd_ids, odd_counts)])


def _in_order(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ragged array from several, each with the places of its rows."""
    n = sum(len(at) for at, _, _ in parts)
    starts, lengths, before = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for at, flat, sizes in parts:
        starts[at] = before + np.cumsum(sizes) - sizes
        lengths[at] = sizes
        before += len(flat)
    return gather(np.concatenate([flat for _, flat, _ in parts]), starts, lengths), lengths


def _ragged(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        _encoders[path] = Encoder(path)
    keep("tokens", _encoders.clear)
    return _encoders[path]


def kind_of(wide: bool) -> str:
    return "<u4" if wide else "<u2"


def tokenised(docs: DataFrame, path: str, end_id: int, wide: bool | None = None) -> DataFrame:
    """doc_id, h (a hash of the ids), n, ids (little-endian, of 16 bits, or of 32 where the vocabulary or end_id needs
    them: wide), the end id included. Null and empty texts are the end id only."""
    kind = kind_of(is_wide(path, end_id) if wide is None else wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part, texts in slices(batch, "text", SPAN):
                ids, counts = encoder.ids(texts)
                ends = np.cumsum(counts)
                flat = np.insert(ids.astype(kind), ends, np.array(end_id, kind))
                size = flat.itemsize
                upto = (np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * size).astype(np.int32)
                data = memoryview(flat).cast("B")
                out = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(upto), pa.py_buffer(data)])
                at = upto.tolist()
                h = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
                yield pa.record_batch([part.column(0), pa.array(h, pa.int64()), pa.array(counts + 1, pa.int64()), out], ["doc_id", "h", "n", "ids"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, h long, n long, ids binary", "tokens")


def is_wide(path: str, end_id: int) -> bool:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) >= 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits for each id by package-merge; 0 for ids that don't occur. Optimal among codes of at most limit bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        kinds.append(order < len(leaves))
    take = 2 * len(leaves) - 2
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        out[used[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.int64(1) << (LIMIT - n))[:-1]]) if len(n) else n
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = at >> (LIMIT - n)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ends) else 0
    word, bit = at >> 5, at & 31
    wide = codes[ids].astype(np.uint64) << (64 - bit - n).astype(np.uint64)
    size = (total + 31) // 32 + 1
    # codes never overlap, so sums are unions; a double holds 32 bits exactly
    hi = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), size)[:size]
    lo = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size)[:size]
    return (hi + lo).astype(np.uint32).astype(">u4").tobytes(), at[::STEP].astype(np.int32)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbols, bits = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    span = np.int64(1) << (LIMIT - n)
    filled = int(span.sum())
    symbols[:filled], bits[:filled] = np.repeat(order, span), np.repeat(n, span)
    return symbols, bits


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All segments advance together, a symbol each at a time."""
    symbols, bits = table
    words = np.concatenate([np.frombuffer(payload, ">u4"), np.zeros(STEP * LIMIT // 32 + 3, np.uint32)]).astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = checkpoints.astype(np.int64)
    out = np.empty((min(STEP, n), len(at)), np.uint32)
    for i in range(len(out)):
        key = (pairs[at >> 5] >> (64 - LIMIT - (at & 31)).astype(np.uint64)) & np.uint64((1 << LIMIT) - 1)
        out[i] = symbols[key]
        at = at + bits[key]
    return out.T.ravel()[:n] if len(at) else out.ravel()


def write(tokens: DataFrame, path: str, wide: bool = True) -> None:
    """tokens(doc_id, h, ids, row) as files in ascending doc_id order (nulls first). Rows of one doc_id follow by h and
    ids; row, a number of the row that is fixed by now, lets many rows of one doc_id, null too, go to several files."""
    spark, kind = tokens.sparkSession, kind_of(wide)

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0)
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            own = np.bincount(np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = in_arrow(tokens.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes, width = canonical(lengths), np.dtype(kind).itemsize
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/header")

    def block(part, no, first, docs):
        ids = np.concatenate([np.frombuffer(b, kind) for _, b in docs])
        payload, checkpoints = pack(ids, lengths, codes)
        ends = np.cumsum([len(b) // width for _, b in docs])
        values = [[part], [no], [first], [len(ids)], [[d for d, _ in docs]], [ends.tolist()], [checkpoints.tolist()], [payload]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], [c.split()[0] for c in _BLOCKS.split(", ")])

    def encode(batches):
        part, no, first, docs, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if docs and size + len(b) // width > BLOCK:
                    yield block(part, no, first, docs)
                    no, first, docs, size = no + 1, first + size, [], 0
                docs.append((d, b))
                size += len(b) // width
        if docs:
            yield block(part, no, first, docs)

    parts = max(1, -(-int(counts.sum()) // PART))
    order = ["doc_id", "h", "ids", "row"]
    dealt = tokens.select("doc_id", "ids", "h", "row").repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions(*order)
    in_arrow(dealt.select("doc_id", "ids"), encode, _BLOCKS).write.parquet(f"{path}/blocks")


def read_back(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    lengths = np.frombuffer(bytes(spark.read.schema("lengths binary").parquet(f"{path}/header").first()[0]), np.uint8)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # a row for each file written, so the window without a key and the broadcast are of that size
    base = blocks.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")

    def decode(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], np.array(r["checkpoints"], np.int64), r["n"], table).astype("<u4")
                ends = np.array(r["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * len(ends), pa.int32()), pa.array(starts + r["first"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    schema = "doc_id long, part int, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    out = in_arrow(blocks, decode, schema).join(F.broadcast(base), "part")
    return out.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def op9(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    wide = is_wide(tokenizer, end_id)
    tokens = written(tokenised(read(spark, sf_dir, "documents"), tokenizer, end_id, wide).withColumn("row", F.monotonically_increasing_id()), "tokens")
    write(tokens, path, wide)
    drop_written(tokens)
    return read_back(spark, path)
