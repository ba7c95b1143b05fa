"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a span of texts (a word with the space before it as the mark) are sorted, which makes them
a trie walked depth-first: the forward states of the characters a word shares with the one before it are kept. Words of a
BPE model are cut first where no piece reaches across, between letters and the marks around them, so fewer are distinct.

For a unigram model the state of a prefix is the best score and its last piece: Viterbi. The public model at hand is a
BPE model, whose encoding is not the best-scored one, so there the state is the last piece of the prefix's own BPE
encoding: the one piece that ends there, follows a reachable state, and is compatible with it, that is, merging the two
pieces alone gives the same two pieces. Both read a prefix's state from those of shorter prefixes, so both share them.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, keep, read, slices
from .words import WordTable, gather

MARK = "▁"
#: Stands for each space after the first of a run while texts are cut at spaces.
MORE = "\x01"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Bytes of text that are encoded together.
SPAN = 1 << 20
#: Pairs of pieces and steps of the automaton that a worker remembers before it starts anew.
LEARNED = 1_500_000


class Pieces:
    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece as sp

        m = sp.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        if kind is None:
            from sentencepiece import sentencepiece_model_pb2 as pb

            proto = pb.ModelProto()
            with open(path, "rb") as f:
                proto.ParseFromString(f.read())
            kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        self.kind, self.unknown = kind, m.unk_id()
        own = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.id = {m.id_to_piece(i): i for i in own}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in own}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.low = min(self.score.values(), default=0.0) - 10
        self.build()
        #: Pieces in which a space comes before another: then runs of spaces can't be set apart from words.
        self.apart = not any(p.strip(MARK) and p.startswith(MARK * 2) for p in self.id) and not any(MARK in p.lstrip(MARK) for p in self.id)
        self.surface = [b""] * n
        for p, i in self.id.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.size = np.array([len(s) for s in self.surface], np.int64)
        self.start = np.cumsum(self.size) - self.size
        #: Marks that no piece has beside a letter.
        held = {c for p in self.id for a, b in pairwise(p) for c in ((b,) if a.isalpha() else ()) + ((a,) if b.isalpha() else ())}
        cut = "".join(f"\\{c}" for c in string.punctuation + "\n" if c not in held) if kind == "bpe" else ""
        self.cuts = ((rf"([{_LETTERS}])([{cut}])", r"\1 \2"), (rf"([{cut}])([{_LETTERS}])", r"\1 \2")) if cut else ()
        self.table = WordTable(self.encode_units, most=150_000)

    def build(self) -> None:
        """An automaton of all pieces: goto[node][character] is the node of the longest piece's beginning that a text ends
        with, and ending[node] has (length, piece, known pairs) of the pieces that a text there ends with, longest first."""
        self.goto: list[dict[str, int]] = [{}]
        own, self.learned = [None], 0
        for p in self.id:
            at = 0
            for c in p:
                if (to := self.goto[at].get(c)) is None:
                    to = self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    own.append(None)
                at = to
            own[at] = (len(p), p, {})
        self.fall, self.ending = [0] * len(own), [()] * len(own)
        level = [0]
        edges = [[*g.items()] for g in self.goto]
        while level:
            below = []
            for at in level:
                for c, to in edges[at]:
                    fall = self.step(self.fall[at], c) if at else 0
                    self.fall[to] = fall
                    self.ending[to] = ((own[to],) if own[to] else ()) + self.ending[fall]
                    below.append(to)
            level = below

    def step(self, at: int, c: str) -> int:
        """goto by shorter beginnings; kept for the next time."""
        to = 0
        back = at
        while True:
            if (found := self.goto[back].get(c)) is not None:
                to = found
                break
            if not back:
                break
            back = self.fall[back]
        self.goto[at][c] = to
        self.learned += 1
        return to

    def merged(self, text: str) -> list[str]:
        """BPE: the best-scored adjacent pair is merged, the leftmost of equals, until none is a piece."""
        if len(text) <= 40:  # no heap is needed
            parts, score, none = list(text), self.score, -np.inf
            pairs = [score.get(a + b, none) for a, b in pairwise(parts)]
            while pairs and (best := max(pairs)) > none:
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                pairs[max(0, i - 1) : i + 2] = [score.get(a + b, none) for a, b in pairwise(parts[max(0, i - 1) : i + 2])]
            return parts
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def push(i: int, j: int) -> None:
            if (p := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[p], i, p))

        for i in range(len(parts) - 1):
            push(i, i + 1)
        while heap:
            _, i, p = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [p for p in parts if p is not None]

    def fits(self, a: str, b: str, known: dict[str, bool]) -> bool:
        ok = known[a] = self.merged(a + b) == ([a, b] if a else [b])
        self.learned += 1
        return ok

    def paths(self, words: Sequence[str]) -> list[list[str]]:
        """Pieces of each of the sorted words; states of the prefix shared with the word before are reused."""
        if self.learned > LEARNED:
            self.build()
        out, last = [], ""
        best, piece, node = [0.0], [""], [0]  # state of each prefix: score (unigram), last piece, place in the automaton
        unigram, goto, ending, score = self.kind == "unigram", self.goto, self.ending, self.score
        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del best[same + 1 :], piece[same + 1 :], node[same + 1 :]
            at, end = node[same], same
            for c in word[same:]:
                to = goto[at].get(c)
                at = self.step(at, c) if to is None else to
                end += 1
                own = c  # a character that is no piece
                if unigram:
                    top, found = -np.inf, ending[at]
                    for n, p, _ in found:
                        if (x := best[end - n] + score[p]) > top:
                            top, own = x, p
                    if (not found or found[-1][0] > 1) and best[end - 1] + self.low > top:
                        top, own = best[end - 1] + self.low, c
                    best.append(top)
                else:
                    for n, p, known in ending[at]:
                        q = piece[end - n]
                        ok = known.get(q)
                        if ok is None:
                            ok = self.fits(q, p, known)
                        if ok:
                            own = p
                            break
                piece.append(own)
                node.append(at)
            path, end = [], len(word)
            while end:
                path.append(p := piece[end])
                end -= len(p)
            path.reverse()
            out.append(path)
            last = word
        return out

    def encode_units(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has: a marked word, its further spaces as MORE behind the mark, or a part of a
        word without its mark."""
        keys, extra = [], []
        for u in units:
            k = 0
            if u[1:2] == MORE and u[0] == MARK:
                bare = u[1:].lstrip(MORE)
                k = len(u) - 1 - len(bare)
                u, k = (MARK + bare, k) if self.apart else (MARK * (k + 1) + bare, 0)
            keys.append(u)
            extra.append(k)
        order = sorted(set(keys))
        path = dict(zip(order, self.paths(order)))
        out = [self.ids_of(path[u] if not k else self.merged(MARK * (k + 1)) + path[u][1:] if path[u][0] == MARK else self.merged(MARK * k) + path[u]) for u, k in zip(keys, extra)]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int64, int(lengths.sum())), lengths

    def ids_of(self, pieces: Sequence[str]) -> list[int]:
        """Characters that are no piece are bytes, or unknown; a run of unknown ones of a unigram model is one id."""
        try:
            return [self.id[p] for p in pieces]
        except KeyError:
            out = []
            for p in pieces:
                if (i := self.id.get(p)) is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in p.encode()]
                elif self.kind != "unigram" or out[-1:] != [self.unknown]:
                    out.append(self.unknown)
            return out

    def units(self, texts: pa.Array) -> pa.ListArray:
        """The units of each text; a text that is empty has none. No text may have MORE in it."""
        pc = pa.compute
        t = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, texts.type), texts)
        t = pc.replace_substring(pc.replace_substring_regex(t, "^ ", MORE), "  ", f" {MORE}")
        t = pc.replace_substring(pc.replace_substring(t, f"{MORE} ", MORE * 2), " ", f" {MARK}")
        t = pc.binary_join_element_wise(MARK, t, "")
        for pattern, by in self.cuts:
            t = pc.replace_substring_regex(t, pattern, by)
        return pc.split_pattern(t, " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        pc = pa.compute
        texts = pc.replace_substring(texts, MARK, " ")
        odd = pc.match_substring(texts, MORE)
        if not pc.any(odd).as_py():
            return self.table.ids(self.units(texts))
        out = []  # the sign for further spaces occurs itself: such texts are one unit each, others as usual
        for t, whole in zip(texts.to_pylist(), odd.to_pylist()):
            out.append(np.array(self.ids_of(self.merged(MARK + t.replace(" ", MARK))), np.int64) if whole else self.table.ids(self.units(pa.array([t])))[0])
        return np.concatenate(out), np.array(list(map(len, out)), np.int64)

    def surfaces(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of all texts stand for, without the space that a text's first mark is, and how many each text has."""
        start, size = self.start[ids], self.size[ids]
        ends = np.cumsum(counts)
        first = (ends - counts)[counts > 0]
        first = first[self.flat[start[first]] == ord(" ")]
        start[first] += 1
        size[first] -= 1
        upto = np.concatenate([[0], np.cumsum(size)])
        return gather(self.flat, start, size), np.diff(upto[np.concatenate([[0], ends])])

    def round_trips(self, texts: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether each text's ids stand for its bytes, marks read as spaces."""
        data, sizes = self.surfaces(ids, counts)
        texts = pa.compute.replace_substring(texts, MARK, " ")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        want = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        own = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
        same = sizes == own
        if same.all():
            wrong = np.flatnonzero(data != want)
            same[np.searchsorted(np.cumsum(own), wrong, side="right")] = False
            return same
        a, b = np.cumsum(sizes) - sizes, np.cumsum(own) - own
        for i in np.flatnonzero(same).tolist():
            same[i] = (data[a[i] : a[i] + sizes[i]] == want[b[i] : b[i] + own[i]]).all()
        return same

    def decode(self, ids: np.ndarray) -> str:
        text = gather(self.flat, self.start[ids], self.size[ids]).tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_models: dict[tuple[str, str | None], Pieces] = {}


def model(path: str, kind: str | None = None) -> Pieces:
    if (path, kind) not in _models:
        _models[path, kind] = Pieces(path, kind)
    keep("pieces", _models.clear)
    return _models[path, kind]


def encoded(docs: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (decoding gives the text back, its marks read as spaces).

    Null and empty texts have no ids. Every row of docs gives a row. No row leaves its task, so there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for batch in batches:
            for part, texts in slices(batch, "text", SPAN):
                ids, counts = m.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                same = m.round_trips(texts, ids, counts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part.column(0), lists, pa.array(counts, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "round_trip"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, n_ids long, round_trip boolean", "pieces")


def decoded(rows: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """doc_id and text of rows(doc_id, ids); null ids are the empty text."""

    def run(batches):
        m = model(path, kind)
        for batch in batches:
            texts = [m.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_arrow(rows.select("doc_id", "ids"), run, "doc_id long, text string", "pieces")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op3(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), path or default_model()).select("doc_id", "n_ids", "round_trip", F.col("ids"))
