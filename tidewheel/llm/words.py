"""Ragged gathers, and a word table: each distinct word is encoded once, texts are then gathered from the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] for each start and length."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if len(flat) + total < 1 << 31 else np.int64  # half the memory of the index
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


class WordTable:
    """Words with the ids they stand for: encode(words) gives all their ids and how many each has.

    It holds about `most` words. Beyond that, words that were asked for again since they came stay, half of the table
    at most, and the others go; results don't depend on that.
    """

    def __init__(self, encode: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], dtype=np.uint32, most: int = 250_000):
        self.encode, self.most = encode, most
        self.at: dict[str, int] = {}
        self.flat = np.zeros(0, dtype)
        self.starts, self.lengths, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def shrink(self) -> None:
        keep = np.flatnonzero(self.again)[-self.most // 2 :]
        names = list(self.at)
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.flat = gather(self.flat, self.starts[keep], self.lengths[keep])
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.again = np.zeros(len(keep), bool)

    def slots(self, words: Sequence[str]) -> np.ndarray:
        """Places of distinct words in starts and lengths, until the next call."""
        if len(self.at) > self.most:
            self.shrink()
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        gone = np.flatnonzero(out < 0)
        self.again[out[out >= 0]] = True
        if len(gone):
            new = [words[i] for i in gone.tolist()]
            flat, lengths = self.encode(new)
            first = len(self.at)
            self.at.update(zip(new, range(first, first + len(new))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths])
            self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            out[gone] = np.arange(first, first + len(new))
        return out

    def taken(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in these places, and how many each has."""
        lengths = self.lengths[slots]
        return gather(self.flat, self.starts[slots], lengths), lengths

    def ids(self, texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of all texts (lists of words; null: none), and how many each text has."""
        words = texts.flatten().dictionary_encode()
        ids, lengths = self.taken(self.slots(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy(zero_copy_only=False)])
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        n = pa.compute.fill_null(pa.compute.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(n, dtype=np.int64)])])
