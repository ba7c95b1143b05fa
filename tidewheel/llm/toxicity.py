"""Toxic spans by a linear-chain conditional random field.

Tokens are words; the tokens of the labelled sample are labelled by their document: a token of a toxic document is toxic
if its word, or its beginning, is much commoner in toxic documents than in others. The field has two states. Emissions:
log odds of the word and of its first four and five characters, where they speak for toxicity, and a bias; transitions
and the start are free. It is fitted on all tokens of the sampled texts by the gradient of the conditional likelihood
(forward-backward); a text with more than TILE tokens of evidence is fitted in tiles, each given the label of the token
before it, so that every token and transition still counts. Marginals of forward-backward give offending spans and, by a logistic calibration of their sum and maximum, the document's score.

Tokens without evidence all have the same emission, so runs of them are one matrix power, and whole texts cost little
more than looking their words up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, read, spans
from .learning import held_out, logistic, sample

WORDS = re.compile(r"\w+")
#: At most so many rows of either label are learned from; log odds below EVIDENCE count as none.
SAMPLE, EVIDENCE, THRESHOLD = 2500, 1.2, 0.3
#: Evidence tokens of a training tile; log odds (scaled as in log_odds) from which a token of a toxic document is labelled toxic.
TILE, TOXIC = 512, 0.6


def lowered(text: str) -> str:
    """In lower case if that keeps every character's place, else as it is; tokens are cut from this."""
    low = text.lower()
    return low if len(low) == len(text) else text


def tokens(text: str) -> list[str]:
    low = lowered(text)
    return WORDS.findall(low) if low is not text or text.islower() else [w.lower() for w in WORDS.findall(text)]


class Evidence(dict):
    """Features of a word, None without evidence; made when first asked for."""

    def __init__(self, word: dict[str, float], begin: dict[str, float]):
        super().__init__()
        self.word, self.begin = word, begin

    def __missing__(self, w: str):
        if len(self) > 150_000:
            self.clear()
        f = (self.word.get(w, 0.0), self.begin.get(w[:4], 0.0), self.begin.get(w[:5], 0.0) if len(w) > 4 else 0.0)
        out = self[w] = f if any(f) else None
        return out


class Field:
    def __init__(self, word: dict[str, float], begin: dict[str, float], emission: np.ndarray, transition: np.ndarray, start: np.ndarray, calibration: np.ndarray):
        self.word, self.begin, self.emission, self.transition, self.start, self.calibration = word, begin, emission, transition, start, calibration
        self.seen = Evidence(word, begin)
        self.step = np.exp(transition)
        quiet = self.step * np.exp([0.0, emission[-1]])
        self.quiet = quiet / np.abs(np.linalg.eigvals(quiet)).max()  # powers neither grow nor vanish
        self.powers: dict[int, np.ndarray] = {}

    def parts(self) -> tuple:
        return self.word, self.begin, self.emission, self.transition, self.start, self.calibration

    def active(self, words: Sequence[str]) -> list[tuple[int, tuple[float, float, float]]]:
        seen = self.seen
        return [(i, f) for i, w in enumerate(words) if (f := seen[w]) is not None]

    def power(self, n: int) -> np.ndarray:
        """Over n tokens without evidence: each is the transition, then the emission of the bias alone."""
        if n not in self.powers:
            if len(self.powers) > 10_000:
                self.powers.clear()
            self.powers[n] = np.linalg.matrix_power(self.quiet, n)
        return self.powers[n]

    def marginals(self, n: int, active: Sequence[tuple[int, tuple[float, float, float]]]) -> np.ndarray:
        """P(toxic) of each active token among n tokens."""
        if not active:
            return np.zeros(0)
        at = [i for i, _ in active]
        emit = [np.array([1.0, np.exp(min(30.0, np.dot(self.emission[:3], f) + self.emission[3]))]) for _, f in active]
        forward = []
        for k, (i, e) in enumerate(zip(at, emit)):
            if k:
                a = forward[-1] @ self.power(i - at[k - 1] - 1) @ self.step
            elif i:
                a = np.exp(self.start) * np.exp([0.0, self.emission[-1]]) @ self.power(i - 1) @ self.step
            else:
                a = np.exp(self.start)
            a = a * e
            forward.append(a / a.sum())
        b = self.power(n - 1 - at[-1]) @ np.ones(2)
        out = np.zeros(len(at))
        for k in range(len(at) - 1, -1, -1):
            p = forward[k] * b
            out[k] = p[1] / p.sum()
            if k:
                b = self.power(at[k] - at[k - 1] - 1) @ (self.step @ (emit[k] * b))
                b = b / b.max()
        return out

    def summary(self, n: int, p: np.ndarray) -> list[float]:
        most = float(p.max()) if len(p) else 0.0
        return [np.log((p.sum() if len(p) else 0.0) + 1e-3), np.log((most + 1e-3) / (1 - most + 1e-3)), np.log1p(n) / 5]

    def score(self, n: int, p: np.ndarray) -> float:
        z = float(np.dot(self.summary(n, p), self.calibration[:-1]) + self.calibration[-1])
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def log_odds(texts: Iterable[set[str]], y: np.ndarray) -> dict[str, float]:
    """Of document frequencies, smoothed, less 1.3 standard errors; only what speaks for label 1."""
    one, every = Counter(), Counter()
    for words, label in zip(texts, y):
        every.update(words)
        if label:
            one.update(words)
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - n1)
    out = {}
    for w, n in one.items():
        m = every[w] - n + 0.5
        odds = np.log((n + 0.1) / n1) - np.log(m / n0) - 1.3 * np.sqrt(1 / (n + 0.1) + 1 / m)
        if n > 1 and odds >= EVIDENCE:
            out[w] = float(min(odds, 6.0)) / 3
    return out


class Tiles:
    """Training texts as nodes, their first tokens and those with evidence, with runs of quiet tokens after them.

    Texts are cut after every TILE nodes; a further tile begins with the last node of the one before, whose label it is
    given. Tiles are sorted by length, and nodes lie place by place: those at place k of all tiles that long.
    """

    def __init__(self, lengths: Sequence[int], active: Sequence[Sequence[tuple[int, tuple[float, float, float]]]], y: np.ndarray):
        tiles = []  # nodes (features, label, run after it), and whether the first one's label is given
        for n, a, label in zip(lengths, active, y):
            if n:
                nodes = [*([] if a and a[0][0] == 0 else [(0, (0.0, 0.0, 0.0))]), *a]
                ends = [*(i for i, _ in nodes[1:]), n]
                nodes = [((*x, 1.0), float(bool(label) and max(x) >= TOXIC), end - i - 1) for (i, x), end in zip(nodes, ends)]
                tiles += [([*nodes[max(0, i - 1) : i], *nodes[i : i + TILE]], i > 0, i + TILE >= len(nodes)) for i in range(0, len(nodes), TILE)]
        tiles.sort(key=lambda t: -len(t[0]))
        size = np.array([len(t[0]) for t in tiles], np.int64)
        self.at = np.concatenate([[0], np.cumsum([(size > k).sum() for k in range(size.max(initial=0))])]).astype(np.int64)
        place = [[t[0][k] for t in tiles[: self.at[k + 1] - self.at[k]]] for k in range(len(self.at) - 1)]
        flat = [x for p in place for x in p]
        self.f, self.gold = np.array([x[0] for x in flat]).reshape(-1, 4), np.array([x[1] for x in flat])
        self.runs, self.run = np.unique(np.array([x[2] for x in flat], np.int64), return_inverse=True)
        self.given = np.array([t[1] for t in tiles], bool)
        self.next = np.full(len(flat), -1, np.int64)
        for k in range(len(place) - 1):
            m = len(place[k + 1])
            self.next[self.at[k] : self.at[k] + m] = np.arange(self.at[k + 1], self.at[k + 1] + m)
        self.inner = np.flatnonzero(self.next >= 0)
        # the run after a tile's last node counts where the text ends; elsewhere it is the next tile's
        last = [self.at[n - 1] + r for r, n in enumerate(size)]
        self.tail = np.array([at for at, t in zip(last, tiles) if t[2]], np.int64)
        self.counts = np.ones(len(flat), bool)
        self.counts[: len(tiles)] = ~self.given
        self.seen = np.zeros((2, 2))
        for at in (self.inner, self.tail):
            n, g = self.runs[self.run[at]], self.gold[at].astype(int)
            self.seen[:, 0] += np.bincount(g[n > 0], minlength=2)
            self.seen[0, 0] += np.maximum(n - 1, 0).sum()
            if at is self.inner:
                to = self.gold[self.next[at]].astype(int)
                np.add.at(self.seen, (np.where(n > 0, 0, g), to), 1)

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """Of the conditional log likelihood; theta: emission weights of the toxic state, transitions row by row, start of the toxic state."""
        if not len(self.gold):
            return np.zeros(9)
        step, n = np.exp(theta[4:8].reshape(2, 2)), self.runs
        quiet = step * np.exp([0.0, theta[3]])
        values, v = np.linalg.eig(quiet)  # positive, so the values are real and differ
        order = np.argsort(-np.abs(values))
        v, low = v[:, order], values[order[1]] / values[order[0]]
        back, quiet = np.linalg.inv(v), quiet / values[order[0]]
        powers = np.einsum("ip,np,pj->nij", v, np.stack([np.ones(len(n)), low**n], 1), back)
        across, emit = powers @ step, np.ones((len(self.gold), 2))
        emit[:, 1] = np.exp(np.clip(self.f @ theta[:4], -30, 30))
        first = slice(0, len(self.given))
        forward, backward = np.zeros_like(emit), np.ones_like(emit)
        forward[first] = np.where(self.given[:, None], np.stack([1 - self.gold[first], self.gold[first]], 1), emit[first] * np.exp([0.0, theta[8]]))
        forward[first] /= forward[first].sum(1, keepdims=True)
        over = across[self.run]
        for k in range(1, len(self.at) - 1):
            here, m = slice(self.at[k], self.at[k + 1]), self.at[k + 1] - self.at[k]
            before = slice(self.at[k - 1], self.at[k - 1] + m)
            a = (forward[before, :, None] * over[before]).sum(1) * emit[here]
            forward[here] = a / a.sum(1, keepdims=True)
        backward[self.tail] = powers[self.run[self.tail]].sum(2)
        for k in range(len(self.at) - 2, 0, -1):
            here, m = slice(self.at[k], self.at[k + 1]), self.at[k + 1] - self.at[k]
            before = slice(self.at[k - 1], self.at[k - 1] + m)
            b = (over[before] * (emit[here] * backward[here])[:, None, :]).sum(2)
            backward[before] = b / b.max(1, keepdims=True)
        p = forward * backward
        rest = np.where(self.counts, self.gold - p[:, 1] / p.sum(1), 0.0)
        # expected transitions: into nodes, and inside runs by the derivative of the powers
        b = (emit * backward)[self.next[self.inner]]
        pair = forward[self.inner, :, None] * b[:, None, :]
        pair /= (pair * over[self.inner]).sum((1, 2))[:, None, None]
        ends = forward[self.tail, :, None] * np.ones(2)
        ends /= (ends * powers[self.run[self.tail]]).sum((1, 2))[:, None, None]
        by, by_end = np.zeros((len(n), 2, 2)), np.zeros((len(n), 2, 2))
        np.add.at(by, self.run[self.inner], pair)
        np.add.at(by_end, self.run[self.tail], ends)
        into = step * np.einsum("ncj,nci->ij", by, powers)
        w = np.einsum("cp,ncd,qd->npq", v, by @ step.T + by_end, back)
        mixed = (1 - low**n) / (1 - low)
        w[:, 0, 0] *= n
        w[:, 1, 1] *= n * low ** np.maximum(n - 1, 0)
        w[:, 0, 1] *= mixed
        w[:, 1, 0] *= mixed
        inside = quiet * np.einsum("pi,jq,pq->ij", back, v, w.sum(0))
        emission = rest @ self.f
        emission[3] -= inside[:, 1].sum()  # quiet tokens are labelled clean
        return np.concatenate([emission, (self.seen - into - inside).ravel(), [rest[first].sum()]])


def fit(texts: Sequence[str], y: np.ndarray, share: float, steps: int = 200) -> Field:
    """Without toxic or without other texts, all scores are the share of label 1."""
    texts = [[*map(intern, tokens(t))] for t in texts]
    if not 0 < y.sum() < len(y):
        return Field({}, {}, np.array([0.0, 0, 0, -5]), np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0, 0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    word = log_odds((set(t) for t in texts), y)
    begin = log_odds(({w[:n] for w in t for n in (4, 5) if len(w) >= n} for t in texts), y)
    field = Field(word, begin, np.array([1.0, 0.5, 0.5, -3.0]), np.zeros((2, 2)), np.zeros(2), np.zeros(4))
    active = [field.active(t) for t in texts]
    tiles = Tiles([len(t) for t in texts], active, y)
    theta = np.array([1.0, 0.5, 0.5, -3.0, 0, 0, 0, 0, 0])
    first, second = np.zeros(9), np.zeros(9)
    for i in range(1, steps + 1):  # Adam
        g = tiles.gradient(theta) / len(y) - 2e-3 * theta
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
        theta = theta + 0.1 * first / (1 - 0.9**i) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    field = Field(word, begin, theta[:4], theta[4:8].reshape(2, 2), np.array([0.0, theta[8]]), np.zeros(4))
    x = np.array([field.summary(len(t), field.marginals(len(t), a)) for t, a in zip(texts, active)])
    odds = share / (1 - share) / (y.sum() / (len(y) - y.sum()))
    field.calibration = logistic(x, y, np.where(y == 1, odds, 1.0))
    return field


def scored(docs: DataFrame, field: Field, with_spans: bool = False) -> DataFrame:
    """doc_id, score, and if asked for, spans: array of (start, end, p) in characters of tokens more likely toxic than not."""
    sent = docs.sparkSession.sparkContext.broadcast(field.parts())  # at most what SAMPLE texts hold

    def run(batches):
        own = Field(*sent.value)
        for batch in batches:
            for part, texts in spans(batch, "text"):
                scores, found = [], []
                for t in texts:
                    words = tokens(t)
                    a = own.active(words)
                    p = own.marginals(len(words), a)
                    scores.append(own.score(len(words), p))
                    if with_spans:
                        hit = {i: float(q) for (i, _), q in zip(a, p) if q >= 0.5}
                        found.append([{"start": m.start(), "end": m.end(), "p": hit[i]} for i, m in enumerate(WORDS.finditer(lowered(t))) if i in hit] if hit else [])
                cols, names = [part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"]
                if with_spans:
                    cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                    names.append("spans")
                yield pa.record_batch(cols, names)

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double" + ", spans array<struct<start:int,end:int,p:double>>" * with_spans)


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    return fit(*sample(docs, labels, "toxic", 4, 2, SAMPLE))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold; all columns, every row judged by its own text."""
    field = trained(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(field.parts())

    def run(batches):
        own = Field(*sent.value)
        for batch in batches:
            for part, texts in spans(batch, "text"):
                keep = []
                for t in texts:
                    words = tokens(t)
                    keep.append(own.score(len(words), own.marginals(len(words), own.active(words))) < threshold)
                yield part.filter(pa.array(keep))

    return in_arrow(docs, run, docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, read(spark, sf_dir, "labels")), with_spans=True)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
