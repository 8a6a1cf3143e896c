"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given per document, so a token's training label is inferred first: within the fitting
sample a token of a toxic document is marked when its word or a leading part of it is found at
least ``RATIO`` times as often in toxic documents as in clean ones and in a ``SHARE`` of them; tokens of
clean documents are unmarked.  The field has two states (other, toxic), hashed word, prefix and
suffix features for its state scores and a transition matrix; it is trained by maximum likelihood
(forward-backward gradients) on windows of labelled tokens.  Scoring runs forward-backward over
every token of every whole text; the marginals give the offending offsets, and a calibrated
logistic unit over the largest marginal and their sum gives the document score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp
from struct import pack
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import WordCache, map_texts, small_batches
from intakeflow.llm.langid import excerpt

TRAIN_TOXIC, TRAIN_CLEAN = 1500, 3000   # labelled documents in the fitting sample ...
TRAIN_CHARS = 10_000                    # ... of longer ones, windows with so many characters together
RATIO, SHARE = 20.0, 0.01               # a marked word: odds against clean documents, share of toxic ones
DIM = 1 << 18                           # hashed features
SIDE = 6                                # tokens on either side of a training window's centre
STEPS = 60
RATE = (0.15, 0.05, 0.02, 0.02)         # step sizes of state weights, their constant, moves and beginnings
EXACT = 1e-12                           # bound on the error of marginals from the chunked recursion
CHUNK = 256                             # tokens per chunk of the recursion
PREDICT = 0.7

_PUNCT = ".,;:!?\"'()[]{}«»“”„‘’…–—-*_"


def features(word: str) -> list[str]:
    """The word without punctuation around it, its leading four and five letters, and its ending."""
    w = word.lower().strip(_PUNCT)
    return ["w" + w, "4" + w[:4], "5" + w[:5], "e" + w[-3:]]


def hashed(word: str) -> list[int]:
    return [crc32(f.encode()) % DIM for f in features(word)]


class Field:
    """Two-state conditional random field and the document calibration; small enough to broadcast."""

    def __init__(self):
        self.weight = np.zeros(DIM)
        self.bias = -4.0
        self.move = np.array([[0.5, -0.5], [-0.5, 0.0]])  # log scores of moving from state to state
        self.begin = np.array([0.0, -2.0])
        self.unit = np.array([0.0, 0.0, -3.0])  # of log-odds of the largest marginal, of log1p(sum), constant
        self._cache = self._values = None

    def __getstate__(self):
        kept = np.flatnonzero(self.weight)
        return self.__dict__ | {"_cache": None, "_values": None, "weight": (kept, self.weight[kept])}

    def __setstate__(self, state):
        kept, values = state["weight"]
        self.__dict__.update(state)
        self.weight = np.zeros(DIM)
        self.weight[kept] = values

    # training ---------------------------------------------------------------------------------

    def fit(self, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """rows [window, token, feature], labels [window, token] (-1: no token), weight per window."""
        n, length, _ = rows.shape
        real = labels >= 0
        y = np.maximum(labels, 0)
        size = weight.sum()
        flat = rows.reshape(-1, rows.shape[2])
        theta = [self.weight, np.array([self.bias]), self.move, self.begin]
        m = [np.zeros_like(t) for t in theta]
        v = [np.zeros_like(t) for t in theta]
        ahead = real[:, 1:] & real[:, :-1]
        first = real & np.concatenate([np.ones((n, 1), bool), ~real[:, :-1]], 1)
        for step in range(1, STEPS + 1):
            w, b, move, begin = theta
            score = np.zeros((n, length, 2))
            score[:, :, 1] = (w[flat].sum(1).reshape(n, length) + b[0])
            score = np.where(real[:, :, None], score, 0)
            f = np.zeros((n, length, 2))
            back = np.zeros((n, length, 2))
            for t in range(length):
                into = np.logaddexp(f[:, t - 1, :1] + move[0], f[:, t - 1, 1:] + move[1]) if t else 0
                f[:, t] = score[:, t] + np.where(first[:, t, None], begin, into)
            for t in range(length - 2, -1, -1):
                nxt = score[:, t + 1] + back[:, t + 1]
                out = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
                back[:, t] = np.where(ahead[:, t, None], out, 0)
            z = f + back
            logz = np.logaddexp(z[:, :, 0], z[:, :, 1])
            p = np.exp(z - logz[:, :, None])[:, :, 1]
            d = np.where(real, p - y, 0) * weight[:, None] / size
            gw = np.bincount(flat.ravel(), np.repeat(d.ravel(), rows.shape[2]), DIM) + 1e-6 * w
            pair = (f[:, :-1, :, None] + move + (score[:, 1:] + back[:, 1:])[:, :, None, :]) - logz[:, 1:, None, None]
            pair = np.where(ahead[:, :, None, None], np.exp(np.minimum(pair, 0)), 0) * weight[:, None, None, None]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1][ahead], y[:, 1:][ahead]), np.broadcast_to(weight[:, None], ahead.shape)[ahead])
            gm = (pair.sum((0, 1)) - seen) / size + 1e-3 * move
            gb = np.array([0.0, (np.where(first, p - y, 0) * weight[:, None]).sum() / size]) + 1e-3 * begin
            for i, g in enumerate([gw, np.array([d.sum()]), gm, gb]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                theta[i] -= RATE[i] * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-9)
        # weights of rare hash buckets that hardly moved add nothing but size
        theta[0][np.abs(theta[0]) < 1e-3] = 0
        self.weight, self.bias, self.move, self.begin = theta[0], float(theta[1][0]), theta[2], theta[3]

    def calibrate(self, lists: list[list[str]], toxic: np.ndarray) -> None:
        """Logistic unit over (log-odds of largest marginal, log1p of sum), slopes kept positive."""
        x = np.array([evidence(p) for p in self.marginals(lists)])
        x = np.concatenate([x, np.ones((len(x), 1))], 1)
        u = np.array([0.3, 0.3, 0.0])
        m, v = np.zeros(3), np.zeros(3)
        for step in range(1, 401):
            p = 1 / (1 + np.exp(-np.clip(x @ u, -40, 40)))
            g = x.T @ (p - toxic) / len(x) + np.array([1e-3, 1e-3, 0]) * u
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            u -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
            u[:2] = np.maximum(u[:2], 0.01)
        self.unit = u

    # scoring ----------------------------------------------------------------------------------

    def state_scores(self, words: list[str]) -> Iterator[bytes]:
        if self._values is None:
            self._values = self.weight.tolist()
        value = self._values
        for w in words:
            s = self.bias + sum(value[f] for f in hashed(w))
            yield pack("<d", exp(min(max(s, -30.0), 30.0)))

    def marginals(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Probability of the toxic state at every token of every list of words.

        The ratio of the two forward values is a fractional linear map of the one before; such a
        map shrinks distances (in the projective metric) by a factor that follows from the
        transition matrix.  So chunks are run side by side, each after as many preceding tokens as
        bring the error below ``EXACT``; lists are reset at their first and last tokens.
        """
        if self._cache is None:
            self._cache = WordCache(self.state_scores)
        sizes = np.array([len(w) for w in lists])
        if not sizes.sum():
            return [np.zeros(0) for _ in lists]
        x = np.frombuffer(b"".join(b"".join(v) for v in self._cache.look_up(lists)))
        a = np.exp(self.move)
        turn = abs(np.log(a[0, 0] * a[1, 1] / (a[0, 1] * a[1, 0]))) / 4
        shrink = max(np.tanh(turn), 1e-6)
        warm = int(np.ceil(np.log(EXACT / 240) / np.log(shrink))) if shrink < 1 else len(x)
        ends = np.cumsum(sizes)
        first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
        first[(ends - sizes)[sizes > 0]] = True
        last[ends[sizes > 0] - 1] = True
        start = np.exp(self.begin[1] - self.begin[0])
        forward = _scan(x, first, warm, lambda r, x, reset: np.where(
            reset, start, (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])) * x)
        # backward over the reversed sequence; s covers what follows a token, so it is shifted by one
        nx = np.concatenate([x[1:], [1.0]])
        backward = _scan(nx[::-1], last[::-1], warm, lambda s, x, reset: np.where(
            reset, 1.0, (a[1, 0] + a[1, 1] * x * s) / (a[0, 0] + a[0, 1] * x * s)))[::-1]
        odds = forward * backward
        return np.split(odds / (1 + odds), ends[:-1])

    def scores(self, lists: list[list[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
        p = self.marginals(lists)
        x = np.array([evidence(q) for q in p]).reshape(-1, 2)
        z = x @ self.unit[:2] + self.unit[2]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), p


def evidence(p: np.ndarray) -> tuple[float, float]:
    """Log-odds of the largest marginal (between -6 and 6) and log1p of the sum of those over 0.1."""
    if not len(p):
        return -6.0, 0.0
    top = float(np.clip(p.max(), 1e-6, 1 - 1e-6))
    return float(np.clip(np.log(top / (1 - top)), -6, 6)), float(np.log1p(p[p > 0.1].sum()))


def _scan(x: np.ndarray, reset: np.ndarray, warm: int, step) -> np.ndarray:
    """Run ``r = step(r, x, reset)`` over a sequence in chunks side by side, each warmed up."""
    n = len(x)
    chunks = -(-n // CHUNK)
    pad = chunks * CHUNK - n
    xs = np.concatenate([np.ones(warm), x, np.ones(pad)])
    rs = np.concatenate([np.ones(warm, bool), reset, np.ones(pad, bool)])
    out = np.empty((CHUNK, chunks))
    at = np.arange(chunks) * CHUNK
    r = np.ones(chunks)
    for k in range(warm + CHUNK):
        r = step(r, xs[at + k], rs[at + k])
        if k >= warm:
            out[k - warm] = r
    return out.T.ravel()[:n]


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN,
        chars: int = TRAIN_CHARS) -> Field | None:
    """A field fitted on ``docs (doc_id, text)`` joined with ``labels (doc_id, toxic)``.

    The sample holds at most ``toxic`` and ``clean`` documents, chosen by a hash of doc_id from those that
    have a text; of texts over ``chars`` characters even windows are taken.  Null ids, texts and labels are
    left out; an id that is labelled both ways counts as toxic, and of an id's texts the smallest is taken.
    None where either label has no document.
    """
    known = labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.length("text") > 0)
    # ids only: the texts of the sample are read afterwards
    there = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    some = [r for k, n in ((1, toxic), (0, clean)) for r in there.where(F.col("toxic") == k)
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not some:
        return None
    drawn = docs.sparkSession.createDataFrame([tuple(r) for r in some], "doc_id long, toxic int")

    def cut(batches):
        for b in batches:
            yield b.assign(text=[excerpt(t, chars) for t in b["text"]])

    small_batches(docs.sparkSession)
    rows = (texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")
            .mapInPandas(cut, "doc_id long, toxic int, text string")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
            .orderBy("doc_id").toLocalIterator())
    lists, y = [], []
    same: dict[str, str] = {}  # one object for all occurrences of a word
    for r in rows:
        lists.append([same.setdefault(w, w) for w in r.text.split()])
        y.append(r.toxic)
    y = np.array(y)
    if not len(y) or y.min() == y.max():
        return None
    return learn(lists, y)


def learn(lists: list[list[str]], y: np.ndarray) -> Field:
    """The field of labelled documents given as lists of words."""
    known: dict[str, list[str]] = {}
    in_toxic, in_clean = Counter(), Counter()
    seen: set[tuple[int, int]] = set()
    documents = [0, 0]
    for words, k in zip(lists, y):
        parts = set()
        # copies of a document say no more than one of them: the smallest hash of three words tells them
        key = (int(k), min((crc32(f"{a} {b} {c}".encode()) for a, b, c in zip(words, words[1:], words[2:])), default=0))
        if key in seen:
            continue
        seen.add(key)
        documents[int(k)] += 1
        for w in set(words):
            if w not in known:
                known[w] = [f for f in features(w)[:3] if len(f) > 3]
            parts.update(known[w])
        (in_toxic if k else in_clean).update(parts)
    least = max(3, int(SHARE * documents[1]))
    n1, n0 = documents[1] + 1, documents[0] + 1
    marked = {f for f, c in in_toxic.items()
              if c >= least and (c / n1) / ((in_clean[f] + 0.5) / n0) >= RATIO}
    hot = {w for w, fs in known.items() if any(f in marked for f in fs)}
    r = np.random.default_rng(3)
    rows, labels, weight = [], [], []

    def window(words: list[str], centre: int, toxic: int) -> None:
        some = words[max(0, centre - SIDE):centre + SIDE + 1]
        gap = 2 * SIDE + 1 - len(some)
        rows.append([hashed(w) for w in some] + [[0] * 4] * gap)
        labels.append([int(bool(toxic) and w in hot) for w in some] + [-1] * gap)
        weight.append(1.0)

    for words, k in zip(lists, y):
        at = [i for i, w in enumerate(words) if w in hot] if k else []
        for i in at[:4]:
            window(words, i, k)
        if words and (at or not k):  # toxic documents without a marked token tell nothing about tokens
            for i in r.integers(0, len(words), 1):
                window(words, int(i), k)
    field = Field()
    if any(1 in x for x in labels):
        field.fit(np.array(rows), np.array(labels), np.array(weight))
    field.calibrate(lists, y)
    return field


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` without text, followed by score, predicted and spans (offsets of toxic tokens).

    Offsets are code points, end exclusive.  A null or empty text, and every text where nothing was
    fitted, has the score of no evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    token = re.compile(r"\S+")

    def start():
        def run(texts):
            texts = ["" if t is None else t for t in texts]
            if shared.value is None:
                value, spans = np.zeros(len(texts)), [[] for _ in texts]
            else:
                value, marginals = shared.value.scores([t.split() for t in texts])
                spans = []
                for t, p in zip(texts, marginals):
                    hit = set(np.flatnonzero(p >= 0.5).tolist())
                    spans.append([{"start": m.start(), "end": m.end()} for i, m in enumerate(token.finditer(t))
                                  if i in hit] if hit else [])
            return {"score": value, "predicted": (value >= PREDICT).astype("i4"), "spans": spans}
        return run

    return map_texts(docs, start, {"score": "double", "predicted": "int",
                                   "spans": "array<struct<start:int,end:int>>"})
