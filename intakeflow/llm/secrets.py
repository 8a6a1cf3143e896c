"""Secret scanning: fixed patterns, and a character convolutional network over every candidate.

The patterns give the base spans.  A candidate is a maximal run of at least ``MIN_RUN`` key
characters outside the base spans, with or without a digit; what a base span leaves of a longer run
is one as well.  The network (numpy: character embedding, one convolution, maximum and mean pooling,
one linear unit) reads the candidate with the characters around it.  It is fitted on labelled
findings: the keys of pattern matches without the pattern's prefix, whole and cut short, against
candidates.  A bounded part of them gives the weights to begin with.  Then every finding of every
document trains the network, in the tasks that read the documents, and the tasks' weights are averaged.
All findings, each scored before it trains, calibrate its output (Platt).  All keys set the threshold:
the highest one that still finds ``RECALL`` of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import map_texts, small_batches, written

# The base patterns, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

MIN_RUN = 8           # shortest candidate
BEFORE, INSIDE, AFTER = 24, 48, 8   # characters the network sees; longer candidates are read in steps of INSIDE
TRAIN_DOCS = 20_000   # documents whose runs without a digit the first weights may come from
TRAIN_ROWS = 2_000    # findings per label for the first weights; of runs without a digit MORE as many
MORE = 5
STEP_DOCS = 64        # documents for one step of the training on all findings
STEP_RATE = 0.002
KEPT_KEYS = 128       # a step's keys are filled up to as many by earlier ones of the task
CLEAR = 4.0           # the loss ends where a finding is on its side by so much
GRID, END = 1024, 40  # scores before calibration are counted in steps of 1 / GRID from -END to END
MIN_ROWS = 20         # with fewer findings of a label nothing is fitted and only base spans are reported
RECALL = 0.99
EMBED, WIDTH, FILTERS, STEPS = 8, 5, 16, 1000

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n"
CODES = len(_ALPHABET) + 2  # 0: outside the text, 1: any other character
_CODE = np.ones(128, np.int8)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(2, CODES)
_KEY = np.zeros(128, bool)
_KEY[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"]] = True
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_DIGIT = np.zeros(128, bool)
_DIGIT[[ord(c) for c in "0123456789"]] = True


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that are at least ``least`` long."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


class Texts:
    """A batch of texts as one array of code points, parted by line ends."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        whole = "\n".join(texts)
        self.points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        self.low = np.minimum(self.points, 127)  # 127 is in none of the classes
        self.at = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], int))])
        self._padded: np.ndarray | None = None

    def _by_text(self, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
        doc = np.searchsorted(self.at, start, "right") - 1
        return zip(doc.tolist(), (start - self.at[doc]).tolist(), (end - self.at[doc]).tolist())

    def base(self) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of every text's pattern matches, in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.texts]
        for d, s, e in self._by_text(*runs(_HEX[self.low], MIN_HEX)):
            found[d].append((s, 2, e))
        signs = np.flatnonzero((self.points == 58) | (self.points == 61))  # : and =
        for d in np.unique(np.searchsorted(self.at, signs, "right") - 1).tolist():
            for m in ASSIGN.finditer(self.texts[d]):
                if len(m.group(2)) >= MIN_VALUE:
                    found[d].append((m.start(), 0, m.end()))
        for d, t in enumerate(self.texts):
            if "AKIA" in t:
                for m in ACCESS.finditer(t):
                    if m.end() - m.start() >= MIN_ACCESS:
                        found[d].append((m.start(), 1, m.end()))
        return [sorted(f) for f in found]

    def candidates(self, base: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of every candidate, with starts and ends in the array of all texts."""
        key = _KEY[self.low]
        for d, spans in enumerate(base):
            for s, _, e in spans:
                key[self.at[d] + s:self.at[d] + e] = False
        start, end = runs(key, MIN_RUN)
        return np.searchsorted(self.at, start, "right") - 1, start, end

    def digits(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether there is a digit between."""
        n = np.concatenate([[0], np.cumsum(_DIGIT[self.low])])
        return n[end] > n[start]

    def padded(self) -> np.ndarray:
        """Codes of all texts, each with a row's worth of zeros around it."""
        if self._padded is None:
            gap, code = INSIDE + AFTER, _CODE[self.low].astype(np.uint8)
            self._padded = np.zeros(len(code) + gap * (len(self.texts) + 1), np.uint8)
            for d, (a, b) in enumerate(zip(self.at[:-1].tolist(), self.at[1:].tolist())):
                self._padded[a + gap + (gap - 1) * d:b - 1 + gap + (gap - 1) * d] = code[a:b - 1]
        return self._padded

    def rows(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, Rows]:
        """The candidate of every row that ``windows`` yields, and the rows."""
        each = 1 + np.maximum(0, end - start - MIN_RUN) // INSIDE
        of = np.repeat(np.arange(len(start)), each)
        at = start[of] + (np.arange(len(of)) - (np.cumsum(each) - each)[of]) * INSIDE
        gap = INSIDE + AFTER
        return of, Rows(self.padded(), at + gap + (gap - 1) * doc[of] - BEFORE)

    def windows(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int = 1 << 15):
        """Codes of candidates and their surroundings, one row for every ``INSIDE`` characters of each; a
        rest too short for a candidate is seen as what follows the row before.  Yields (candidate, codes)."""
        each = 1 + np.maximum(0, end - start - MIN_RUN) // INSIDE
        last = np.cumsum(each)
        around = np.arange(-BEFORE, INSIDE + AFTER)
        for k in range(0, int(last[-1]) if len(last) else 0, rows):
            row = np.arange(k, min(k + rows, int(last[-1])))
            of = np.searchsorted(last, row, "right")
            at = (start[of] + (row - (last[of] - each[of])) * INSIDE)[:, None] + around
            inside = (at >= self.at[doc[of]][:, None]) & (at < self.at[doc[of] + 1][:, None] - 1)
            yield of, np.where(inside, _CODE[self.low[np.where(inside, at, 0)]], 0).astype(np.uint8)


def bare_keys(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of the key of every base span, its pattern's prefix taken out of the text;
    spans inside an earlier one are left out.  Keys over 15 characters come a second time, cut to 8 to 15."""
    done = 0
    for s, k, e in spans:
        if s < done:
            continue
        done = e
        begin = ASSIGN.match(text, s).start(2) if k == 0 else s + 4 if k == 1 else s
        left, key, right = text[max(0, s - BEFORE):s], text[begin:e], text[e:e + INSIDE + AFTER]
        short = MIN_RUN + hashlib.md5(key.encode()).digest()[0] % 8
        for part in (key, key[:short])[:2 if len(key) > 15 else 1]:
            yield left + part + right, len(left), len(left) + len(part)


class Rows:
    """Rows of ``Network.SIZE`` codes that begin at ``first``, in order, in an array of codes."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        self.codes, self.first = codes, first

    def __len__(self) -> int:
        return len(self.first)

    def at(self, some: np.ndarray | slice) -> np.ndarray:
        return self.codes[self.first[some][:, None] + np.arange(Network.SIZE)]


def over_rows(h: np.ndarray, n: int, at: np.ndarray, op: np.ufunc) -> np.ndarray:
    """``op`` over the ``n`` rows of ``h`` from every one of ``at`` on, in an order that depends on n only."""
    out, done, size = None, 0, 1
    while True:
        if n & size:
            out = h[at + done] if out is None else op(out, h[at + done])
            done += size
        if done == n:
            return out
        h, size = op(h[:-size], h[size:]), 2 * size


class Network:
    """Character convolutional network with its calibration and threshold; small enough to broadcast."""

    SIZE = BEFORE + INSIDE + AFTER

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {"embed": r.normal(0, 0.3, (CODES, EMBED)),
                  "conv": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
                  "out": r.normal(0, 0.1, 2 * FILTERS), "off": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        emb = self.w["embed"][x]
        cols = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1)  # [n, t, EMBED, WIDTH]
        cols = cols.transpose(0, 1, 3, 2).reshape(len(x), self.SIZE - WIDTH + 1, WIDTH * EMBED)
        h = np.maximum(cols @ self.w["conv"] + self.w["bias"], 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return cols, h, top, pooled, pooled @ self.w["out"] + self.w["off"][0]

    def _tables(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The convolution's sums by character, and by two neighbouring ones."""
        one = np.einsum("ce,kef->kcf", self.w["embed"], self.w["conv"].reshape(WIDTH, EMBED, FILTERS)).astype("f4")
        return one, [(one[k][:, None] + one[k + 1]).reshape(-1, FILTERS) for k in range(0, WIDTH - 1, 2)]

    def _logits_of(self, x: Rows, rows: int = 512) -> np.ndarray:
        """The convolution of what neighbouring rows share is computed once."""
        codes, first = x.codes, x.first
        one, pairs = self._tables()
        bias, n = self.w["bias"].astype("f4"), self.SIZE - WIDTH + 1
        out = np.zeros(len(first))
        for i in range(0, len(first), rows):
            a = first[i:i + rows]
            new = np.minimum(np.diff(a, prepend=a[0] - self.SIZE), self.SIZE)  # codes that the row before lacks
            end = np.cumsum(new)
            c = codes[np.arange(end[-1]) + np.repeat(a + self.SIZE - end, new)].astype(np.int32)
            two = c[:-1] * CODES + c[1:]
            h = one[WIDTH - 1][c[WIDTH - 1:]] + bias
            for k, t in enumerate(pairs):
                h += t[two[2 * k:2 * k + len(h)]]
            np.maximum(h, 0, out=h)
            at = end - self.SIZE
            out[i:i + rows] = (over_rows(h, n, at, np.maximum) @ self.w["out"][:FILTERS]
                               + over_rows(h, n, at, np.add) / n @ self.w["out"][FILTERS:] + self.w["off"][0])
        return out

    def logits(self, x: np.ndarray | Rows) -> np.ndarray:
        """As ``_forward``, with the convolution looked up: one table for two neighbouring characters."""
        if isinstance(x, Rows):
            return self._logits_of(x)
        one, pairs = self._tables()
        bias, n = self.w["bias"].astype("f4"), self.SIZE - WIDTH + 1
        out = np.zeros(len(x))
        for i in range(0, len(x), 512):
            c = x[i:i + 512].astype(np.int32)
            two = c[:, :-1] * CODES + c[:, 1:]
            h = one[WIDTH - 1][c[:, WIDTH - 1:]] + bias
            for k, t in enumerate(pairs):
                h += t[two[:, 2 * k:2 * k + n]]
            np.maximum(h, 0, out=h)
            out[i:i + 512] = h.max(1) @ self.w["out"][:FILTERS] + h.mean(1) @ self.w["out"][FILTERS:] + self.w["off"][0]
        return out

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))

    def score(self, x: np.ndarray | Rows) -> np.ndarray:
        """Calibrated probability of a secret."""
        return self.calibrated(self.logits(x))

    def _step(self, x: np.ndarray, forward: tuple, d: np.ndarray, m: dict, v: dict, step: int, rate: float) -> None:
        """One step of Adam, where ``d`` is the loss's derivative by the rows' logits."""
        cols, h, top, pooled, _ = forward
        dp = d[:, None] * self.w["out"]
        dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
        n, f = np.indices(top.shape)
        dh[n, top, f] += dp[:, :FILTERS]
        dh *= h > 0
        flat = cols.reshape(-1, cols.shape[2])
        dcols = (dh @ self.w["conv"].T).reshape(len(x), -1, WIDTH, EMBED)
        demb = np.zeros((len(x), self.SIZE, EMBED))
        for k in range(WIDTH):
            demb[:, k:k + dcols.shape[1]] += dcols[:, :, k]
        dembed = np.zeros_like(self.w["embed"])
        np.add.at(dembed, x, demb)
        grad = {"out": pooled.T @ d, "off": np.array([d.sum()]), "conv": flat.T @ dh.reshape(-1, FILTERS),
                "bias": dh.sum((0, 1)), "embed": dembed}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            self.w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam on the logistic loss, classes weighted evenly; a fifth of the rows is held out."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        held, rows = order[:len(x) // 5], order[len(x) // 5:]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(p) for k, p in self.w.items()}
        for step in range(1, STEPS + 1):
            b = r.choice(rows, min(128, len(rows)), replace=False)
            forward = self._forward(x[b])
            d = (1 / (1 + np.exp(-np.clip(forward[-1], -40, 40))) - y[b]) * weight[b] / len(b)
            self._step(x[b], forward, d, m, v, step, 0.01)
        z, t = self.logits(x[held]), y[held]
        for _ in range(200):  # Platt scaling by gradient steps
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))
            self.slope -= 0.05 * float(((p - t) * z).mean())
            self.shift -= 0.05 * float((p - t).mean())
        found = np.sort(self.score(x[held][t == 1]))
        if len(found):
            self.threshold = float(found[int((1 - RECALL) * len(found))])


def keys_of(t: Texts, base: list[list[tuple[int, int, int]]]) -> Rows:
    """Rows of the bare keys of a batch."""
    keys = [k for d, spans in enumerate(base) for k in bare_keys(t.texts[d], spans)]
    bare = Texts([k[0] for k in keys])
    start, end = (bare.at[:-1] + np.array([k[i] for k in keys], int) for i in (1, 2))
    return bare.rows(np.arange(len(keys)), start, end)[1]


def binned(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -END, END) * GRID).astype(int)


class Training:
    """A copy of a network trained on all findings of the documents that one task reads.

    The three kinds of findings (keys, runs with a digit, runs without) weigh in a step as they do in the first
    weights' rows, whatever their numbers.  The loss is the logistic one less its value at ``CLEAR``, at least 0:
    findings on their side by more are scored and counted, but move nothing.
    """

    def __init__(self, net: Network, keys: np.ndarray):
        self.net = Network()
        self.net.w = {k: w.copy() for k, w in net.w.items()}
        self.m = {k: np.zeros_like(w) for k, w in net.w.items()}
        self.v = {k: np.zeros_like(w) for k, w in net.w.items()}
        self.steps = 0
        self.kept = keys
        self.counts = np.zeros((2, 2 * END * GRID + 1), np.int64)  # findings by label and score before training

    def add(self, texts: list[str]) -> None:
        t = Texts(texts)
        base = t.base()
        keys = keys_of(t, base)
        doc, start, end = t.candidates(base)
        of, others = t.rows(doc, start, end)
        z = self.net.logits(others)
        for label, seen in ((1, self.net.logits(keys)), (0, z)):
            np.add.at(self.counts[label], binned(seen) + END * GRID, 1)
        positive = np.concatenate([keys.at(slice(None)), self.kept[:max(0, KEPT_KEYS - len(keys))]])
        self.kept = positive[:KEPT_KEYS]
        digit = t.digits(start, end)[of]
        share = np.where(digit, 0.5 / (1 + MORE), 0.5 * MORE / (1 + MORE))
        weight = share / np.where(digit, max(1, digit.sum()), max(1, (~digit).sum()))
        self._learn(positive, others, np.flatnonzero(z > -CLEAR), weight)

    def _learn(self, positive: np.ndarray, others: Rows, some: np.ndarray, weight: np.ndarray,
               rows: int = 1024) -> None:
        """Steps over ``some`` of the other rows, with all positive ones in each."""
        n, parts = len(positive), max(1, -(-len(some) // rows))
        for i in range(parts):
            part = some[i * rows:(i + 1) * rows]
            x = np.concatenate([positive, others.at(part)])
            y = np.arange(len(x)) < n
            w = np.concatenate([np.full(n, 0.5 / max(1, n) / parts), weight[part]])
            forward = self.net._forward(x)
            z = forward[-1]
            d = np.where(np.where(y, z, -z) < CLEAR, (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * w, 0)
            on = d != 0
            if on.any():
                self.steps += 1
                self.net._step(x[on], tuple(f[on] for f in forward), d[on], self.m, self.v, self.steps, STEP_RATE)

    def result(self) -> pd.DataFrame:
        """(kind, at, value): the findings by label (0, 1) and score, and the weights times their number (2)."""
        frames = []
        for label in (0, 1):
            at = np.flatnonzero(self.counts[label])
            frames.append(pd.DataFrame({"kind": label, "at": at, "value": self.counts[label][at].astype(float)}))
        flat = np.concatenate([self.net.w[k].ravel() for k in sorted(self.net.w)]) * float(self.counts.sum())
        frames.append(pd.DataFrame({"kind": 2, "at": np.arange(len(flat)), "value": flat}))
        return pd.concat(frames)


def calibrate(net: Network, z: np.ndarray, counts: np.ndarray) -> None:
    """Platt scaling by Newton steps, ``counts`` being the findings by label with the scores ``z``."""
    n0, n1 = counts.sum(1)
    goal = ((0, 1 / (n0 + 2)), (1, (n1 + 1) / (n1 + 2)))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        e = sum(counts[k] * (p - t) for k, t in goal)
        q = counts.sum(0) * np.maximum(p * (1 - p), 1e-12)
        g = np.array([(e * z).sum(), e.sum()])
        curve = np.array([[(q * z * z).sum(), (q * z).sum()], [(q * z).sum(), q.sum()]])
        move = np.linalg.solve(curve + 1e-6 * np.eye(2), g)
        a, b = a - float(np.clip(move[0], -0.5, 0.5)), b - float(np.clip(move[1], -0.5, 0.5))
    net.slope, net.shift = (a, b) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_rows: int = TRAIN_ROWS) -> Network | None:
    """A network fitted on the findings of all documents of ``docs (text, ...)``; None with too few of either
    label.  Its first weights come from ``train_rows`` findings per label (``MORE`` times that of runs without
    a digit, which are taken of about ``train_docs`` documents), chosen by hashes.  The calibration and the
    threshold come from all findings."""
    first = first_weights(docs, train_docs, train_rows)
    if first is None:
        return None
    net, some_keys = first
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = None
        for b in batches:
            mine = mine or Training(net, some_keys)
            for i in range(0, len(b), STEP_DOCS):
                mine.add(list(b["text"][i:i + STEP_DOCS]))
        if mine:
            yield mine.result()

    whole = F.sum(F.round(F.col("value") * (1 << 20)).cast("decimal(38,0)"))  # the same in any order
    got = (texts.mapInPandas(train, "kind int, at int, value double").groupBy("kind", "at")
           .agg(whole.alias("n")).collect())
    counts, flat = np.zeros((2, 2 * END * GRID + 1)), np.zeros(sum(w.size for w in net.w.values()))
    for r in got:
        (flat if r.kind == 2 else counts[r.kind])[r.at] = int(r.n) / (1 << 20)
    flat /= counts.sum()
    for k in sorted(net.w):
        net.w[k], flat = flat[:net.w[k].size].reshape(net.w[k].shape), flat[net.w[k].size:]
    some = np.flatnonzero(counts.any(0))
    calibrate(net, some / GRID - END, counts[:, some])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = Texts(list(b["text"]))
            yield pd.DataFrame({"at": binned(net.logits(keys_of(t, t.base())))})

    found = sorted(tuple(r) for r in texts.mapInPandas(keys, "at int").groupBy("at").count().collect())
    below = np.cumsum([n for _, n in found])
    lost = int((1 - RECALL) * below[-1])
    net.threshold = float(net.calibrated(np.array(found[int(np.searchsorted(below, lost, "right"))][0] / GRID)))
    return net


def first_weights(docs: DataFrame, train_docs: int, train_rows: int) -> tuple[Network, np.ndarray] | None:
    """The network that the training on all findings begins with, and some keys; None with too few findings of
    either label."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    share = min(1.0, train_docs / max(1, docs.count()))
    texts = texts.withColumn("drawn", F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def findings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = Texts(list(b["text"]))
            drawn = b["drawn"].to_numpy()
            base = t.base()
            rows = []
            rows += [(1, r.tobytes()) for r in keys_of(t, base).at(slice(None))]
            doc, start, end = t.candidates(base)
            digit = t.digits(start, end)
            used = drawn[doc] | digit
            doc, start, end, digit = doc[used], start[used], end[used], digit[used]
            for of, x in t.windows(doc, start, end):
                for i, r in zip(of, x):
                    w = r.tobytes()
                    if digit[i]:
                        rows.append((0, w))
                    elif hashlib.md5(w).digest()[0] < 8:  # one run without a digit in 32
                        rows.append((-1, w))
            yield pd.DataFrame(rows, columns=["label", "codes"])

    small_batches(docs.sparkSession)
    found = texts.mapInPandas(findings, "label int, codes binary")
    rows = written(found.groupBy("label", "codes").count().select("label", "codes", F.xxhash64("codes").alias("h")),
                   "findings")
    some = [r for k, n in ((-1, MORE * train_rows), (0, train_rows), (1, train_rows))
            for r in rows.where(F.col("label") == k).orderBy("h", "codes").limit(n).collect()]
    y = np.array([r.label > 0 for r in some], float)
    if min((y == 0).sum(), (y == 1).sum()) < MIN_ROWS:
        return None
    x = np.frombuffer(b"".join(bytes(r.codes) for r in some), np.uint8).reshape(len(some), -1)
    net = Network()
    net.fit(x, y)
    return net, x[y == 1][:KEPT_KEYS]


def spans_of(texts: list[str], net: Network | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of every text's spans: all base ones, and the candidates outside them that
    reach the threshold."""
    t = Texts(texts)
    found = t.base()
    if net is not None:
        doc, start, end = t.candidates(found)
        best = np.zeros(len(doc))
        of, rows = t.rows(doc, start, end)
        np.maximum.at(best, of, net.score(rows))
        on = best >= net.threshold
        for d, s, e in t._by_text(start[on], end[on]):
            found[d].append((s, 3, e))
    return [sorted(f) for f in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones taken together, replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        def run(texts):
            found = spans_of(["" if t is None else t for t in texts], shared.value)
            base = [[x for x in f if x[1] < 3] for f in found]
            out = {f"n_{KINDS[k]}": [sum(x[1] == k for x in f) for f in base] for k in range(3)}
            return out | {"base_sha256": [hashlib.sha256(joined(f).encode()).hexdigest() for f in base],
                          "spans": [joined(f) for f in found]}
        return run

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), start,
                     {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string",
                      "spans": "string"})


def redact(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by a mark and ``n_chars``, where there is one,
    following the text.  Null texts stay null; all other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    columns = docs.columns

    def start():
        def run(texts):
            found = spans_of(["" if t is None else t for t in texts], shared.value)
            return {"_redacted": [redacted(t, f) if f else t for t, f in zip(texts, found)]}
        return run

    out = map_texts(docs, start, {"_redacted": "string"}).withColumnRenamed("_redacted", "text")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in columns])
