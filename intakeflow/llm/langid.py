"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary.  The probability of
a text is the sum over all its segmentations into pieces of the product of their probabilities;
pieces begin at word starts and never cross blanks, so it is a product over words, and the
forward algorithm gives each word's sum.  The piece probabilities are learned by
expectation-maximisation (forward-backward expected counts) from a bounded sample of distinct texts
of every language; scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intakeflow.llm.common import WordCache, map_texts, small_batches

TRAIN_DOCS = 300        # texts per language in the fitting sample ...
TRAIN_CHARS = 10_000    # ... of longer ones, windows with so many characters together
TRAIN_WINDOWS = 10
ROUNDS = 3
PAD_OVER = 32           # in learning, words over so many characters are filled up to a common length
ROW_FLOATS = 2_000_000  # bounds the arrays of one forward pass
CACHE_FLOATS = 8_000_000   # bounds the values of one text, or of several, looked at at once
FLOOR = 1e-9            # probability of a character no piece covers

_BASE = np.uint64(0x9E3779B97F4A7C15)                                    # of the polynomial hash
_SPREAD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # of the hash tables
_BITS = 20

_LETTER = re.compile(r"[^\W\d_]")
_SQL_LETTER = r"[\p{L}\p{N}&&[^\p{Nd}]]"  # the same for Spark


def vocabulary(path: str) -> list[str]:
    """Pieces of the public vocabulary, word starts written as the usual low line block."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return sorted({p.lower() for p in pieces})


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def words_of(text: str) -> list[str]:
    return text.lower().split()


def excerpt(text: str, chars: int = TRAIN_CHARS) -> str:
    """The text, or of a longer one ``TRAIN_WINDOWS`` even windows over its words with a letter; words
    that a window cuts are left out where it holds whole ones."""
    if len(text) <= chars:
        return text
    text = " ".join(w for w in text.split() if _LETTER.search(w))
    if len(text) <= chars:
        return text
    size = max(1, chars // TRAIN_WINDOWS)
    out = []
    for k in range(TRAIN_WINDOWS):
        at = k * (len(text) - size) // max(1, TRAIN_WINDOWS - 1)
        window = text[at:at + size]
        first = 0 if at == 0 or text[at - 1] == " " else window.find(" ") + 1
        last = size if at + size >= len(text) or text[at + size] == " " else window.rfind(" ")
        out.append(window[first:last] if first < last else window)
    return " ".join(out)


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)        # position of the stand-in for uncovered characters
        self.none = len(pieces) + 1    # position that always has probability zero
        self.longest = max(map(len, pieces), default=1)
        # pieces by a 64-bit polynomial hash: two tables, the second for slots that are taken
        codes = [np.frombuffer(p.encode("utf-32-le"), "<u4").astype("u8") for p in pieces]
        key = np.zeros(len(pieces), "u8")
        for k in range(self.longest):
            on = np.array([i for i, c in enumerate(codes) if len(c) > k], int)
            if len(on):
                key[on] = key[on] * _BASE + np.array([codes[i][k] for i in on], "u8")
        at = self._slots(key)
        self.tables = []
        left = np.arange(len(pieces))
        for slot in at:
            ids, keys = np.full(1 << _BITS, self.none, np.int32), np.zeros(1 << _BITS, "u8")
            _, first = np.unique(slot[left], return_index=True)
            some = left[first]
            ids[slot[some]], keys[slot[some]] = some, key[some]
            self.tables.append((ids, keys))
            left = np.setdiff1d(left, some)
        assert not len(left), "pieces share slots in both tables"

    @staticmethod
    def _slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((key * m >> np.uint64(64 - _BITS)).astype(np.int64) for m in _SPREAD)

    def arcs(self, words: list[str], n: int) -> np.ndarray:
        """Piece numbers [word, end, length - 1] of words with n characters each, for all lengths that fit."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype("u8").reshape(-1, n)
        out = np.full((len(words), n + 1, min(n, self.longest)), self.none, np.int32)
        prefix = np.zeros((len(words), n + 1), "u8")
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _BASE + codes[:, j]
        power = np.uint64(1)
        for m in range(1, min(n, self.longest) + 1):
            power = np.uint64(int(power) * int(_BASE) % (1 << 64))
            key = prefix[:, m:] - prefix[:, :-m] * power
            found = out[:, m:, m - 1]
            for (ids, keys), slot in zip(self.tables, self._slots(key)):
                hit = keys[slot] == key
                found[hit] = ids[slot[hit]]
        alone = out[:, 1:, 0]
        alone[alone == self.none] = self.size
        return out

    def batches(self, words: list[str], wide: int = 1, pad: bool = False) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of equal length together, within ``ROW_FLOATS``: (positions, arcs).  ``wide``: by
        how much the arrays are wider than those of a few languages.  ``pad``: words over ``PAD_OVER``
        characters of like length together, filled up with a character that no piece has."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w) + 1
            if pad and n > PAD_OVER:
                unit = 1 << (n.bit_length() - 3)
                n = -(-n // unit) * unit
            by.setdefault(n, []).append(i)
        for n, at in sorted(by.items()):
            step = max(1, ROW_FLOATS // ((n + 1) * min(n, self.longest) * wide))
            for k in range(0, len(at), step):
                some = at[k:k + step]
                yield some, self.arcs([("▁" + words[i]).ljust(n, "\0") for i in some], n)

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log sum over segmentations, [word, language], for p [piece, language]: forward algorithm."""
        out = np.empty((len(words), p.shape[1]))
        for at, arcs in self.batches(words, 1 + p.shape[1] // 32):
            rows, ends, longest = arcs.shape
            # longest - 1 zeros before the start; sums are rescaled now and then
            a = np.zeros((rows, longest - 1 + ends, p.shape[1]))
            a[:, longest - 1] = 1.0
            scale = np.zeros((rows, p.shape[1]))
            for j in range(1, ends):
                hi = longest - 1 + j
                # lengths 1..longest start at j-1, j-2, ...
                a[:, hi] = np.einsum("rlg,rlg->rg", a[:, hi - longest:hi][:, ::-1], p[arcs[:, j]])
                if j % 8 == 0:
                    m = a[:, hi].copy()
                    a[:, hi - longest + 1:hi + 1] /= m[:, None]
                    scale += np.log(m)
            out[at] = np.log(a[:, -1]) + scale
        return out

    def learn(self, counts: Counter, rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities of one language from word counts, by EM over all segmentations.

        Forward and backward sums are kept as logarithms, so long words (whole sentences in scripts
        without blanks) count as well.  What words are filled up with adds the same factor to all of
        a word's segmentations, and its own count is dropped.
        """
        words = sorted(counts)
        weight = np.array([counts[w] for w in words], float)
        p = np.zeros(self.none + 1)
        for at, arcs in self.batches(words, pad=True):  # start: how often each piece occurs at all, shorter ones rarer
            p += np.bincount(arcs.ravel(), np.repeat(weight[at], arcs[0].size), len(p))
        p[self.none] = 0
        for r in range(rounds + 1):
            if r:
                got = np.zeros_like(p)
                for at, arcs in self.batches(words, pad=True):
                    rows, ends, longest = arcs.shape
                    q = p[arcs]
                    f = np.zeros((rows, ends))
                    b = np.zeros((rows, ends))
                    for j in range(1, ends):
                        m = min(j, longest)
                        near = np.exp(f[:, j - m:j][:, ::-1] - f[:, j - 1:j])
                        f[:, j] = f[:, j - 1] + np.log(np.einsum("rl,rl->r", near, q[:, j, :m]))
                    for j in range(ends - 2, -1, -1):
                        m = min(ends - 1 - j, longest)
                        k = np.arange(m)
                        near = np.exp(b[:, j + 1:j + 1 + m] - b[:, j + 1:j + 2])
                        b[:, j] = b[:, j + 1] + np.log(np.einsum("rl,rl->r", near, q[:, j + 1 + k, k]))
                    total = f[:, -1:]
                    for m in range(1, min(longest, ends - 1) + 1):
                        e = np.exp(f[:, :ends - m] + b[:, m:] - total) * q[:, m:, m - 1] * weight[at][:, None]
                        got += np.bincount(arcs[:, m:, m - 1].ravel(), e.ravel(), len(p))
                p = got
            p[:self.size] += 0.01
            p[self.none] = 0
            p[self.size] = 0
            p /= p.sum()
            p[self.size] = FLOOR
        return p


class Model:
    """Languages, vocabulary and piece probabilities; small enough to broadcast (pieces x languages)."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self._cache = None

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "p": self.p, "_cache": None}

    def posteriors(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Posterior of every language under even priors; None for no letter."""
        if self._cache is None:
            lattice = Lattice(self.pieces)
            np.seterr(over="ignore")  # hashes wrap around
            self._cache = WordCache(lambda ws: (r.tobytes() for r in lattice.log_probability(ws, self.p)))
        if not self.languages:
            yield from [None] * len(texts)
            return
        lists = [words_of(t) if t is not None and _LETTER.search(t) else [] for t in texts]
        # many texts at once, or as many words as fit
        part, step = [], CACHE_FLOATS // len(self.languages)
        for words in lists:
            if part and sum(map(len, part)) + len(words) > step:
                yield from self._sums(part, step)
                part = []
            part.append(words)
        yield from self._sums(part, step)

    def _sums(self, lists: list[list[str]], step: int) -> Iterator[np.ndarray | None]:
        def total(values):
            return np.frombuffer(b"".join(values)).reshape(-1, len(self.languages)).sum(0)

        if len(lists) == 1:  # a long text by parts
            words = lists[0]
            cut = [words[k:k + step] for k in range(0, len(words), max(1, step))]
            sums = [sum(total(v) for c in cut for v in self._cache.look_up_together([c]))] if words else [None]
        else:
            sums = (total(v) if v else None for v in self._cache.look_up_together(lists))
        for s in sums:
            if s is not None:
                s = np.exp(s - s.max())
                s = s / s.sum()
            yield s


def fit(docs: DataFrame, vocabulary_path: str, per_language: int = TRAIN_DOCS,
        chars: int = TRAIN_CHARS) -> Model:
    """Learn every language of ``docs (doc_id, text, lang)`` that has a text with a letter, from
    ``per_language`` distinct texts of it (or all, where there are fewer), chosen by a hash of text;
    of texts over ``chars`` characters an ``excerpt`` is used.  Null languages and texts are left out.
    """
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("text").rlike(_SQL_LETTER)).withColumn("h", F.xxhash64("text"))
    # the hash picks a few more distinct texts than needed, whatever the number of their copies
    sizes = usable.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.join(F.broadcast(sizes), "lang").where(draw < 1.5 * per_language / F.col("n"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "text": [excerpt(t, chars) for t in b["text"]]})

    small_batches(spark)
    order = Window.partitionBy("lang").orderBy("h")
    # texts of equal hash are copies: any one of them stands for all
    sample = (drawn.select("lang", "h", "text").mapInPandas(cut, "lang string, h long, text string")
              .groupBy("lang", "h").agg(F.min("text").alias("text"))
              .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language))
    pieces = vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(pieces)

    def learn(b: pd.DataFrame) -> pd.DataFrame:
        np.seterr(over="ignore")  # hashes wrap around
        counts: Counter = Counter()
        for t in b["text"]:
            counts.update(words_of(t))
        p = Lattice(shared.value).learn(counts)
        return pd.DataFrame({"lang": [b["lang"].iloc[0]], "p": [p.tobytes()]})

    # one language is one bounded group
    rows = sample.select("lang", "text").groupBy("lang").applyInPandas(learn, "lang string, p binary").collect()
    rows.sort(key=lambda r: r.lang)
    p = [np.frombuffer(bytes(r.p)) for r in rows]
    return Model([r.lang for r in rows], pieces, np.stack(p, 1) if p else np.zeros((len(pieces) + 2, 0)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs (doc_id, text, ...)``.

    ``und`` with score 0 where text is null or has no letter, or no language was learned;
    equal posteriors go to the language first in order.  Rows are kept as they are, repeated ones too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def run(texts):
            best = [None if q is None else (int(np.argmax(q)), float(q.max())) for q in m.posteriors(texts)]
            return {"lang_pred": ["und" if k is None else m.languages[k[0]] for k in best],
                    "score": [0.0 if k is None else k[1] for k in best]}
        return run

    return map_texts(docs, start, {"lang_pred": "string", "score": "double"})
