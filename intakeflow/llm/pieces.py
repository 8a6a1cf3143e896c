"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces and scores of a public vocabulary are read as a unigram model: a text is cut so that the
sum of its pieces' scores is largest, characters without a piece become byte pieces.  (The public
file was made for merging, which is another rule: its own library cuts some words otherwise.)  No
piece holds a blank after another character, or a line end, so ordinary texts are cut word by word.

A text of more than ``CHUNK`` characters is split into chunks.  How far the piece on a chunk's left
border reaches into it is its entry state, how far its last piece reaches beyond it the exit state;
a chunk's transfer matrix holds the best score for every pair of them.  Matrices combine by the
max-plus product, which is associative, so prefix and suffix scans give the best state at every
border; with both ends fixed each chunk is cut by itself.  Equal sums are parted by a small number
that depends on the piece alone; where the same pieces in another order are as good, either cut may
be returned for a text that is split inside that word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import WordCache, map_texts, written
from intakeflow.llm.langid import Lattice

CHUNK = 65_536
ARCS = 200_000           # pieces that may be looked at together
BLANK = "▁"         # fixed value: the public library's sign for a blank
LEAST = -1e6             # scores are no lower than this (the file scores runs of blanks like minus infinity)
LOST = -np.inf
# positions that every segmentation passes; whether the first one is such depends on the chunk before
_FORCED = re.compile(rf"(?<=[^{BLANK}])(?={BLANK})|(?=\n)|(?<=\n)")

_LOADED: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces, ids and scores of a public file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
                  and "\n" not in self.text[i]]
        assert not any(BLANK in self.text[i].lstrip(BLANK) for i in usable), "pieces must not cross blanks"
        # scores as whole numbers, equal sums parted by the low digits
        self.score = {self.text[i]: (float(round(max(sp.get_score(i), LEAST) * (1 << 20)) - zlib.crc32(self.text[i].encode()) % 4096),
                                     i) for i in usable}
        self.reach = max(map(len, self.score))
        self.starts = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.unknown = 2 * LEAST * (1 << 20)
        self.cache = WordCache(self.cut_together)
        pieces = list(self.score)
        self.lattice = Lattice(pieces)
        # by the lattice's numbers: scores and ids of pieces, of a character without one, and of no piece
        self.arc_score = np.array([self.score[p][0] for p in pieces] + [self.unknown, LOST])
        self.arc_id = np.array([self.score[p][1] for p in pieces] + [-1, -1], np.int32)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.of_byte)] = True

    def matches(self, s: str, i: int):
        """(length, score, id or None) of the pieces at position i; a lone character always matches."""
        alone = True
        for j in range(i + 1, min(len(s), i + self.reach) + 1):
            p = s[i:j]
            if p not in self.starts:
                break
            got = self.score.get(p)
            if got is not None:
                alone = alone and j > i + 1
                yield j - i, got[0], got[1]
        if alone:
            yield 1, self.unknown, None

    def best(self, s: str, stop: int) -> tuple[list[float], list]:
        """Best sums and last arcs at every position reached by pieces that start before ``stop``."""
        score, arc = [LOST] * (len(s) + 1), [None] * (len(s) + 1)
        score[0] = 0.0
        for i in range(min(stop, len(s))):
            if score[i] > LOST:
                for n, p, k in self.matches(s, i):
                    if score[i] + p > score[i + n]:
                        score[i + n], arc[i + n] = score[i] + p, (i, k)
        return score, arc

    def cut_together(self, words: list[str]) -> list[bytes]:
        """Ids of strings without inner cuts: a max-plus pass over all strings of a length side by side."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        out = [b""] * len(words)
        for n, at in by.items():
            if n:
                step = max(1, ARCS // (n * min(n, self.reach)))
                for k in range(0, len(at), step):
                    some = at[k:k + step]
                    for i, ids in zip(some, self._cut([words[i] for i in some], n)):
                        out[i] = ids
        return out

    def _cut(self, words: list[str], n: int) -> Iterator[bytes]:
        with np.errstate(over="ignore"):  # hashes wrap around
            arcs = self.lattice.arcs(words, n)
        rows, reach = np.arange(len(words)), arcs.shape[2]
        best = np.full((len(words), reach + n), LOST)  # position j is column reach - 1 + j
        best[:, reach - 1] = 0.0
        length = np.zeros((len(words), n + 1), np.int32)
        for j in range(1, n + 1):
            # lengths reach..1, so that equal sums go to the piece that starts first
            sums = best[:, j - 1:j + reach - 1] + self.arc_score[arcs[:, j, ::-1]]
            k = sums.argmax(1)
            best[:, reach - 1 + j] = sums[rows, k]
            length[:, j] = reach - k
        ids = np.empty((len(words), n), np.int32)  # filled from the end
        lengths = np.empty((len(words), n), np.int32)
        count = np.zeros(len(words), int)
        end = np.full(len(words), n)
        left = rows
        while len(left):
            e = end[left]
            m = length[left, e]
            place = n - 1 - count[left]
            ids[left, place] = self.arc_id[arcs[left, e, m - 1]]
            lengths[left, place] = m
            count[left] += 1
            end[left] = e - m
            left = left[e > m]
        bytes_too = (np.where(np.arange(n) >= n - count[:, None], ids, 0) < 0).any(1)
        for i, w in enumerate(words):
            own = ids[i, n - count[i]:]
            if bytes_too[i]:
                some, at = [], 0
                for k, m in zip(own.tolist(), lengths[i, n - count[i]:].tolist()):
                    some += [k] if k >= 0 else [self.byte[b] for b in w[at:at + m].encode()]
                    at += m
                own = np.array(some, np.int32)
            yield own.tobytes()

    def encode(self, strings: list[str]) -> list[bytes]:
        """Ids of normalised strings, cut before every run of blank signs and around line ends."""
        return [b"".join(v) for v in self.cache.look_up_together([_words(s) for s in strings])]

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """The text of ids; the blank that encoding puts in front of a text is taken off its first part."""
        ids = np.asarray(ids, np.int64)
        raw = self.is_byte[ids]
        # runs of byte pieces and of others
        cut = [0, *(np.flatnonzero(np.diff(raw)) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(cut, cut[1:]):
            some = ids[a:b].tolist()
            if some and raw[a]:
                out.append(bytes(map(self.of_byte.__getitem__, some)).decode("utf-8", "replace"))
            else:
                out += map(self.text.__getitem__, some)
        s = "".join(out).replace(BLANK, " ")
        return s[1:] if first and s[:1] == " " else s


def _words(s: str) -> list[str]:
    if "\0" in s:
        return [s]
    s = s.replace(BLANK, "\0" + BLANK).replace("\n", "\0\n\0")
    while BLANK + "\0" + BLANK in s:
        s = s.replace(BLANK + "\0" + BLANK, BLANK + BLANK)
    return s.split("\0")


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def normalised(text: str) -> str:
    """A blank in front, blanks as signs; a sign that a text holds itself is a blank from here on."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def split(s: str, chunk: int, reach: int) -> list[tuple[int, int, int]]:
    """(start, end, end with the following characters that a piece may reach); all but a lone chunk
    hold at least ``reach`` characters."""
    cuts = list(range(0, max(len(s), 1), chunk))
    if len(cuts) > 1 and len(s) - cuts[-1] < reach:
        cuts.pop()
    ends = [*cuts[1:], len(s)]
    return [(a, b, min(len(s), b + reach - 1)) for a, b in zip(cuts, ends)]


def transfer(v: Vocabulary, s: str, n: int) -> np.ndarray:
    """Max-plus transfer matrix [entry, exit] of the first n characters of s; the rest of s is what a
    last piece may reach.  Its largest finite number is 0."""
    size = v.reach
    m = np.full((size, size), LOST)
    marks = [m.start() for m in _FORCED.finditer(s, 0, n)]
    if marks:  # every path passes the first and the last of these positions
        first, last = marks[0], marks[-1]
        head = np.array([v.best(s[a:first], first)[0][first - a] if a <= first else LOST for a in range(size)])
        score = v.best(s[last:], n - last)[0][n - last:]
        tail = np.array(score + [LOST] * (size - len(score)))
        m = head[:, None] + tail
    else:
        d = np.full((len(s) + size, size), LOST)
        d[np.arange(size), np.arange(size)] = 0.0
        for i in range(n):
            row = d[i]
            if row.max() > LOST:
                for k, p, _ in v.matches(s, i):
                    np.maximum(d[i + k], row + p, out=d[i + k])
        m = d[n:n + size].T.copy()
    return m - m[np.isfinite(m)].max()


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for k in range(1, a.shape[2]):
        np.maximum(out, a[:, :, k, None] + b[:, None, k, :], out=out)
    return out


def scan(m: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of a stack of matrices, in log2(n) combining steps."""
    m, step = m.copy(), 1
    while step < len(m):
        m[step:] = combine(m[:-step], m[step:])
        step *= 2
    return m


def borders(m: np.ndarray) -> np.ndarray:
    """The best state at every border of a text from its chunks' matrices (0 at both ends)."""
    before = scan(m)[:-1, 0, :]
    after = scan(m[::-1].transpose(0, 2, 1))[::-1][1:, 0, :]
    return np.concatenate([[0], (before + after).argmax(1) if len(m) > 1 else [], [0]]).astype(int)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, part, parts, n_tokens, ids: one row per chunk of every text of ``docs (doc_id, text)``.

    A text of up to ``chunk`` characters is one part.  A null or empty text has one part without ids.
    Rows with equal or null doc_id are texts of their own; ``row`` tells them apart.  At most the
    matrices of one text (2 kB per chunk, so 64 MB for the longest string Spark can hold) meet in a task.
    """
    def start():
        v = vocabulary(path)

        def run(texts):
            strings = [normalised(t or "") for t in texts]
            cuts = [split(s, chunk, v.reach) for s in strings]
            ids = iter(v.encode([s for s, c in zip(strings, cuts) if len(c) == 1]))
            return {"p": [[{"part": 0, "parts": 1, "ids": np.frombuffer(next(ids), "<i4")}] if len(c) == 1 else
                          [{"part": k, "parts": len(c), "text": s[a:z], "n": b - a,
                            "matrix": transfer(v, s[a:z], b - a).tobytes()} for k, (a, b, z) in enumerate(c)]
                          for s, c in zip(strings, cuts)]}
        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = written(map_texts(rows, start, {"p": "array<struct<part:int,parts:int,ids:array<int>,text:string,n:int,"
                                               "matrix:binary>>"})
                  .withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.inline("p")), "pieces")
    size = vocabulary(path).reach

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        m = np.stack([np.frombuffer(x).reshape(size, size) for x in pdf["matrix"]])
        at = borders(m)
        return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "entry": at[:-1], "exit": at[1:]})

    long = cut.where("parts > 1")
    known = long.select("row", "part", "matrix").groupBy("row").applyInPandas(
        states, "row long, part int, entry int, exit int")

    def trace():
        v = vocabulary(path)
        return lambda texts: {"ids": [np.frombuffer(x, "<i4") for x in v.encode(texts)]}

    spans = long.select("doc_id", "row", "part", "parts", "text", "n").join(known, ["row", "part"]).select(
        "doc_id", "row", "part", "parts", F.expr("substring(text, entry + 1, n + exit - entry)").alias("text"))
    out = cut.where("parts = 1").select("doc_id", "row", "part", "parts", "ids").unionByName(
        map_texts(spans, trace, {"ids": "array<int>"}))
    return out.select("doc_id", "row", "part", "parts", F.size("ids").cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded (.., part, ids)`` with the text of every part in place of its ids."""
    columns = [c for c in encoded.columns if c != "ids"]

    def run(batches):
        import pyarrow as pa

        v = vocabulary(path)
        for b in batches:
            parts = b.column(columns.index("part")).to_pylist()
            ids = [i.values.to_numpy() if i.is_valid else None for i in b.column(len(columns))]
            texts = [v.decode([] if i is None else i, not p) for p, i in zip(parts, ids)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*columns, "text"])

    kept = encoded.select(*columns)
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(StructField(f.name, f.dataType) for f in kept.schema.fields), StructField("text", StringType())])
    return encoded.select(*columns, "ids").mapInArrow(run, schema)
