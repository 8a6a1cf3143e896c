"""Packing of token streams into training windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read.  A document's full windows of ``capacity`` ids
stand alone.  What is left is cut into items of at most ``item`` ids; items are dealt into
groups of about ``group_windows`` windows by a hash, and every group is divided by k-way
largest differencing: partial partitions start as one item in k slots, the two with the
largest spread are merged with opposing order (largest slot onto smallest), until one
partition is left.  If its largest slot exceeds the capacity, k rises by one and the group
is divided again.  Groups are independent tasks of bounded size; token ids never shuffle,
only ``(doc_id, start, length, crc)`` rows do.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import WordCache, small_batches, written

CAPACITY = 2048
ITEM = 256
GROUP_WINDOWS = 160
EOS = 1  # id that ends every document

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "spread long")

_TOKENIZERS: dict[str, WordCache] = {}


def words_of(text: str) -> list[str]:
    """Cut at blanks and line ends, where the pre-tokeniser cuts as well."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class WordIds:
    """The ids of blank-separated words as little-endian unsigned 32-bit numbers.

    The tokeniser drops white space and merges inside words only, so the ids of a text are those
    of its words in order.  A word of plain Latin letters, with at most one stop or comma behind,
    is merged by the same merge table in the faster of the two public libraries; every other word
    goes to ``tokenizers`` itself.  ``tests/llm`` holds both ways against ``tokenizers`` on whole
    texts.
    """

    END = b"\xff"  # stands for the word-end mark; no UTF-8 text holds this byte

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # byte-level vocabularies write bytes that are not printable as letters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letter = {chr(b): b for b in plain}
        letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        suffix = model["end_of_word_suffix"]
        ranks = {}
        for token, i in model["vocab"].items():
            core = token.removesuffix(suffix)
            if all(c in letter for c in core):
                ranks[bytes(letter[c] for c in core) + (self.END if core != token else b"")] = i
        # ids rise with the merges, so an id serves as its merge's rank
        merged = [i for i in (model["vocab"]["".join(m)] for m in model["merges"])]
        assert merged == sorted(merged) and min(merged) >= 512, "ids must follow the merges"
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.stops = {c: self.slow(c) for c in ".,"}

    def slow(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, words: list[str]) -> Iterator[bytes]:
        for w in words:
            tail = b""
            core = w
            if w and w[-1] in self.stops:
                core, tail = w[:-1], self.stops[w[-1]]
            if core.isalpha() and max(core) < "\u0180" and "\u0130" not in core:
                yield array("I", self.merge(core.lower().encode() + self.END)).tobytes() + tail
            else:
                yield self.slow(w)


def word_cache(path: str) -> WordCache:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCache(WordIds(path))
    return _TOKENIZERS[path]


def ids_of(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of every text, ended by ``EOS``, as little-endian unsigned 32-bit numbers."""
    end = EOS.to_bytes(4, "little")
    for values in word_cache(path).look_up(map(words_of, texts)):
        yield b"".join(values) + end


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, item: int = ITEM) -> DataFrame:
    """Token pieces of ``docs (doc_id, text)``: full windows, then items of at most ``item`` ids.

    A null or empty text holds the end id only.  Rows with equal or null doc_id are separate
    documents; ``spread`` (split and position of the row) deals them apart.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], ids_of(["" if t is None else t for t in b["text"]], tokenizer)):
                n += 1
                total = len(ids) // 4
                whole = total - total % capacity
                cuts = list(range(0, whole, capacity)) + list(range(whole, total, item)) + [total]
                # the largest odd pieces are as good as any: what counts is that items are small
                for s, e in zip(cuts, cuts[1:]):
                    rows.append((doc, s, e - s, zlib.crc32(ids[4 * s:4 * e]), total, (part << 33) + n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECE_SCHEMA)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of item positions with near-equal sums (largest differencing).

    A partial partition keeps its non-empty slots only, as ``(sum, node)`` in falling order;
    a node is an item position or a pair of nodes.  Ties go to the partition made first.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    if not heap:
        return [[] for _ in range(k)]
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k  # slots of b that must share a slot of a
        if over <= 0:
            slots = a + b
        else:
            # opposing order: b's largest onto a's smallest
            free = len(b) - over
            slots = a[:len(a) - over]
            # a's empty slots take b's largest first
            slots += b[:free]
            rest_a, rest_b = a[len(a) - over:], b[free:]
            slots += [(x + y, (p, q)) for (x, p), (y, q) in zip(reversed(rest_a), rest_b)]
        slots.sort(key=lambda s: -s[0])
        spread = slots[0][0] - (slots[-1][0] if len(slots) == k else 0)
        heapq.heappush(heap, (-spread, made, slots))
        made += 1
    out = []
    for _, node in heap[0][2]:
        stack, items = [node], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def divide(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their count rises while one is too full."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, item: int = ITEM,
         group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Every token piece of ``docs`` with its sequence and offset.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  An empty
    table gives an empty table.  A document appears once per row it has in ``docs``.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, item), "pack-pieces")
    total = cut.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (group_windows * capacity)))
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = cut.where(F.col("length") == capacity).select(
        *keys, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "spread", "start"], ascending=[False, True, True, True])
        pdf = pdf.reset_index(drop=True)
        sizes = pdf["length"].tolist()
        seq, off = [0] * len(sizes), [0] * len(sizes)
        base = int(pdf["g"].iloc[0]) << 24
        for w, items in enumerate(divide(sizes, capacity)):
            at = 0
            for i in items:
                seq[i], off[i] = (base + w) * 2 + 1, at
                at += sizes[i]
        return pdf[keys].assign(sequence_id=seq, offset=off)

    left = (cut.where(F.col("length") < capacity)
            .withColumn("g", F.pmod(F.xxhash64("spread", "start"), F.lit(groups)).cast("long"))
            .repartition(min(groups, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "g")
            .groupBy("g").applyInPandas(windows, "doc_id long, start long, length long, ids_crc32 long, "
                                                 "doc_tokens long, sequence_id long, offset long"))
    return whole.unionByName(left)
