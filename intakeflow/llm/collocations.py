"""Phrase collocations: HAT-trie counts of words and phrases, and the strongest phrases of every language.

Counting goes level by level, words first, then phrases of two words, then of three.  A task counts
in a HAT-trie: hash containers of packed word ids under a shallow trie, where a container that grows
too full bursts into one container for every next word.  When a trie holds too much, whole subtrees
are written out, largest first, as runs in order of their phrases; the rest follows at the end of the
task.  The runs' phrases are range-partitioned, so a partition is a span of the trie's prefixes and a
prefix of very many phrases spreads over several, and every partition merges its runs' counts.

Most phrases are rare, so each pass also screens the next level by numbers alone: it counts the 64-bit
hashes of phrases one word longer whose parts may be frequent, and hashes that occur often enough
go into a bit map of bounded size.  A frequent phrase's hash always does; where a rare one's does too,
it is counted for nothing and changes no result.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intakeflow.llm.common import small_batches, written

LEAST = 10              # occurrences of a candidate
LONGEST = 3             # words of a candidate
TOP = 2000              # phrases of a language
BURST = 4096            # entries at which a container bursts
ENTRIES = 1_000_000     # entries of a task's tries at which subtrees are written out
WORDS = 400_000         # words that have a number at once (below 2^21) ...
WORD_BYTES = 32 << 20   # ... and their bytes together
BUFFER = 500_000        # keys sorted together before they enter a trie
HASHES = 2_000_000      # hashes sorted together before they are written out ...
FIRST = 10              # ... in rows by their first bits
GROUP = 400_000         # hashes merged together
SLICE = 1 << 20         # bytes of one text looked at at once
OUT_ROWS, OUT_BYTES = 50_000, 16 << 20  # of one record batch of a run
MAP_BITS = 29           # a bit map has at most 2^29 bits

_BITS = 21              # of a word's number in a key
_BREAK = b"\xff"        # in place of a piece's end; no UTF-8 text holds this byte
_MIX = np.uint64(0x9E3779B97F4A7C15)
# fixed values: A-Z in lower case, pieces end at these signs, a tab parts words like a blank
_CUTS = (b" ", b"\t", b"\n", b".", b",")
_RUN_NAMES = ["lang", "phrase", "f", "hashes", "times"]
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t",
                         b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")


class HatTrie:
    """Counts of keys of ``depth`` packed word numbers.

    A node is a container (a dict from key to count) or, once that has burst, a trie node: a dict from
    the next word's number to a node.  Containers of the last word never burst.
    """

    def __init__(self, depth: int):
        self.depth = depth
        self.root: dict = {}
        self.burst: set[int] = set()   # ids of the dicts that are trie nodes
        self.entries = 0

    def _shift(self, level: int) -> int:
        return _BITS * (self.depth - 1 - level)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys in rising order and their counts."""
        self._add(self.root, 0, keys, counts)

    def _add(self, node: dict, level: int, keys: np.ndarray, counts: np.ndarray) -> None:
        if id(node) in self.burst:
            word = keys >> self._shift(level)
            cut = [0, *(np.flatnonzero(np.diff(word)) + 1).tolist(), len(keys)]
            for s, e, w in zip(cut, cut[1:], word[cut[:-1]].tolist()):
                child = node.get(w)
                if child is None:
                    child = node[w] = {}
                self._add(child, level + 1, keys[s:e], counts[s:e])
            return
        before, get = len(node), node.get
        for k, c in zip(keys.tolist(), counts.tolist()):
            node[k] = get(k, 0) + c
        self.entries += len(node) - before
        if len(node) > BURST and level < self.depth - 1:
            k, c = _arrays(node)
            self.entries -= len(node)
            node.clear()
            self.burst.add(id(node))
            self._add(node, level, k, c)

    def _collect(self, node: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        if id(node) not in self.burst:
            return [_arrays(node)] if node else []
        return [part for child in node.values() for part in self._collect(child)]

    def take(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove the largest subtrees under the root, at least ``least`` entries of them if there are
        so many: (keys, counts)."""
        if id(self.root) not in self.burst:
            parts = self._collect(self.root)
            self.root = {}
        else:
            whole = [(w, self._collect(child)) for w, child in self.root.items()]
            whole.sort(key=lambda s: -sum(len(k) for k, _ in s[1]))
            parts, got = [], 0
            for w, some in whole:
                if got >= least:
                    break
                parts += some
                got += sum(len(k) for k, _ in some)
                self._forget(self.root.pop(w))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        self.entries -= len(keys)
        return keys, counts

    def _forget(self, node: dict) -> None:
        if id(node) in self.burst:
            for child in node.values():
                self._forget(child)
            self.burst.discard(id(node))


def _arrays(container: dict) -> tuple[np.ndarray, np.ndarray]:
    k = np.fromiter(container.keys(), np.int64, len(container))
    c = np.fromiter(container.values(), np.int64, len(container))
    order = np.argsort(k)
    return k[order], c[order]


def phrase_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases from the hashes of their words."""
    h = np.zeros(len(hashes[0]), "u8")
    with np.errstate(over="ignore"):
        for one in hashes:
            h = (h ^ one) * _MIX
            h ^= h >> np.uint64(29)
        return h * _MIX


def _cut(h: np.ndarray, n: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted hashes and their counts by the hashes' first bits."""
    first = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(h)]])
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if s < e:
            yield int(first[s]), h[s:e], n[s:e]


class BitMap:
    """Which phrases of a level may be frequent: 2^bits bits, by the first bits of a phrase's hash."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype("u1") & 1).astype(bool)


class Numbers:
    """Numbers from 1 for words in the order of their first occurrence; 0 for the end of a piece."""

    def __init__(self, lang: bytes):
        self.seed = xxhash.xxh32_intdigest(lang)
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(count(1).__next__, {_BREAK: 0})
        self.words, self.hash, self.bytes = [b""], array("Q", [0]), 0

    def look_up(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new = list(islice(reversed(self.known), len(self.known) - len(self.words)))[::-1]
        if new:
            self.words += new
            self.hash.extend([xxhash.xxh64_intdigest(w, self.seed) for w in new])
            self.bytes += sum(map(len, new)) + 64 * len(new)
        return ids

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.hash, "u8")[ids]


class Counter:
    """Counts the phrases of ``size`` words of one language in a task, within bounded memory.

    ``allowed``: the level's bit map (None: all phrases count).  ``screen``: also count hashes of phrases of one
    word more, of those whose both parts of ``size`` words count.
    """

    def __init__(self, lang: str, size: int, allowed: BitMap | None, screen: bool):
        self.lang, self.size, self.allowed, self.screen = lang, size, allowed, screen
        self.numbers = Numbers(lang.encode())
        self.trie = HatTrie(size)
        self.buffer: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.held = self.hashed = 0
        self.total = 0

    def text(self, data: bytes) -> Iterator[pa.RecordBatch]:
        """Count a text's phrases; runs that were written out meanwhile."""
        at, tail = 0, np.zeros(0, np.int64)
        while at < len(data):
            end = at + SLICE
            if end < len(data):  # a slice ends at a blank or where a piece ends
                cut = max(data.rfind(c, at, end) for c in _CUTS)
                if cut < at:  # one long word
                    cut = min((k for k in (data.find(c, end) for c in _CUTS) if k >= 0), default=len(data))
                end = cut + 1
            words = data[at:end].translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()
            at = end
            if self.size == 1:
                self.total += len(words) - words.count(_BREAK)
            ids = np.concatenate([tail, self.numbers.look_up(words)])
            self.count(ids, len(tail))
            tail = ids[max(0, len(ids) - (self.size if self.screen else self.size - 1)):]
            if self.held > BUFFER:
                self.settle()
            if self.hashed > HASHES:
                yield self.screened()
            if len(self.numbers.words) > WORDS or self.numbers.bytes > WORD_BYTES:
                yield from self.spill(None)
                tail_words = [self.numbers.words[i] if i else _BREAK for i in tail]
                self.numbers.clear()
                tail = self.numbers.look_up(tail_words)

    def count(self, ids: np.ndarray, known: int) -> None:
        """Buffer the phrases that end after the first ``known`` words, which were counted before."""
        n = len(ids) - self.size + 1
        if n <= 0:
            return
        spans = [ids[k:k + n] for k in range(self.size)]
        ok = spans[0] > 0
        for s in spans[1:]:
            ok &= s > 0
        hashes = None
        if self.allowed is not None or self.screen:
            hashes = self.numbers.hashes(ids)
        if self.allowed is not None:
            at = np.flatnonzero(ok)
            ok[at] = self.allowed.has(phrase_hash([hashes[at + k] for k in range(self.size)]))
        new = np.flatnonzero(ok)
        new = new[new >= known - self.size + 1]
        key = spans[0][new]
        for s in spans[1:]:
            key = key << _BITS | s[new]
        self.buffer.append(key)
        self.held += len(key)
        if self.screen:
            at = np.flatnonzero(ok[:-1] & ok[1:])
            at = at[at >= known - self.size]
            h = phrase_hash([hashes[at + k] for k in range(self.size + 1)])
            self.hashes.append(h)
            self.hashed += len(h)

    def screened(self) -> pa.RecordBatch:
        """Buffered hashes and their counts, one row for each value of a hash's first ``FIRST`` bits."""
        h, n = np.unique(np.concatenate(self.hashes), return_counts=True)
        self.hashes, self.hashed = [], 0
        rows = list(_cut(h, n, FIRST))
        return pa.RecordBatch.from_arrays([
            pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.string()), pa.array([len(x) for _, x, _ in rows], pa.int64()),
            pa.array([x.tobytes() for _, x, _ in rows], pa.binary()),
            pa.array([x.astype("<u4").tobytes() for _, _, x in rows], pa.binary())], names=_RUN_NAMES)

    def settle(self) -> None:
        """Buffered keys into the trie."""
        if self.buffer:
            keys = np.concatenate(self.buffer)
            if self.size == 1:
                counts = np.bincount(keys)
                keys = np.flatnonzero(counts)
                counts = counts[keys]
            else:
                keys, counts = np.unique(keys, return_counts=True)
            self.trie.add(keys, counts)
            self.buffer, self.held = [], 0

    def spill(self, least: int | None) -> Iterator[pa.RecordBatch]:
        """Write subtrees of at least ``least`` entries (None: all) as one run in order of the words."""
        self.settle()
        keys, counts = self.trie.take(self.trie.entries if least is None else least)
        if not len(keys):
            return
        words = self.numbers.words
        mask = (1 << _BITS) - 1
        ids = [keys >> _BITS * (self.size - 1 - k) & mask for k in range(self.size)]
        used = np.zeros(len(words), bool)
        for i in ids:
            used[i] = True
        order = sorted(np.flatnonzero(used).tolist(), key=words.__getitem__)
        rank = np.zeros(len(words), np.int64)
        rank[order] = np.arange(len(order))
        sort = np.lexsort([rank[i] for i in reversed(ids)])
        ids, counts = [i[sort] for i in ids], counts[sort]
        length = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sum(length[i] for i in ids))
        named = pa.array(words, pa.binary())
        s = 0
        while s < len(counts):
            e = min(s + OUT_ROWS, max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + OUT_BYTES, "right"))))
            phrase = pc.binary_join_element_wise(*(named.take(pa.array(i[s:e])) for i in ids), pa.scalar(b" ", pa.binary()))
            yield self._batch(phrase, counts[s:e])
            s = e

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self.spill(None)
        if self.hashed:
            yield self.screened()
        if self.size == 1:
            yield self._batch(pa.array([b""], pa.binary()), np.array([self.total]))

    def _batch(self, phrase, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(counts), pa.string()), phrase.cast(pa.string()), pa.array(counts, pa.int64()),
             pa.nulls(len(counts), pa.binary()), pa.nulls(len(counts), pa.binary())], names=_RUN_NAMES)


def runs(docs: DataFrame, size: int, allowed: BitMap | None = None, screen: bool = False) -> DataFrame:
    """(lang, phrase, f, hashes, times): counts of the phrases of ``size`` words, one row for every run a phrase is
    in, and with ``screen``, rows of f hashes of phrases of one word more and how often each occurs, without lang
    and phrase.

    With ``size`` 1, the empty phrase counts all words of the language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(allowed)

    def run(batches):
        counters: dict[str, Counter] = {}
        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                c = counters.get(lang)
                if c is None:
                    c = counters[lang] = Counter(lang, size, shared.value, screen)
                yield from c.text(b"\n".join(some))  # a line end parts pieces
            # what all languages hold together
            while sum(c.trie.entries + c.held for c in counters.values()) > ENTRIES:
                c = max(counters.values(), key=lambda c: c.trie.entries + c.held)
                yield from c.spill(ENTRIES // 2)
            if sum(c.numbers.bytes + 8 * c.hashed for c in counters.values()) > 2 * WORD_BYTES:
                for c in counters.values():
                    yield from c.finish()
                counters = {}
        for c in counters.values():
            yield from c.finish()

    return docs.mapInArrow(run, "lang string, phrase string, f long, hashes binary, times binary")


def merged(found: DataFrame, size: int) -> DataFrame:
    """Counts over all runs: every partition is a span of prefixes in order (words: a share of them)."""
    phrases = found.where("phrase is not null")
    if size > 1:
        phrases = phrases.repartitionByRange("lang", "phrase")
    return phrases.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_hashes(found: DataFrame, least: int) -> DataFrame:
    """(hash) of the screened phrases that occur at least ``least`` times, written.

    Hashes are dealt into groups of about ``GROUP`` entries by their first bits."""
    rows = found.where("hashes is not null").select("f", "hashes", "times")
    entries = rows.agg(F.sum("f")).first()[0] or 0
    bits = max(0, -(-entries // GROUP) - 1).bit_length()

    def deal(batches):
        for b in batches:
            for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = list(_cut(np.frombuffer(h, "<u8"), np.frombuffer(n, "<u4"), bits))
                yield pa.RecordBatch.from_arrays([
                    pa.array([g for g, _, _ in parts], pa.int64()), pa.array([x.tobytes() for _, x, _ in parts], pa.binary()),
                    pa.array([x.tobytes() for _, _, x in parts], pa.binary())], names=["g", "hashes", "times"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["hashes"]), "<u8")
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.add.reduceat(np.frombuffer(b"".join(pdf["times"]), "<u4")[order].astype(np.int64), first)
        return pd.DataFrame({"hash": h[first[n >= least]].view(np.int64)})

    # a row lies within one value of its first bits, so few bits part no row
    dealt = rows.select("hashes", "times").mapInArrow(deal, "g long, hashes binary, times binary")
    return written(dealt.groupBy("g").applyInPandas(merge, "hash long"), "phrase-hashes")


def bit_map(often: DataFrame) -> BitMap:
    """The bit map of the hashes in ``often (hash)``: 16 bits for each of them, at most 2^``MAP_BITS`` together."""
    bits = min(MAP_BITS, max(16, (16 * often.count()).bit_length()))
    slot = F.shiftrightunsigned("hash", 64 - bits)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(65536, "u1")
        on[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "data": [np.packbits(on, bitorder="little").tobytes()]})

    got = (often.select(F.shiftright(slot, 16).cast("int").alias("block"), slot.bitwiseAND(65535).cast("int").alias("bit"))
           .distinct().groupBy("block").applyInPandas(block, "block int, data binary")).toPandas()
    data = np.zeros(1 << bits - 3, "u1")
    for at, some in zip(got["block"], got["data"]):
        data[at * 8192:(at + 1) * 8192] = np.frombuffer(some, "u1")
    return BitMap(bits, data)


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Written tables (lang, phrase, f) of the phrases that occur at least ``least`` times, by number of
    words; the first also has the empty phrase, which counts all words."""
    if not 2 <= longest <= 63 // _BITS:
        raise ValueError("phrases of two or three words")
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    out: list[DataFrame] = []
    allowed = None
    for size in range(1, longest + 1):
        found = written(runs(rows, size, allowed, size < longest), f"phrase-runs-{size}")
        out.append(written(merged(found, size).where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{size}"))
        if size < longest:
            allowed = bit_map(frequent_hashes(found, least))
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language of ``docs (lang, text)``.

    A null lang is ``und``, a null or empty text has no words; repeated rows count as often as they
    occur, and other columns are left alone.  Ties go to more occurrences, then to the phrase that
    comes first in byte order.  A language without a candidate has no row.
    """
    level = counts(docs, least, longest)
    key = ["lang", "phrase"]
    every = level[0].where("phrase <> ''")
    for one in level[1:]:
        every = every.unionByName(one)
    cuts = None
    for size, one in enumerate(level[1:], 2):
        for k in range(1, size):
            first = F.substring_index("phrase", " ", k)
            cut = one.select(*key, F.col("f").alias("a"), F.lit(k).alias("k"), first.alias("first"),
                             F.substring_index("phrase", " ", k - size).alias("rest"))
            cuts = cut if cuts is None else cuts.unionByName(cut)
    lookup = (cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    scored = lookup.withColumn("score", F.expr("1000000").cast("decimal(7,0)") * (wide["a"] * wide["a"])).withColumn(
        "product", wide["l"] * wide["r"]).withColumn("score", F.expr("score div product"))
    best = scored.groupBy(*key).agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select(
        *key, "b.a", "b.l", "b.r", "b.score")
    # a phrase goes if a longer candidate that holds it occurs at least half as often
    inner = None
    for size, one in enumerate(level[2:], 3):
        for short in range(2, size):
            for at in range(size - short + 1):
                part = F.substring_index(F.substring_index("phrase", " ", at + short), " ", -short)
                some = one.select("lang", part.alias("phrase"), "f")
                inner = some if inner is None else inner.unionByName(some)
    if inner is not None:
        longer = inner.groupBy(*key).agg(F.max("f").alias("longer"))
        best = best.join(longer, key, "left").where(
            F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(50) * F.col("a"))).drop("longer")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = level[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                         F.col("score").cast("long").alias("score"))


def oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same rows in DuckDB's SQL over ``documents``."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = [f"""SELECT lang, {size} AS size, {" || ' ' || ".join(['w'] + [f"lead(w, {k}) OVER p" for k in range(1, size)])} AS phrase,
       {f"lead(w, {size - 1}) OVER p" if size > 1 else 'w'} AS last FROM words WINDOW p AS (PARTITION BY doc, piece ORDER BY pos)"""
             for size in range(1, longest + 1)]
    cuts = [f"""SELECT lang, phrase, f, {k} AS k, array_to_string(string_split(phrase, ' ')[1:{k}], ' ') AS first,
       array_to_string(string_split(phrase, ' ')[{k + 1}:{size}], ' ') AS rest FROM counts WHERE size = {size}"""
            for size in range(2, longest + 1) for k in range(1, size)]
    inner = [f"""SELECT lang, array_to_string(string_split(phrase, ' ')[{at + 1}:{at + short}], ' ') AS phrase, f
       FROM counts WHERE size = {size}"""
             for size in range(3, longest + 1) for short in range(2, size) for at in range(size - short + 1)]
    return f"""
WITH texts AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
       string_split_regex(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[.,;:!?\\x0A-\\x0D]') AS parts FROM documents),
pieces AS (SELECT doc, lang, unnest(parts) AS body, generate_subscripts(parts, 1) AS piece FROM texts),
lists AS (SELECT doc, lang, piece, list_filter(string_split_regex(body, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
words AS (SELECT doc, lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM lists),
grams AS ({' UNION ALL '.join(grams)}),
every AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams WHERE last IS NOT NULL GROUP BY lang, size, phrase),
counts AS MATERIALIZED (SELECT * FROM every WHERE f >= {least}),
cuts AS ({' UNION ALL '.join(cuts)}),
firsts AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first),
scored AS (SELECT c.lang, c.phrase, c.f AS a, c.k, c.l, y.f AS r,
       CAST(1000000::HUGEINT * c.f * c.f // (c.l::HUGEINT * y.f) AS BIGINT) AS score
  FROM firsts c JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM ({' UNION ALL '.join(inner) or 'SELECT lang, phrase, f FROM counts WHERE false'}) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM every WHERE size = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM kept JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}
"""
