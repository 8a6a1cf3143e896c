"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles (lower-case, blank-separated words; a shorter text
is one shingle).  ProbMinHash (Ertl 2020): every shingle is a Poisson process whose rate is its
count; each of its arrivals, whose times and registers follow from the shingle's hash, may lower
one register's time, and a shingle ends early once its time exceeds all registers' times.  Two
signatures agree in a register with the probability Jaccard similarity of the multisets.

Texts with equal multisets form a class and are handled once.  Classes that agree in a band
share a bucket.  Buckets are resolved by exact verification against the shingles themselves: all
pairs of a small bucket, and in a larger one every member against one member, its hub - the one
that shares most buckets with most others, as the source of many copies does.  So a group of copies
costs a number of comparisons that is linear in its size.  Buckets whose members are not all
connected then (texts that are alike, but mostly below the limit) form clusters; a cluster is cut
into blocks of bounded size, and every two blocks are compared as a whole by matrix products over
their common shingles.  Nothing is cut off or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import WordCache, components, map_texts, written

WORDS = 5
LIMIT = 0.8
BANDS, ROWS = 25, 5      # at similarity 0.8 a pair shares no bucket with probability 5e-5
SMALL = 8                # largest bucket whose pairs are compared one by one
BLOCK_TEXTS, BLOCK_BYTES = 512, 4 << 20  # of a cluster, on average per block
COLUMNS = 8192           # shingles per matrix product
SALTS = 64               # tasks that share the members of one cluster
REGISTERS = BANDS * ROWS

_U = np.uint64
_HASHES: list[WordCache] = []


def _mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_PLACE = _odd(WORDS, 1)
_BAND = _odd(REGISTERS, 2)


def word_lists(texts: list[str | None]) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of every text."""
    if not _HASHES:
        import xxhash

        _HASHES.append(WordCache(lambda words: (xxhash.xxh64(w.encode()).digest() for w in words)))
    for values in _HASHES[0].look_up(("" if t is None else t.lower()).split() for t in texts):
        yield np.frombuffer(b"".join(values), "<u8")


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in rising order and their counts; none for a text without words."""
    if not len(words):
        return np.zeros(0, _U), np.zeros(0, int)
    n = max(1, len(words) - WORDS + 1)
    sums = np.zeros(n, _U)
    for k in range(min(WORDS, len(words))):
        sums += _mix(words[k:k + n] + _U(k + 1)) * _PLACE[k]
    return np.unique(_mix(sums), return_counts=True)


def signature(h: np.ndarray, count: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers: for each the shingle whose arrival came first."""
    time = np.full(m, np.inf)
    who = np.zeros(m, _U)
    rate = count.astype(float)
    at = np.zeros(len(h))
    done = 0
    while len(h):
        block = max(1, 5 * m // (2 * len(h)) if done == 0 else m // len(h))
        step = np.arange(done + 1, done + block + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
        z = _mix(h[:, None] + step)
        gap = -np.log(((z >> _U(24)) + _U(1)).astype(float) * 2.0 ** -40) / rate[:, None]
        x = at[:, None] + np.cumsum(gap, 1)
        k = ((z & _U(0xFFFFFF)) % _U(m)).astype(int)
        good = x < time[k]
        xs, ks = x[good], k[good]
        hs = np.broadcast_to(h[:, None], x.shape)[good]
        late = np.lexsort((hs, -xs))  # the earliest is written last
        time[ks[late]] = xs[late]
        who[ks[late]] = hs[late]
        done += block
        on = x[:, -1] <= time.max()
        h, rate, at = h[on], rate[on], x[on, -1]
    return who


def bands(who: np.ndarray) -> np.ndarray:
    """One hash per band of ``ROWS`` registers, the band's number mixed in."""
    return _mix((_mix(who) * _BAND).reshape(BANDS, ROWS).sum(1) + np.arange(BANDS, dtype=_U)).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if ca.max() == 1 and cb.max() == 1:
        return len(common) / (len(ha) + len(hb) - len(common))
    xa, xb = ca.astype(float), cb.astype(float)
    only_a, only_b = xa.sum() - xa[ia].sum(), xb.sum() - xb[ib].sum()
    pairs, times = np.unique(np.stack([xa[ia], xb[ib]]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), n in zip(pairs.T, times):
        total += n / (only_a / p + only_b / q + (np.maximum(pairs[0] / p, pairs[1] / q) * times).sum())
    return float(total)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), k (key of the shingle multiset; null without words), bands."""
    def start():
        import xxhash

        def run(texts):
            keys, found = [], []
            for words in word_lists(texts):
                h, c = shingles(words)
                keys.append(xxhash.xxh128(h.tobytes() + c.astype("<i8").tobytes()).hexdigest() if len(h) else None)
                found.append(bands(signature(h, c)) if len(h) else None)
            return {"k": keys, "bands": found}
        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows.withColumn("th", F.xxhash64("text")), start, {"k": "string", "bands": "array<long>"})


def _verified(pairs: DataFrame, store: DataFrame, limit: float, name: str) -> DataFrame:
    """The pairs (a, b) whose shingles have at least the similarity ``limit``."""
    a = store.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"))
    b = store.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            last, mine, keep = None, None, []
            for i, sa, na, sb, nb in zip(p["a"], p["sa"], p["na"], p["sb"], p["nb"]):
                if i != last:
                    last, mine = i, unpacked(sa, na)
                keep.append(similarity(mine, unpacked(sb, nb)) >= limit)
            yield p.loc[keep, ["a", "b"]]

    return written(pairs.join(b, "b").join(a, "a").mapInPandas(check, "a long, b long"), name)


def _compared(rest: DataFrame, store: DataFrame, limit: float) -> DataFrame:
    """Links (a, b) between members with different labels of every cluster of the open buckets
    ``rest (h, hub, id, label)``; a cluster is what shares buckets."""
    cluster = components(rest.select(F.col("id").alias("a"), F.col("hub").alias("b")), "minhash-clusters")
    nodes = (rest.select("id", "label").distinct().join(cluster.withColumnRenamed("component", "cluster"), "id")
             .join(store, "id"))
    blocks = nodes.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.octet_length("s")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    # a cluster may hold most of the rows: its members meet its number of blocks in many tasks
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = nodes.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int")).join(
        salted, ["cluster", "salt"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def match(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id").reset_index(drop=True)
        i, j = p["i"].iloc[0], p["j"].iloc[0]
        left, right = p[p["block"] == i].index.to_numpy(), p[p["block"] == j].index.to_numpy()
        sets = [unpacked(s, n) for s, n in zip(p["s"], p["n"])]
        a, b = near_pairs(sets, left, right, p["label"].to_numpy(), limit)
        ids = p["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                        "block", "id", "label", "n", "s").groupBy("cluster", "i", "j").applyInPandas(
        match, "a long, b long")


def near_pairs(sets: list, left: np.ndarray, right: np.ndarray, label: np.ndarray,
               limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of positions with different labels and a similarity of ``limit`` or more.

    For texts without repeated shingles the similarity follows from the size of the intersection.
    For others the product of square roots of the shares is an upper bound (no two draws can
    coincide more often than the overlap of their distributions), and what passes is computed.
    """
    where, column = [], []
    for k, (h, _) in enumerate(sets):
        where.append(np.full(len(h), k))
        column.append(h)
    where, column = np.concatenate(where), np.concatenate(column)
    names, column = np.unique(column, return_inverse=True)
    in_left, in_right = (np.bincount(column[np.isin(where, side)], minlength=len(names)) > 0 for side in (left, right))
    keep = in_left & in_right
    place = np.cumsum(keep) - 1
    weight = np.concatenate([np.sqrt(c / c.sum()) for _, c in sets])
    on = keep[column]
    where, column, weight = where[on], place[column[on]], weight[on]
    order = np.argsort(column, kind="stable")
    where, column, weight = where[order], column[order], weight[order]
    row = {}
    for side in (left, right):
        row[id(side)] = np.full(len(sets), -1)
        row[id(side)][side] = np.arange(len(side))
    total = np.zeros((len(left), len(right)))
    edges = np.searchsorted(column, np.arange(0, keep.sum() + COLUMNS, COLUMNS))
    for k, (s, e) in enumerate(zip(edges, edges[1:])):
        parts = []
        for side in (left, right):
            r = row[id(side)][where[s:e]]
            m = np.zeros((len(side), COLUMNS), "f4")
            m[r[r >= 0], column[s:e][r >= 0] - k * COLUMNS] = weight[s:e][r >= 0]
            parts.append(m)
        total += parts[0] @ parts[1].T
    size = np.array([len(h) for h, _ in sets])
    plain = np.array([bool(c.max() == 1) for _, c in sets])
    able = (label[left][:, None] != label[right][None, :]) & (left[:, None] < right[None, :] if left is right or
                                                              np.array_equal(left, right) else True)
    a, b = np.nonzero(able & (total >= limit - 1e-4))
    a, b, total = left[a], right[b], total[a, b]
    both = plain[a] & plain[b]
    common = np.rint(total * np.sqrt(size[a] * size[b]))  # whole numbers again
    good = np.where(both, common >= limit * (size[a] + size[b] - common) - 1e-9, False)
    for k in np.flatnonzero(~both):
        good[k] = similarity(sets[a[k]], sets[b[k]]) >= limit
    return a[good], b[good]


def packed(h: np.ndarray, c: np.ndarray) -> bytes:
    return h.tobytes() if not len(c) or c.max() == 1 else h.tobytes() + c.astype("<i8").tobytes()


def unpacked(s: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(s, "<u8", n)
    return h, np.ones(n, int) if len(s) == 8 * n else np.frombuffer(s, "<i8", n, 8 * n)


def classes(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, th, class_id, kept for every row of ``docs (doc_id, text)``.

    ``class_id`` is the smallest doc_id of the rows connected by similarities of ``limit`` or more,
    ``kept`` marks one row of every class (of rows repeated with the same id and text each is marked).
    A text without words and a row without doc_id is a class of its own (class_id: its doc_id) and
    kept.  ``th`` is the 64-bit hash of the text, which tells rows with the same id apart.
    """
    rows = written(signed(docs), "minhash-rows")
    usable = F.col("k").isNotNull() & F.col("doc_id").isNotNull()
    same = written(rows.where(usable).groupBy("k").agg(
        F.min(F.struct("doc_id", "th")).alias("first"), F.first("bands").alias("bands"))
        .select("k", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), "bands",
                F.monotonically_increasing_id().alias("id")), "minhash-classes")
    spread = same.select("id", F.explode("bands").alias("h"))
    shared = spread.groupBy("h").count().where("count > 1").select("h")
    members = written(spread.join(shared, "h").select("h", "id"), "minhash-buckets")

    def start():
        def run(texts):
            got = [shingles(w) for w in word_lists(texts)]
            return {"n": [len(h) for h, _ in got], "s": [packed(h, c) for h, c in got]}
        return run

    wanted = members.select("id").distinct().join(same.select("id", "doc_id", "th"), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    store = written(map_texts(texts.withColumn("th", F.xxhash64("text")).join(wanted, ["doc_id", "th"])
                    .select("id", "text"), start, {"n": "int", "s": "binary"}).dropDuplicates(["id"]),
                    "minhash-shingles")

    sizes = members.groupBy("h").agg(F.count("*").alias("n"))
    central = members.join(sizes, "h").groupBy("id").agg(F.sum("n").alias("weight"))
    state = members.join(central, "id").groupBy("h").agg(
        F.count("*").alias("n"), F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    members = written(members.join(state, "h"), "minhash-members")
    small = members.where(F.col("n") <= SMALL)
    pairs = small.select("h", F.col("id").alias("a")).join(small.select("h", F.col("id").alias("b")), "h").where(
        "a < b").select("a", "b").unionByName(members.where((F.col("n") > SMALL) & (F.col("id") != F.col("hub"))).select(
            F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))).distinct()
    links = _verified(pairs, store, limit, "minhash-links")
    label = components(links, "minhash-components")
    rest = members.where(F.col("n") > SMALL).join(label, "id", "left").select(
        "h", "hub", "id", F.coalesce("component", "id").alias("label"))
    mixed = rest.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    rest = written(rest.join(mixed, "h"), "minhash-open")
    if not rest.isEmpty():
        more = _compared(rest, store, limit)
        label = components(links.unionByName(written(more, "minhash-more")), "minhash-all")
    ids = same.select("k", "id", "doc_id", "th")
    ids = ids.join(label, "id", "left").withColumn("c", F.coalesce("component", "id"))
    first = ids.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    named = ids.join(first, "c").select("k", F.col("first.doc_id").alias("class_id"), F.col("first.th").alias("class_th"))
    return (rows.drop("bands").withColumn("k", F.when(usable, F.col("k"))).join(named, "k", "left")
            .select("doc_id", "th", F.coalesce("class_id", "doc_id").alias("class_id"),
                    (F.col("class_id").isNull() | ((F.col("doc_id") == F.col("class_id"))
                                                   & (F.col("th") == F.col("class_th")))).alias("kept")))
