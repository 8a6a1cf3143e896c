import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from intakeflow.llm import collocations as C


def brute(texts, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    out = {}
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if any(g == lang and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (g, q), b in cand.items() if len(q) > len(p)):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def result(df):
    return sorted(map(tuple, df.collect()))


def awkward_texts():
    rng = np.random.default_rng(3)
    words = ["of", "the", "New", "york", "TIMES", "é", "日本", "a b", "x\x00y", "▁", "ß"]
    some = [" ".join(rng.choice(words, 30)) + rng.choice([".", ",", "\n", "\x0b", "?", " \t"]) for _ in range(200)]
    texts = [(rng.choice(["en", "de", "en"]), t) for t in some]
    texts += [("en", "new york times square, new york times!"), (None, "lost and found; lost and found")] * 9
    texts += [("und", "lost and found")] * 3 + [("en", None), (None, None), ("en", ""), ("", "a b a b " * 20)]
    texts += [("fr", "aa " * 400), ("en", "x" * 60_000 + " new york"), ("long", "w" * 3_000 + " " + "v" * 3_000 + "\t" * 9)] * 2
    return texts


@pytest.fixture()
def small(monkeypatch):
    """Small containers, tries and dictionaries, so that all bursts, runs and slices happen."""
    for name, value in (("BURST", 4), ("ENTRIES", 50), ("WORDS", 30), ("BUFFER", 20), ("HASHES", 30), ("SLICE", 64), ("OUT_ROWS", 7)):
        monkeypatch.setattr(C, name, value)


def table(spark, texts):
    return spark.createDataFrame([(t, g, 1, 2, "x") for g, t in texts],
                                 "text string, lang string, f long, rank int, phrase string").repartition(3)


def test_awkward_texts_as_brute_force(spark):
    texts = awkward_texts()
    for top in (2000, 5):
        assert result(C.collocations(table(spark, texts), least=4, top=top)) == brute(texts, 4, 3, top)


def test_two_words_only(spark):
    texts = awkward_texts()
    assert result(C.collocations(table(spark, texts), least=5, longest=2)) == brute(texts, 5, 2, 2000)
    with pytest.raises(ValueError):
        C.collocations(table(spark, texts), longest=4)


def test_empty_and_no_candidate(spark):
    assert C.collocations(table(spark, [])).count() == 0
    assert C.collocations(table(spark, [("en", "one two three")])).count() == 0


def test_bursts_runs_and_slices_lose_nothing(small):
    texts = awkward_texts()
    for size in (1, 2, 3):
        counter, got = {}, Counter()

        def take(batches):
            for b in batches:
                for g, p, f, *_ in zip(*(c.to_pylist() for c in b.columns)):
                    got[g, p] += f
        for g, t in texts:
            g = g or "und"
            c = counter.setdefault(g, C.Counter(g, size, None, False))
            take(c.text((t or "").encode()))
            if c.trie.entries > 40:
                take(c.spill(20))
        for c in counter.values():
            take(c.finish())
        want = Counter()
        for g, t in texts:
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", (t or "").encode().lower().decode()):
                ws = re.findall(r"[^\x20\x09]+", piece)
                want.update((g or "und", " ".join(ws[i:i + size])) for i in range(len(ws) - size + 1))
                if size == 1:
                    want[g or "und", ""] += len(ws)
        assert +got == +want


def test_runs_are_in_order(small):
    c = C.Counter("en", 2, None, False)
    list(c.text(" ".join(np.random.default_rng(4).choice(list("abcdefgh"), 60)).encode()))
    run = [p for b in c.finish() for p in b.column(1).to_pylist()]
    assert run == sorted(run) and len(run) > 20


def test_trie_takes_whole_subtrees():
    t = C.HatTrie(2)
    keys = np.array(sorted((a << 21) | b for a in range(1, 80) for b in range(1, a + 60)))
    t.add(keys, np.ones(len(keys), np.int64))
    assert id(t.root) in t.burst and t.entries == len(keys)
    k, n = t.take(500)
    first = set((k >> 21).tolist())
    assert 500 <= len(k) < 800 and n.sum() == len(k) and t.entries == len(keys) - len(k)
    assert set(k.tolist()) == {x for x in keys.tolist() if x >> 21 in first}
    rest, _ = t.take(t.entries)
    assert sorted([*k.tolist(), *rest.tolist()]) == keys.tolist() and not t.entries


def test_bit_map_holds_every_frequent_hash(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP", 700)
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**64, 3000, dtype="u8")
    c = C.Counter("en", 1, None, True)
    batches = []
    for k in range(4):  # each three times in a run, and others nine times in one run
        c.hashes, c.hashed = [np.repeat(h, 3), np.repeat(rng.integers(0, 2**64, 900, dtype="u8"), 9)], 1
        batches.append(c.screened())
    rows = [r for b in batches for r in zip(*(x.to_pylist() for x in b.columns))]
    found = spark.createDataFrame(rows, "lang string, phrase string, f long, hashes binary, times binary").repartition(5)
    often = C.frequent_hashes(found, 10)
    assert sorted(np.array([r[0] for r in often.collect()]).view("u8").tolist()) == sorted(h.tolist())
    m = C.bit_map(often)
    assert m.has(h).all()
    assert m.has(rng.integers(0, 2**64, 9999, dtype="u8")).mean() < 0.1


def hash_words(words):
    n = C.Numbers(b"en")
    return n.hashes(n.look_up(words))


def test_screening_counts_hashes_of_longer_phrases(small):
    """Over slices, with and without a bit map of the parts."""
    rng = np.random.default_rng(6)
    text = " ".join(rng.choice(list("abcdef") + ["g."], 300)).encode()
    ws = [p.split() for p in text.decode().split(".")]
    word = dict(zip("abcdefg", map(int, hash_words(list(b"a b c d e f g".split())))))

    def h(*p):
        return int(C.phrase_hash([np.array([word[w]], "u8") for w in p])[0])
    for size, some in ((1, None), (2, None), (2, {("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")})):
        allowed = None
        if some:
            data = np.zeros(1 << 17, "u1")
            for p in some:
                at = h(*p) >> 44
                data[at >> 3] |= 1 << (at & 7)
            allowed = C.BitMap(20, data)
        c = C.Counter("en", size, allowed, True)
        got = Counter()
        for b in [*c.text(text), *c.finish()]:
            for x, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if x is not None:
                    got.update(dict(zip(np.frombuffer(x, "u8").tolist(), np.frombuffer(n, "u4").tolist())))
        want = Counter(h(*p[i:i + size + 1]) for p in ws for i in range(len(p) - size)
                       if not some or {tuple(p[i:i + 2]), tuple(p[i + 1:i + 3])} <= some)
        assert got == want and want


def test_exact_beyond_64_bits(spark):
    big = 2**33 + 1
    got = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long").selectExpr(
        "cast(1000000 as decimal(7,0)) * (cast(a as decimal(18,0)) * cast(a as decimal(18,0))) as s",
        "cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as p").selectExpr("s div p").first()[0]
    assert got == 10**6 * big * big // (big * (big + 1))


def test_sql_gives_the_same_rows(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    assert result(C.collocations(spark.read.parquet(path))) == sorted(con.sql(C.oracle()).fetchall())
