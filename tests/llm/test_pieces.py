import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from intakeflow.llm import pieces


def best_cut(v, s):
    """Every segmentation tried."""
    best = None
    for k in range(len(s)):
        for cut in itertools.combinations(range(1, len(s)), k):
            total, ids = 0.0, []
            for a, b in zip((0, *cut), (*cut, len(s))):
                got = v.score.get(s[a:b])
                if got is None and b - a > 1:
                    break
                total += v.unknown if got is None else got[0]
                ids += [v.byte[x] for x in s[a:b].encode()] if got is None else [got[1]]
            else:
                if best is None or total > best[0]:
                    best = (total, ids)
    return best[1] if best else []


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_best_cut_and_round_trip(piece_path):
    v = pieces.vocabulary(piece_path)
    r = random.Random(1)
    words = ["the", "hello", "a  b", " ", "   x", "ñandú", "日本", "x\ny", "東a", "don't", "theheheas", "\0\0"]
    words += ["".join(r.choice("thein aé\nr") for _ in range(r.randint(1, 11))) for _ in range(30)]
    for w in words:
        got = ids(v.encode([pieces.normalised(w)])[0])
        assert got == best_cut(v, pieces.normalised(w)), w
        assert v.decode(got) == w
    assert v.encode([pieces.normalised("")]) == [b""]


def test_words_together_as_one_by_one(piece_path):
    v = pieces.vocabulary(piece_path)
    r = random.Random(7)
    words = ["".join(r.choice("▁theinr aé東\n") for _ in range(r.randint(1, 40))) for _ in range(400)] + ["", "x" * 5000]
    for w, got in zip(words, v.cut_together(words)):
        arc, j, want = v.best(w, len(w))[1], len(w), []
        while j:
            i, k = arc[j]
            want += [k] if k is not None else [v.byte[b] for b in reversed(w[i:j].encode())]
            j = i
        assert ids(got) == want[::-1]


def test_chunks_give_the_best_sum(piece_path):
    v = pieces.vocabulary(piece_path)
    r = random.Random(2)

    def total(x):
        return sum(v.score[v.text[i]][0] if v.text[i] in v.score else v.unknown for i in x)

    for k in range(60):
        parts = ["the", "ing", "a", "▁", "▁the", "er", "\n", "é", "x"] if k % 2 else list("abcdethingor")
        s = "".join(r.choice(parts) for _ in range(r.randint(1, 150)))
        for chunk in (17, 40):
            cuts = pieces.split(s, chunk, v.reach)
            at = pieces.borders(np.stack([pieces.transfer(v, s[a:c], b - a) for a, b, c in cuts]))
            got = ids(b"".join(v.encode([s[a + x:b + y] for (a, b, _), x, y in zip(cuts, at, at[1:])])))
            want = ids(v.encode([s])[0])
            assert total(got) == total(want)
            assert v.decode(got, False) == v.decode(want, False)


def test_scan_is_associative():
    r = np.random.default_rng(0)
    m = r.integers(-9, 9, (7, 3, 3)).astype(float)
    want = m[0]
    for k in range(1, 7):
        want = pieces.combine(want[None], m[k][None])[0]
    assert (pieces.scan(m)[-1] == want).all()


def test_encode_decode_tables(awkward, empty_docs, piece_path):
    got = pieces.encode(awkward, piece_path, chunk=3000)
    back = pieces.decode(got, piece_path).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("parts").alias("parts"), F.count("*").alias("n"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x.text)).alias("t"))
    rows = back.collect()
    assert len(rows) == awkward.count() and all(r.parts == r.n for r in rows)
    want = sorted((r.doc_id or -1, r.text or "") for r in awkward.collect())
    assert sorted((r.doc_id or -1, r.t) for r in rows) == want
    assert max(r.parts for r in rows) > 10
    assert pieces.encode(empty_docs, piece_path).count() == 0
