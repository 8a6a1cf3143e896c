import itertools
import math
from collections import Counter

import numpy as np

from intakeflow.llm import langid
from tests.llm.conftest import DE, EN


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "a", "ab", "b", "bc", "c", "abc", "▁"]
    lattice = langid.Lattice(pieces)
    p = np.zeros((lattice.none + 1, 2))
    r = np.random.default_rng(0)
    p[:len(pieces)] = r.random((len(pieces), 2)) / 10
    p[lattice.size] = langid.FLOOR
    index = {s: i for i, s in enumerate(pieces)}

    def plain(word, g):
        w, total = "▁" + word, 0.0
        for k in range(len(w)):
            for cut in itertools.combinations(range(1, len(w)), k):
                q = 1.0
                for a, b in zip((0, *cut), (*cut, len(w))):
                    s = w[a:b]
                    q *= p[index[s], g] if s in index else langid.FLOOR if len(s) == 1 else 0.0
                total += q
        return math.log(total)

    words = ["a", "abc", "abcabc", "xbc", "cabcabcab"]
    got = lattice.log_probability(words, p)
    for i, w in enumerate(words):
        for g in range(2):
            assert abs(got[i, g] - plain(w, g)) < 1e-9
    long = lattice.log_probability(["ab" * 5000], p)  # rescaled, no underflow
    assert np.isfinite(long).all()


def test_identify_awkward_rows(awkward, piece_path):
    model = langid.fit(awkward, piece_path)
    assert model.languages == ["de", "en"]
    clash = awkward.withColumnRenamed("n_chars", "score").withColumnRenamed("source", "lang_pred")
    out = langid.identify(clash.select("doc_id", "text", "score", "lang_pred"), model)
    assert out.columns == ["doc_id", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    got = {r.doc_id: r for r in rows}
    assert all(got[i].lang_pred == "en" and got[100 + i].lang_pred == "de" for i in range(20))
    for i in (200, 201, 202, 203):  # null, empty, blank, no letter
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[206].lang_pred == "en" and got[208].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in rows)


def test_empty_tables(empty_docs, awkward, piece_path):
    model = langid.fit(empty_docs, piece_path)
    assert model.languages == []
    assert {r.lang_pred for r in langid.identify(awkward, model).collect()} == {"und"}
    assert langid.identify(empty_docs, model).count() == 0


def test_held_out_accuracy(spark):
    from intakeflow.llm import catalog
    from intakeflow.llm.common import table

    sf = "/root/testdata/sf0.001"
    out = catalog.op1_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out and lang is not null").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_every_labelled_language_is_learned(spark, piece_path):
    # texts that are all long, few texts in many copies, and more languages than any count
    rows = [(i, f"{EN} {i} " * 200, "en") for i in range(20)]
    rows += [(100 + i, f"{DE} {i % 3}", "de") for i in range(3000)]
    rows += [(10_000 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}qq " * 5, f"l{i:02d}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, piece_path)
    assert model.languages == sorted({r[2] for r in rows})
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id in (0, 100)"), model).collect()}
    assert got == {0: "en", 100: "de"}


def test_excerpt():
    assert langid.excerpt("ab cd", 10) == "ab cd"
    whole = " ".join(f"w{i}x" for i in range(5000))
    got = langid.excerpt(whole, 1000)
    assert 800 < len(got) <= 1010 and set(got.split()) <= set(whole.split())
    assert len(langid.excerpt("x" * 5000, 1000)) == 1009


def test_long_texts_by_parts_and_many_languages(monkeypatch):
    pieces = ["▁a", "a", "b", "▁"]
    model = langid.Model(["u", "v"], pieces, np.random.default_rng(1).random((len(pieces) + 2, 2)) / 9)
    model.p[-1] = 0
    texts = ["a b ab", None, "aab " * 50, "1", "b"]
    whole = list(model.posteriors(texts))
    monkeypatch.setattr(langid, "CACHE_FLOATS", 8)
    model._cache = None
    for x, y in zip(whole, model.posteriors(texts), strict=True):
        assert (x is None) == (y is None) and (x is None or np.allclose(x, y))


def test_words_of_any_length_are_learned(piece_path):
    pieces = langid.vocabulary(piece_path)
    assert max(map(len, pieces)) == 16
    lattice = langid.Lattice(pieces)
    r = np.random.default_rng(3)

    def joined(words):
        return "".join(r.choice(words.split(), 40))

    p = [lattice.learn(Counter(joined(w) for _ in range(60))) for w in (EN, DE)]
    got = lattice.log_probability([joined(EN), joined(DE)], np.stack(p, 1))
    assert got[0, 0] > got[0, 1] + 20 and got[1, 1] > got[1, 0] + 20
    # sentences without blanks in one script
    kana = ["わたしは", "がっこうへ", "いきます", "きょうも", "あめです"], ["たしかに", "かいしゃへ", "いきました", "きのうは", "ゆきでした"]
    p = [lattice.learn(Counter("".join(r.choice(k, 10)) for _ in range(60))) for k in kana]
    got = lattice.log_probability(["".join(r.choice(k, 10)) for k in kana], np.stack(p, 1))
    assert got[0, 0] > got[0, 1] and got[1, 1] > got[1, 0]


def test_learning_counts_all_segmentations():
    # one round by hand, over all segmentations, of a short word and of one that is filled up
    pieces = ["▁a", "a", "aa", "b", "ab", "▁"]
    lattice = langid.Lattice(pieces)
    long = "ab" * 20
    for word in ("aab", long):
        start, got = lattice.learn(Counter([word]), 0), lattice.learn(Counter([word]), 1)
        w, index = "▁" + word, {s: i for i, s in enumerate(pieces)}
        n = len(w)
        f, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]

        def arc(i, j):
            return start[index[w[i:j]]] if w[i:j] in index else langid.FLOOR if j == i + 1 else 0.0

        for j in range(1, n + 1):
            f[j] = sum(f[i] * arc(i, j) for i in range(j))
        for i in range(n - 1, -1, -1):
            b[i] = sum(arc(i, j) * b[j] for j in range(i + 1, n + 1))
        want = np.full(len(pieces), 0.01)
        for i in range(n):
            for j in range(i + 1, n + 1):
                if w[i:j] in index:
                    want[index[w[i:j]]] += f[i] * arc(i, j) * b[j] / f[n]
        assert np.allclose(got[:len(pieces)], want / want.sum(), rtol=1e-6)
