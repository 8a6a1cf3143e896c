import itertools

import numpy as np

from intakeflow.llm import probminhash as P


def shingle(text):
    return P.shingles(next(P.word_lists([text])))


def plain(a, b):
    """Probability Jaccard from its definition."""
    x, y = dict(zip(*map(np.ndarray.tolist, a))), dict(zip(*map(np.ndarray.tolist, b)))
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def test_similarity_and_estimate():
    r = np.random.default_rng(0)
    for top in (1, 4):
        est, true = [], []
        for _ in range(25):
            u = r.integers(1, 2**62, 260).astype("u8")
            a, b = np.sort(u[:200]), np.sort(u[60:])
            a, b = (a, r.integers(1, top + 1, 200)), (b, r.integers(1, top + 1, 200))
            assert abs(P.similarity(a, b) - plain(a, b)) < 1e-9
            true.append(plain(a, b))
            est.append((P.signature(*a) == P.signature(*b)).mean())
        assert abs(np.mean(est) - np.mean(true)) < 0.03


def test_classes_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.class_id, r.kept) for r in P.classes(docs).collect()}
    parts = {r.doc_id: shingle(r.text or "") for r in rows}
    label = {i: i for i in parts}
    links = [(a, b) for a, b in itertools.combinations(parts, 2) if P.similarity(parts[a], parts[b]) >= P.LIMIT]
    assert links
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {i: (c, i == c) for i, c in label.items()}


def test_large_bucket_is_resolved_by_hubs(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in r.integers(0, 5000, 120)]
    rows = []
    for i in range(150):  # copies with one word changed, in two families that share a part
        text = words[:60] + ([f"v{j}" for j in range(60)] if i % 2 else words[60:])
        text[int(r.integers(0, 120))] = f"z{i}"
        rows.append((i, " ".join(text)))
    got = {x.doc_id: x.class_id for x in P.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(0, 150, 2)} == {0} and {got[i] for i in range(1, 150, 2)} == {1}


def test_awkward_rows(awkward, empty_docs):
    rows = P.classes(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id in (200, 201, 202):
            assert (r.class_id, r.kept) == (r.doc_id, True)
    assert [(r.class_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {(r.class_id, r.kept) for r in rows if r.doc_id in (204, 205)} == {(0, False)}  # near row 0
    assert P.classes(empty_docs).count() == 0
