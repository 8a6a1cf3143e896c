import numpy as np

from intakeflow.llm import toxicity


def corpus(n, seed):
    r = np.random.default_rng(seed)
    plain = [f"w{i}" for i in range(300)]
    bad = ["grumblefoo", "grumblebar", "snarlwort"]
    lists, y = [], []
    for i in range(n):
        words = list(r.choice(plain, r.integers(20, 60)))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(r.integers(0, len(words))), str(r.choice(bad)))
        lists.append(words)
        y.append(int(toxic))
    return lists, np.array(y)


def test_held_out_and_marginals():
    field = toxicity.learn(*corpus(240, 1))
    lists, y = corpus(120, 2)
    score, marginals = field.scores(lists)
    assert ((score >= toxicity.PREDICT) == (y == 1)).mean() > 0.97
    a = np.exp(field.move)
    for words, got in zip(lists[:30], marginals):  # plain forward-backward
        e = np.array([np.exp(np.clip(field.weight[toxicity.hashed(w)].sum() + field.bias, -30, 30)) for w in words])
        f, b = np.zeros((len(e), 2)), np.ones((len(e), 2))
        for i in range(len(e)):
            v = (np.exp(field.begin) if i == 0 else f[i - 1] @ a) * [1, e[i]]
            f[i] = v / v.sum()
        for i in range(len(e) - 2, -1, -1):
            v = a @ ([1, e[i + 1]] * b[i + 1])
            b[i] = v / v.sum()
        p = f * b
        assert np.abs(p[:, 1] / p.sum(1) - got).max() < 1e-9


def test_chunked_recursion_over_long_lists():
    field = toxicity.learn(*corpus(120, 3))
    lists, _ = corpus(8, 4)
    one = [w for words in lists for w in words] * 5
    whole = field.marginals([one, [], one[:1], one])
    assert len(whole[1]) == 0 and np.abs(whole[0] - whole[3]).max() < 1e-11


def test_tables(spark, awkward, empty_docs):
    lists, y = corpus(120, 5)
    docs = spark.createDataFrame([(1000 + i, " ".join(w)) for i, w in enumerate(lists)], "doc_id long, text string")
    labels = spark.createDataFrame([(1000 + i, 1, int(k)) for i, k in enumerate(y)] + [(None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    field = toxicity.fit(docs, labels)
    out = toxicity.score(awkward.withColumnRenamed("source", "score").select("doc_id", "text", "score"), field)
    assert out.columns == ["doc_id", "score", "predicted", "spans"]
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.predicted for r in rows)
    bad = spark.createDataFrame([(1, "so  snarlwort, w1 grumblefoo w2 snarlwort")], "doc_id long, text string")
    row = toxicity.score(bad, field).first()
    assert row.predicted == 1 and [(s.start, s.end) for s in row.spans][0] == (4, 14)
    none = toxicity.fit(empty_docs, labels)
    assert none is None and {r.predicted for r in toxicity.score(awkward, none).collect()} == {0}
    assert toxicity.score(empty_docs, field).count() == 0


def test_long_and_conflicting_labels(spark):
    """Toxic documents that are all long give a model; an id labelled both ways counts as toxic, on every run."""
    r = np.random.default_rng(8)
    plain = np.array([a + b for a in "bdfgklmnprst" for b in ("ain", "ona", "erit", "uval", "iso", "ench")])
    rows = []
    for i in range(60):
        words = r.choice(plain, 5_000).tolist()
        for at in range(0, 5_000, 40):
            words[at:at] = ["vile", "scum"] if i % 2 else ["good", "day"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (3, 0), (5, None), (None, 1), (77, 1)],
                                   "doc_id long, toxic int").repartition(2)
    assert min(len(t) for _, t in rows) > toxicity.TRAIN_CHARS
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got == {i: i % 2 for i in range(60)}
