import pickle

import numpy as np
from pyspark.sql import functions as F

from intakeflow.llm import covertree, vptree

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, seed=0, n=300, dim=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype("f4")
    x[50:80] = x[50] + r.normal(size=(30, dim)).astype("f4") * 0.05
    x[100:140] = x[100]          # many equal vectors
    x[150] = 3 * x[100]          # a multiple
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [nan] + [1.0] * (dim - 1), 1), (903, [inf] * dim, 1),
             (904, [None] + [1.0] * (dim - 1), 1), (905, [], 1), (920, [1.0, 2.0], None), (None, [1.0] * dim, 1),
             (940, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, SCHEMA), {i: np.array(v, float) for i, v, _ in rows[:n]}


def test_exact_search_and_ties(spark):
    df, vectors = table(spark)
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    out = vptree.search(df, df.where(F.col("vec_id") % 20 == 0), 7, factor=1.0, shard_rows=90, query_rows=5)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in ids[ids % 20 == 0]:
        s = (x * vectors[q]).sum(1)
        keep = ids != q
        want = np.lexsort((ids[keep], -s[keep]))[:7]
        assert [v for _, v, _ in got[q]] == ids[keep][want].tolist()
        assert [k for k, _, _ in got[q]] == list(range(1, 8))
        assert [v for _, _, v in got[q]] == s[keep][want].tolist()
    assert [v for _, v, _ in got[920]] == [940] and 900 not in got and None not in got


def test_hundreds_of_equal_products(spark):
    """Different vectors with one and the same product: the smallest ids win, in one shard and over shards."""
    r = np.random.default_rng(9)
    rows = [(0, [1.0, 0.0, 0.0], 0)] + [(i, [2.0, float(a), float(b)], 0) for i, (a, b) in
                                         enumerate(r.integers(-50, 50, (400, 2)), 1)]
    rows += [(i, [1.0, float(i), 0.5], 1) for i in range(401, 500)] + [(7, [3.0, 1.0, 1.0], 2), (7, [3.0, 1.0, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("dim", F.lit("clash")).withColumn("shard", F.lit("clash"))
    for shard_rows in (4096, 100):
        out = vptree.search(df, df.where("vec_id = 0"), 20, factor=1.0, shard_rows=shard_rows)
        got = [(x.vec_id, x.score) for x in out.orderBy("rank").collect()]
        # all rows of an id that several share are candidates
        assert got == [(7, 3.0), (7, 3.0)] + [(i, 2.0) for i in range(1, 19)]


def test_cover_trees_gather_little_at_once(monkeypatch):
    """Wide nodes are opened slice by slice, with the same result."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8))
    x[200:] = x[:200] + r.normal(size=(200, 8)) * r.choice([0.02, 0.1, 0.3], (200, 1))
    tree = covertree.CoverTree(np.arange(400), x, np.ones(400))
    half = covertree.CoverTree(np.arange(200), x[200:], np.ones(200))
    want = covertree.links(tree, tree, 0.95, True), covertree.links(half, tree, 0.95, False)
    monkeypatch.setattr(covertree, "STEP", 600)
    monkeypatch.setattr(covertree, "WIDE", 900)
    seen, stack = [], covertree.np.einsum
    monkeypatch.setattr(covertree.np, "einsum", lambda *a: (seen.append(len(a[1])), stack(*a))[1])
    got = covertree.links(tree, tree, 0.95, True), covertree.links(half, tree, 0.95, False)
    assert max(seen) <= 75
    for (a, b, e), (c, d, f) in zip(want, got):
        assert (a == c).all() and (b == d).all()
        n = 400 if not len(b) else 600
        assert (covertree.stars(e, n) == covertree.stars(f, n)).all()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert (want[0][0] == (u @ u.T >= 0.95).sum(1) - 1).all()


def test_independent_vectors_are_hardly_looked_at_one_by_one(monkeypatch):
    """Pairs too far apart to link but nearer than others make no wide nodes, which would meet all others."""
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1800:] = 0.6 * x[:200] + 0.8 * x[1800:]
    x[1700:1710] = x[:10] + 0.01 * r.normal(size=(10, 64))
    tree = pickle.loads(pickle.dumps(covertree.CoverTree(np.arange(2000), x, np.ones(2000))))
    seen, stack = [], np.einsum
    monkeypatch.setattr(covertree.np, "einsum", lambda *a: (seen.append(len(a[1])), stack(*a))[1])
    got = covertree.links(tree, tree, 0.95, True)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert (got[0] == (u @ u.T >= 0.95).sum(1) - 1).all() and got[0].sum() == 20
    assert sum(seen) <= 4000  # of two million pairs


def test_trees_travel_without_loss():
    r = np.random.default_rng(6)
    for x in (r.normal(size=(50, 5)), r.normal(size=(50, 5)).astype("f4").astype(float)):
        tree = covertree.CoverTree(np.arange(50), x, np.ones(50))
        back = pickle.loads(pickle.dumps(tree))
        for k, v in tree.__dict__.items():
            assert np.array_equal(back.__dict__[k], v) and (k != "x" or back.x.itemsize == (8 if (x != x.astype("f4")).any() else 4))
        assert all(back.__dict__[k].dtype == "i8" for k in covertree.CoverTree.NUMBERS)


def test_recall_of_relaxed_search():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = vptree.Tree(np.arange(3000), x)
    q = np.arange(0, 3000, 20)
    got = tree.nearest(q, x[q], 20, vptree.FACTOR).groupby("query_id").vec_id.apply(set)
    hit = 0
    for i in q:
        s = x @ x[i]
        s[i] = -9
        hit += len(got[i] & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(q)


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], SCHEMA)
    rows = vptree.search(df, df.where("vec_id = 0"), 20).collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(1, 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert vptree.search(empty, empty).count() == 0
    assert covertree.near_duplicates(empty).count() == 0


def test_links_and_components(spark):
    df, vectors = table(spark)
    df = df.unionByName(df.where("vec_id in (5, 101)")).withColumn("n_links", F.lit("clash"))
    ids = sorted(vectors) + [5, 101]
    x = np.stack([vectors[i] for i in ids])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in range(30):
        label = np.minimum(label, np.where(near, label[None, :], 10**6).min(1))
    want = sorted((i, int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), label))
    for block in (64, 8192):
        got = covertree.near_duplicates(df, block_rows=block).collect()
        mine = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got
                      if r.vec_id is not None and r.vec_id < 900)
        assert mine == want
        rest = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id >= 900}
        assert all(rest[i].n_links == 0 and rest[i].kept for i in range(900, 906))
        assert rest[920].n_links == 1 and rest[940].component_id == 920
        assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]


def test_tree_covers(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    t = covertree.CoverTree(np.arange(400), x, np.ones(400))
    for i in range(len(t.centre)):
        members = t.order[t.lo[i]:t.hi[i]]
        d = np.sqrt(((t.u[members] - t.u[t.centre[i]]) ** 2).sum(1))
        assert d.max() <= t.radius[i] + 1e-7
        assert t.centre[i] in members
