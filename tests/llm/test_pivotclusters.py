import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from intakeflow.llm import pivotclusters as P

V = "vec_id long, embedding array<float>, label int, cluster string, p long"


def rows(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], V).repartition(3)


def brute(vectors, size, centroids, rounds):
    import hashlib

    kept = [(i, np.floor(256 * np.array(v, "f4").astype(float)).astype(int).tolist()) for i, v in vectors
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centre = [c for _, c in order[:centroids]]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre)) for _, v in kept]

    for _ in range(rounds):
        at = [j for _, j in near()]
        for j in range(len(centre)):
            mine = [v for (_, v), k in zip(kept, at) if k == j]
            if mine:
                centre[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = near()
    return sorted(((-1 if i is None else i, j, d, sum(e for e, k in found if k == j), sum(e for e, _ in found),
                    hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, found)))


def result(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect()))


def test_awkward_vectors_as_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).astype("f4").tolist()) for i in range(300)]
    vectors += [(300 + i, [1.0] * 6) for i in range(50)]                      # equal vectors
    vectors += [(7, vectors[7][1]), (7, vectors[7][1]), (None, [0.5] * 6), (None, [0.0] * 6)]  # repeated, no id, zero
    vectors += [(400, None), (401, []), (402, [1.0] * 5), (403, [None] + [1.0] * 5), (404, [float("nan")] * 6),
                (405, [float("inf")] + [0.0] * 5), (406, [1000.0] * 6)]
    for pivots in (1, 3, 8):
        got = P.clusters(rows(spark, vectors), centroids=12, rounds=3, pivots=pivots, size=6)
        assert result(got) == brute(vectors, 6, 12, 3)


def test_bounds_spare_distances_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(10, 8)) * 20
    vectors = [(i, (middle[i % 10] + rng.normal(size=8) * 0.05).astype("f4").tolist()) for i in range(500)]
    shares = []
    got = P.clusters(rows(spark, vectors), centroids=10, rounds=3, size=8, note=lambda r, s: shares.append(s))
    assert result(got) == brute(vectors, 8, 10, 3)
    assert shares[-1] < 0.6


def test_empty_few_and_large(spark):
    assert P.clusters(rows(spark, []), size=4).count() == 0
    few = [(1, [0.0] * 4), (2, [3.0] * 4)]
    assert result(P.clusters(rows(spark, few), size=4)) == brute(few, 4, 40, 5)
    with pytest.raises(OverflowError):
        P.clusters(rows(spark, [(1, [1e9] * 4)]), size=4)


def test_sql_gives_the_same_rows(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    assert result(P.clusters(spark.read.parquet(path))) == sorted(con.sql(P.oracle()).fetchall())


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 5, 1000, 100_000]))
def test_nearest_is_exact_with_ties(seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (60, 3))
    c = rng.integers(-spread, spread + 1, (9, 3))
    pivots = P.choose_pivots(c, 4)
    table, centre = (np.sqrt(np.stack([P.exact(a, p) for p in pivots], 1)) for a in (x, c))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    number, best, _ = P.nearest(x, table, c, centre)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
    assert (P.bounds(table, centre) <= np.sqrt(d)).all()
