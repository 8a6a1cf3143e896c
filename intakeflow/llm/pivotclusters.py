"""Centroid clustering of whole-number vectors with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and stored beside it.  In every round
the centroids' distances to the same pivots are few numbers, and by the triangle inequality the largest
difference between a vector's and a centroid's distances to a pivot is a lower bound of their distance.
The centroid with the least bound is examined first; only centroids whose bound does not
exceed its distance receive an exact distance, in whole numbers.  A bound is lowered by a margin
far above the rounding of square roots, so no nearest or tied centroid is lost.

Every round is one pass over the stored table.  Tasks return one row of sums for every centroid, so a cluster
that holds most vectors is summed where they lie, and the driver sees centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import written

SIZE = 64          # components of a vector
SCALE = 256        # a component x becomes floor(SCALE * x)
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 8         # fixed, taken from the starting centroids far from one another
ROWS = 4096        # vectors examined at once
LARGEST = 1 << 27  # integers stay below this, so sums of SIZE squared differences fit 64 bits
MARGIN = 1e-9      # of a distance; rounding is below 1e-14

_TABLE = "vec_id long, v array<long>, p array<long>"


def kept(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, vec_id: str = "vec_id",
         column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``size`` components, none null or non-finite."""
    x = F.col(f"`{column}`").cast("array<double>")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).where(
        F.coalesce((F.size("x") == size) & fine, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def starting(rows: DataFrame, centroids: int = CENTROIDS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of these; ties by the vector, rows without
    an id last."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(centroids).collect()
    return np.array([r.v for r in first], np.int64)


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to one vector, or row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(start: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The first starting centroid, then always the one farthest from the pivots chosen so far."""
    chosen = start[:1]
    far = exact(start, start[0])
    while len(chosen) < min(pivots, len(start)) and far.max() > 0:
        chosen = np.concatenate([chosen, start[far.argmax()][None]])
        far = np.minimum(far, exact(start, chosen[-1]))
    return chosen


def bounds(table: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Lower bounds [vector, centroid] of distances from distances [vector, pivot] and [centroid, pivot]."""
    low = np.zeros((len(table), len(centre)))
    for k in range(table.shape[1]):
        np.maximum(low, np.abs(table[:, k, None] - centre[None, :, k]), out=low)
    largest = max(table.max(initial=0.0), centre.max(initial=0.0))
    return low - MARGIN * largest


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, centre: np.ndarray):
    """(centroid, squared distance) of every vector; ties go to the smaller number.  ``table`` and ``centre``
    hold the pivot distances of vectors and centroids.  Also how many exact distances were computed."""
    low = bounds(table, centre)
    guess = low.argmin(1)
    best = exact(x, centroids[guess])
    number, done = guess.copy(), len(x)
    for j in range(len(centroids)):
        left = np.flatnonzero((low[:, j] <= np.sqrt(best)) & (guess != j))
        if not len(left):
            continue
        d = exact(x[left], centroids[j])
        done += len(left)
        better = (d < best[left]) | ((d == best[left]) & (j < number[left]))
        best[left[better]], number[left[better]] = d[better], j
    return number, best, done


def _blocks(batches, pivots: int | None = None) -> Iterator[tuple]:
    """(vec_id column, vectors, pivot distances) of at most ``ROWS`` rows."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            s = b.slice(k, ROWS)
            x = s.column(1).flatten().to_numpy().reshape(s.num_rows, -1)
            if s.num_rows:
                yield (s.column(0), x) if pivots is None else (
                    s.column(0), x, np.sqrt(s.column(2).flatten().to_numpy().reshape(s.num_rows, pivots)))


def _lists(a: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(a).ravel(), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), flat)


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, p): every vector with its squared distances to the pivots, written."""
    def run(batches):
        for ids, x in _blocks(batches):
            if np.abs(x).max() >= LARGEST:
                raise OverflowError(f"a component of {LARGEST} or more: squared distances exceed 64 bits")
            p = np.stack([exact(x, c) for c in pivots], 1)
            yield pa.RecordBatch.from_arrays([ids, _lists(x), _lists(p)], names=["vec_id", "v", "p"])

    return written(rows.mapInArrow(run, _TABLE), "pivot-table")


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS,
             size: int = SIZE, scale: int = SCALE,
             note: Callable[[int, float], None] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the kept vectors.

    ``vectors (vec_id, embedding)``; other columns are left alone.  Vectors of another length, null
    ones and those with null or non-finite components are not kept.  Repeated rows and rows without an id are
    vectors like all others; the latter start no centroid unless there are too few others.  With fewer
    vectors than ``centroids`` there are as many centroids as vectors; equal vectors may start several, of
    which the smallest number wins.  A component whose integer reaches 2^27 in size raises an error.
    ``note(round, share)`` is told which share of all distances was computed in a round.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, size, scale)
    start = starting(rows, centroids)
    if not len(start):
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"))))
    if np.abs(start).max() >= LARGEST:
        raise OverflowError(f"a component of {LARGEST} or more: squared distances exceed 64 bits")
    chosen = choose_pivots(start, pivots)
    table = pivot_table(rows, chosen)
    centre = start.copy()

    def shared(now: np.ndarray):
        to_pivots = np.sqrt(np.stack([exact(now, c) for c in chosen], 1))
        return spark.sparkContext.broadcast((now, to_pivots))

    for r in range(rounds):
        state = shared(centre)

        def sums(batches, state=state):
            now, to_pivots = state.value
            n = np.zeros(len(now), np.int64)
            done = np.zeros(len(now), np.int64)
            total = np.zeros(now.shape, np.int64)
            for _, x, p in _blocks(batches, len(chosen)):
                number, _, count = nearest(x, p, now, to_pivots)
                n += np.bincount(number, minlength=len(now))
                done[0] += count
                for j in np.unique(number):
                    total[j] += x[number == j].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now)), pa.int32()), pa.array(n), pa.array(done),
                                              _lists(total)], names=["cluster", "n", "done", "total"])

        part = table.mapInArrow(sums, "cluster int, n long, done long, total array<long>")
        wide = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(size)]
        got = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("done").alias("done"), *wide).collect()
        state.destroy()
        centre = centre.copy()
        for one in got:
            if one.n:
                centre[one.cluster] = [int(one[f"t{k}"]) // one.n for k in range(size)]
        if note:
            note(r, sum(o.done for o in got) / max(1, len(start) * sum(o.n for o in got)))

    state = shared(centre)

    def assign(batches):
        now, to_pivots = state.value
        for ids, x, p in _blocks(batches, len(chosen)):
            number, best, _ = nearest(x, p, now, to_pivots)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(best, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    found = written(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "pivot-clusters")
    state.destroy()
    inertia = {r.cluster: r.i for r in found.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    about = [(j, int(inertia.get(j, 0)), int(sum(inertia.values())),
              hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centre)]
    # one row for every centroid
    info = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                          "centroid_sha256")


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> str:
    """The same rows in DuckDB's SQL over ``embeddings``."""
    steps = [f"""rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
       list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c FROM rows
  QUALIFY c < {centroids}),
centre0 AS MATERIALIZED (SELECT c, i, x::HUGEINT AS x FROM first JOIN parts USING (r))"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, c, d FROM
  (SELECT p.r, m.c, sum((p.x - m.x) * (p.x - m.x))::BIGINT AS d FROM parts p JOIN centre{k} m USING (i) GROUP BY p.r, m.c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{k} JOIN parts USING (r)
  GROUP BY c, i),
centre{k + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM centre{k} m LEFT JOIN sums{k} USING (c, i))""")
    return "WITH " + ",\n".join(steps) + f""",
names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centre{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN rows USING (r) JOIN names USING (c)
"""
