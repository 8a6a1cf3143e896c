"""Near-duplicate vectors: exact cosine pairs by dual traversal of cover trees.

Equal vectors are one class.  Classes are dealt into cells by their nearest pivot (a bounded sample
of vectors) and cells into blocks of bounded size; cells whose covering radii show that no pair
can be near enough never meet.  Every block holds a cover tree over unit vectors: nested
levels with halving radii, each node with its exact covering radius.  Two trees (or one with itself)
are traversed together: a pair of nodes is dropped when the distance of the centres exceeds
both radii and the limit, linked as a whole when even the farthest points are within it, and opened
otherwise.  Single pairs are decided by the cosine of the original vectors in double precision.
Links are counted and connected inside the task, so no list of all pairs leaves it.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.llm.common import components, shuffle_partitions, written
from intakeflow.llm.vectors import matrix, typed, usable

BLOCK_ROWS = 65536  # most vectors of a block, and the least where that leaves fewer than BLOCKS blocks
LEAST_ROWS = 8192
BLOCKS = 10
PIVOTS = 256       # most pivots; the sample they are drawn from has as many vectors
LIMIT = 0.95
MARGIN = 1e-6      # bounds are widened by this much, far above rounding
FIRST = 0.5        # radius of the first level: wider nodes lie too near each other on the sphere to be told apart
FINEST = 1e-3      # covering radius below which a node's points are its children
STEP = 4_000_000   # numbers (node pairs x dimensions) examined at once
WIDE = 1 << 18     # products of two nodes' children looked at at once, in single precision ...
SINGLE = 2e-5      # ... which is off by less than this
MOST_PARTS = 2000  # partitions that pairs of blocks are dealt into at most, or the session's if those are more
FEW = 2048         # up to so many, they are looked at together with those of other pairs of nodes


class CoverTree:
    """Nested levels with halving radii over the unit vectors of ``x``."""

    NUMBERS = ("order", "centre", "lo", "hi", "first", "last")

    def __init__(self, ids: np.ndarray, x: np.ndarray, count: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.count = ids[order], np.ascontiguousarray(x[order]), count[order]
        self.norm = np.sqrt((self.x * self.x).sum(1))
        u = self.u
        small = u.astype("f4")
        centre, radius, lo, hi, first, last = [0], [2.0], [0], [len(u)], [0], [0]
        self.order = np.arange(len(u))
        queue = [(0, 2 * FIRST)]
        while queue:
            node, r = queue.pop()
            if hi[node] - lo[node] == 1:
                radius[node] = 0.0
                continue
            some = self.order[lo[node]:hi[node]].copy()
            r /= 2
            own = centre[node]
            rest = some[some != own]
            radius[node] = float(np.sqrt(np.maximum(2 - 2 * (u[rest] @ u[own]), 0)).max())
            while r > radius[node] and r > FINEST:  # levels at which nothing parts are left out
                r /= 2
            if r <= FINEST or len(some) <= 4:
                groups = [(c, np.array([c])) for c in [own, *rest]]
            else:
                groups = _net(small, own, rest, r)
            at, first[node] = lo[node], len(centre)
            for c, members in groups:
                self.order[at:at + len(members)] = members
                queue.append((len(centre), r))
                centre.append(int(c))
                radius.append(0.0)
                lo.append(at)
                at += len(members)
                hi.append(at)
                first.append(0)
                last.append(0)
            last[node] = len(centre)
        self.centre, self.radius, self.lo, self.hi, self.first, self.last = map(
            np.array, (centre, radius, lo, hi, first, last))

    @property
    def u(self) -> np.ndarray:
        return self.x / self.norm[:, None]

    def unit(self, which: np.ndarray) -> np.ndarray:
        return self.x[which] / self.norm[which, None]

    def __getstate__(self):
        """Without loss in fewer bytes: numbers of nodes and rows as 32 bits, as are vectors that came so."""
        some = {k: v.astype("i4") if k in self.NUMBERS else v for k, v in self.__dict__.items()}
        small = self.x.astype("f4")
        return some | ({"x": small} if np.array_equal(self.x, small) else {})

    def __setstate__(self, state):
        self.__dict__.update({k: v.astype("i8") if k in self.NUMBERS else v for k, v in state.items()})


def _net(u: np.ndarray, own: int, rest: np.ndarray, r: float) -> list[tuple[int, np.ndarray]]:
    """Centres further than r apart that cover all points within r, ``own`` among them (as far as single
    precision tells: nodes' radii are measured apart)."""
    close = np.float32(1 - r * r / 2)
    groups: list[tuple[int, list]] = []
    left, some = rest, np.array([own])
    gone = np.zeros(len(u), bool)
    while len(some):
        near = u[some] @ u[some].T >= close
        free, centres = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                centres.append(i)
                free &= ~near[i]
        centres = some[centres]
        base = len(groups)
        groups += [(int(c), [np.array([c])]) for c in centres]
        gone[centres] = True
        left = left[~gone[left]]
        taken = np.zeros(len(left), bool)
        middle = np.ascontiguousarray(u[centres].T)
        for k in range(0, len(left), 1024):
            part = left[k:k + 1024]
            s = u[part] @ middle
            hit = np.flatnonzero((s >= close).any(1))
            if not len(hit):
                continue
            best = s[hit].argmax(1)
            taken[k + hit] = True
            by = np.argsort(best, kind="stable")
            for g, members in zip(*_split(best[by], part[hit[by]])):
                groups[base + g][1].append(members)
        left = left[~taken]
        some = left[:512]
    return [(c, np.concatenate(m)) for c, m in groups]


def _split(key: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Runs of equal sorted keys: (keys, values of each)."""
    if not len(key):
        return [], []
    cut = np.flatnonzero(np.diff(key)) + 1
    return key[np.concatenate([[0], cut])].tolist(), np.split(values, cut)


def _product(first: np.ndarray, last: np.ndarray, first2: np.ndarray, last2: np.ndarray):
    """All pairs of ranges [first, last) x [first2, last2), row by row."""
    n, m = last - first, last2 - first2
    size = n * m
    row = np.repeat(np.arange(len(n)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return first[row] + k // m[row], first2[row] + k % m[row], row


def _by_radius(tree: CoverTree, unit: np.ndarray, first: int, last: int):
    """The nodes [first, last) by ascending radius: (numbers, radii, centres)."""
    node = first + np.argsort(tree.radius[first:last], kind="stable")
    return node, tree.radius[node], unit[tree.centre[node]]


def links(a: CoverTree, b: CoverTree, limit: float, same: bool):
    """Link counts of a's and b's vectors (weighted by the size of the class met) and a star of every
    connected part: (counts of a, counts of b, edges [[i, j]] over a's vectors and then b's)."""
    far = np.sqrt(2 - 2 * limit)
    n = len(a.x)
    total_a = np.zeros(len(a.x) + 1)
    total_b = np.zeros(len(b.x) + 1)
    weight_a = np.concatenate([[0], np.cumsum(a.count[a.order])])
    weight_b = np.concatenate([[0], np.cumsum(b.count[b.order])])
    got_a, got_b = np.zeros(len(a.x)), np.zeros(len(b.x))
    edges: list[np.ndarray] = []
    whole_a, whole_b = np.zeros(len(a.centre), bool), np.zeros(len(b.centre), bool)
    off = 0 if same else n

    a4 = a.u.astype("f4")
    b4 = a4 if same else b.u.astype("f4")
    held: list = [None]
    edge_rows = 0
    most = max(64, STEP // a.x.shape[1])  # node pairs examined at once
    # node pairs to open; of one pair with many children also the tile from which on they are still to be looked at
    stack = [(np.array([0]), np.array([0]), 0)]

    def link(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal edge_rows
        if len(i):
            edges.append(np.stack([i, j + off], 1))
            edge_rows += len(i)
        if edge_rows > 4 * (n + len(b.x)):  # a spanning star says as much as all links
            joined = stars(np.concatenate(edges), n + (0 if same else len(b.x)))
            edges[:] = [np.stack([np.arange(len(joined)), joined], 1)]
            edge_rows = len(joined)

    def examine(p: np.ndarray, q: np.ndarray, parent: np.ndarray) -> None:
        """Drop, link or keep open the pairs of children, at most ``most``; ``parent``: of a node with itself."""
        if same:  # of a node with itself every pair of children once
            up = ~parent | (p <= q)
            p, q = p[up], q[up]
        if not len(p):
            return
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.unit(a.centre[p]), b.unit(b.centre[q])), 0))
        reach = a.radius[p] + b.radius[q]
        near = d - reach <= far + MARGIN
        one = (a.hi[p] - a.lo[p] == 1) & (b.hi[q] - b.lo[q] == 1)
        itself = (p == q) if same else np.zeros(len(p), bool)
        sure = near & ~one & (np.where(itself, 2 * a.radius[p], d + reach) <= far - MARGIN)
        # whole nodes
        if sure.any():
            i, j, me = p[sure], q[sure], itself[sure]
            met = weight_b[b.hi[j]] - weight_b[b.lo[j]]
            np.add.at(total_a, a.lo[i], met)
            np.add.at(total_a, a.hi[i], -met)
            whole_a[i] = True
            met = (weight_a[a.hi[i]] - weight_a[a.lo[i]])[~me]
            np.add.at(total_b, b.lo[j[~me]], met)
            np.add.at(total_b, b.hi[j[~me]], -met)
            whole_b[j[~me]] = True
            link(a.centre[i], b.centre[j])
            for k in i[me]:  # a node linked with itself has counted each vector's own class
                got_a[a.order[a.lo[k]:a.hi[k]]] -= a.count[a.order[a.lo[k]:a.hi[k]]]
        # single pairs
        pick = near & one & ~itself
        i, j = a.centre[p[pick]], b.centre[q[pick]]
        cosine = (a.x[i].astype(float) * b.x[j]).sum(1) / (a.norm[i] * b.norm[j])
        i, j = i[cosine >= limit], j[cosine >= limit]
        np.add.at(got_a, i, b.count[j])
        np.add.at(got_b, j, a.count[i])
        link(i, j)
        open_ = near & ~one & ~sure
        if open_.any():
            stack.append((p[open_], q[open_], 0))

    def tile(p: int, q: int, done: tuple[int, int]) -> None:
        """One tile of the products of the children of two nodes, by ascending radius."""
        if held[0] != (p, q):
            held[:] = [(p, q), *_by_radius(a, a4, fa[0], la[0]), *_by_radius(b, b4, fb[0], lb[0])]
        _, row, ra, xa, column, rb, xb = held
        high = min(len(row), max(1, int(WIDE ** 0.5)))
        wide = max(1, WIDE // high)
        me = same and p == q
        # of a node with itself the tiles on and above the diagonal
        k, m = done
        nxt = (k, m + wide) if m + wide < len(column) else (k + high, (k + high) // wide * wide if me else 0)
        if nxt[0] < len(row):
            stack.append((np.array([p]), np.array([q]), nxt))
        ra, rb = ra[k:k + high], rb[m:m + wide]
        # two nodes may hold a near pair if their centres are within the limit and both radii
        s = xa[k:k + high] @ xb[m:m + wide].T
        reach = far + MARGIN + ra[-1] + rb
        hit = np.flatnonzero(s >= (1 - SINGLE - reach * reach / 2).astype("f4"))
        if not len(hit):
            return
        i, j = np.divmod(hit, s.shape[1])
        reach = far + MARGIN + ra[i] + rb[j]
        keep = s.ravel()[hit] >= 1 - SINGLE - reach * reach / 2
        if me:
            keep &= i + k <= j + m
        i, j = row[i[keep] + k], column[j[keep] + m]
        if me:
            i, j = np.minimum(i, j), np.maximum(i, j)
        for k in range(0, len(i), most):
            examine(i[k:k + most], j[k:k + most], np.full(len(i[k:k + most]), me))

    while stack:
        p, q, done = stack.pop()
        # children of a pair's nodes; a single point is its own child
        fa = np.where(a.first[p] < a.last[p], a.first[p], p)
        la = np.where(a.first[p] < a.last[p], a.last[p], p + 1)
        fb = np.where(b.first[q] < b.last[q], b.first[q], q)
        lb = np.where(b.first[q] < b.last[q], b.last[q], q + 1)
        size = (la - fa) * (lb - fb)
        big = size > min(FEW, most)
        if len(p) == 1 and big[0]:
            tile(int(p[0]), int(q[0]), done or (0, 0))
            continue
        if big.any():
            stack += [(p[k:k + 1], q[k:k + 1], 0) for k in np.flatnonzero(big)]
            if not big.all():
                stack.append((p[~big], q[~big], 0))
            continue
        cost = np.cumsum(size)
        if cost[-1] <= most:
            i, j, row = _product(fa, la, fb, lb)
            examine(i, j, (p == q)[row])
        else:  # fewer pairs at a time
            cut = min(max(1, int(np.searchsorted(cost, most))), len(p) - 1)
            stack += [(p[cut:], q[cut:], 0), (p[:cut], q[:cut], 0)]
    got_a[a.order] += np.cumsum(total_a)[:-1]
    got_b[b.order] += np.cumsum(total_b)[:-1]
    # the points of a node that was linked as a whole are connected through the other side
    for tree, whole, shift in ((a, whole_a, 0), (b, whole_b, off)):
        for i in np.flatnonzero(whole):
            members = tree.order[tree.lo[i]:tree.hi[i]] + shift
            edges.append(np.stack([members, np.full(len(members), tree.centre[i] + shift)], 1))
    if same:
        got_a, got_b = got_a + got_b, np.zeros(0)
    return got_a, got_b, np.concatenate(edges) if edges else np.zeros((0, 2), int)


def stars(edges: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of every vertex's connected part."""
    label = np.arange(n)
    while len(edges):
        low = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[edges[:, 0]], low)
        np.minimum.at(new, label[edges[:, 1]], low)
        new = np.minimum(new, new[label])
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    return label


def _pairs(classes: DataFrame, limit: float, block_rows: int, name: str) -> DataFrame:
    """(id, links, root) of the classes (class_id, embedding, m) of one vector length."""
    n = classes.count()
    block_rows = min(block_rows, max(LEAST_ROWS, -(-n // BLOCKS)))
    want = min(PIVOTS, max(1, -(-n // block_rows)))
    drawn = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(want).collect()
    unit = np.array([r.embedding for r in drawn], float).reshape(len(drawn), -1)
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    shared = classes.sparkSession.sparkContext.broadcast(unit)

    def deal(batches):
        for b in batches:
            x = matrix(b["embedding"])
            if not len(x):
                continue
            s = (x / np.sqrt((x * x).sum(1))[:, None]) @ shared.value.T
            cell = s.argmax(1)
            yield b.assign(cell=cell.astype("int32"),
                           away=np.arccos(np.clip(s[np.arange(len(x)), cell], -1, 1)))

    dealt = written(classes.mapInPandas(deal, "class_id long, embedding array<double>, m long, cell int, away double"),
                    name)
    # cells (at most PIVOTS) that may hold a linked pair: angles obey the triangle inequality
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).orderBy("cell").collect()
    apart = np.arccos(np.clip(unit @ unit.T, -1, 1))
    reach = np.arccos(limit) + MARGIN
    meet = [(a.cell, b.cell) for a in cells for b in cells
            if a.cell == b.cell or apart[a.cell, b.cell] <= a.away + b.away + reach]
    spark = classes.sparkSession
    meeting = F.broadcast(spark.createDataFrame(meet, "cell int, cell2 int"))
    subs = F.broadcast(spark.createDataFrame([(c.cell, -(-c.n // block_rows)) for c in cells], "cell int, subs int"))
    blocked = dealt.join(subs, "cell").withColumn("sub", F.pmod(F.xxhash64("class_id"), F.col("subs")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(pdf["class_id"].to_numpy(), matrix(pdf["embedding"]), pdf["m"].to_numpy(float))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "sub": pdf["sub"].iloc[:1], "tree": [pickle.dumps(tree)]})

    trees = written(blocked.groupBy("cell", "sub").applyInPandas(build, "cell int, sub int, tree binary"),
                    name + "-trees")
    block = F.struct("cell", "sub")
    a = trees.select(block.alias("a"), "cell")
    pairs = (a.join(meeting, "cell").select("a", F.col("cell2").alias("cell"))
             .join(trees.select("cell", block.alias("b")), "cell").where("a <= b").select("a", "b"))
    pairs = written(pairs, name + "-blocks")
    # pairs of blocks are few and heavy: many partitions, so that hardly any has two
    parts = min(4 * pairs.count(), max(MOST_PARTS, shuffle_partitions(spark)))
    left = trees.select(block.alias("a"), "tree").join(pairs, "a").select("a", "b", "tree").repartition(parts, "a", "b")
    right = trees.select(block.alias("b"), "tree").join(pairs.where("a < b"), "b").select(
        *[F.col(c).alias(c) for c in ("a", "b", "tree")]).repartition(parts, "a", "b")  # columns of their own for the cogroup

    def match(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        first = pickle.loads(l["tree"].iloc[0])
        second = pickle.loads(r["tree"].iloc[0]) if len(r) else first
        got, got2, edges = links(first, second, limit, not len(r))
        ids = np.concatenate([first.ids, second.ids]) if len(r) else first.ids
        count = np.concatenate([got, got2])
        hit = np.flatnonzero(count > 0)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        root = ids[order][stars(place[edges], len(ids))[place]] if len(edges) else ids
        return pd.DataFrame({"id": ids[hit], "links": count[hit].astype("i8"), "root": root[hit]})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(
        match, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors (vec_id, embedding)``.

    Rows link when the cosine of their vectors is at least ``limit``; equal vectors always do, vectors
    of different lengths never.  Unusable vectors link with nothing.  A row without an id takes no
    part: its component is null and it is not kept.  Repeated rows are rows of their own that link.
    """
    rows = written(typed(vectors).withColumn("usable", usable() & F.col("vec_id").isNotNull()), "cover-rows")
    good = rows.where("usable")
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("m")),
                      "cover-classes")
    sizes = [r[0] for r in classes.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect()]
    found = None
    for size in sizes:
        one = _pairs(classes.where(F.size("embedding") == size).select("class_id", "embedding", "m"),
                     limit, block_rows, f"cover-{size}")
        found = one if found is None else found.unionByName(one)
    if found is None:
        info = classes.select("embedding", "class_id", "m", F.lit(0).cast("long").alias("links"),
                              F.col("class_id").alias("component"))
    else:
        found = written(found, "cover-links")
        count = found.groupBy("id").agg(F.sum("links").alias("links"))
        joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "cover-components")
        info = (classes.join(count, F.col("class_id") == F.col("id"), "left").drop("id")
                .join(joined, F.col("class_id") == F.col("id"), "left").drop("id")
                .select("embedding", "class_id", "m", F.coalesce("links", F.lit(0)).cast("long").alias("links"),
                        F.coalesce("component", "class_id").alias("component")))
    linked = good.join(info, "embedding").select(
        "vec_id", (F.col("m") - 1 + F.col("links")).cast("long").alias("n_links"),
        F.col("component").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
