"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

The unit is a group of equal texts.  Groups larger than ``1 / (shards * fine)`` of all bytes
are at most ``shards * fine`` by arithmetic and are packed one by one; smaller groups are hashed
into a fixed number of bundles of graded widths and packed as bundles.  So the packing loop sees
at most ``shards * fine + BUNDLES`` vectors at any input size.  It takes them from the largest
down and puts each into the shard where the dot product of its vector with the shard's residual
capacity is highest; a second pass moves items from the fullest to the emptiest shard while that
brings their byte counts closer and the largest share of any shard, over bytes, tokens and rows,
does not grow.  A group that alone exceeds a shard's even share is split into parts
of a share of it, as no placement could be even otherwise.

Law: ``bytes`` (shard sizes near equal).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intakeflow.llm.common import written

SHARDS = 40
FINE = 200        # groups above 1 / (SHARDS * FINE) of all bytes are placed one by one
WIDE, THIN = 3000, 3000  # bundles for the rest: thin ones are a thirtieth as wide
SPLIT = 8         # an oversized group is cut into parts of 1 / SPLIT of a shard's even share
CELL_ROWS = 50_000  # rows numbered in one task
OVERHEAD = 16     # bytes counted for every row besides its text


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, tokens, text_crc32 and group key of every row; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("g"))


def place(items: np.ndarray, shards: int, totals: np.ndarray) -> np.ndarray:
    """Shard of every item vector (bytes, tokens, rows): best dot product with residual capacity.

    ``items`` are taken in falling order of bytes (ties: as given); equal products go to the
    lower shard.  Capacities are even shares of ``totals``.
    """
    share = items / np.maximum(totals, 1)
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    to = np.empty(len(items), int)
    for i in np.argsort(-items[:, 0], kind="stable"):
        s = int(np.argmax(left @ share[i]))
        to[i] = s
        left[s] -= share[i]
    load = np.bincount(to, items[:, 0], shards)
    size = items[:, 0]
    held = np.stack([np.bincount(to, share[:, k], shards) for k in range(items.shape[1])], 1)
    for _ in range(40 * shards):
        hi, lo = int(np.argmax(load)), int(np.argmin(load))
        gap = load[hi] - load[lo]
        mine = np.flatnonzero((to == hi) & (size < gap) & (size > 0))
        mine = mine[(held[lo] + share[mine]).max(1) <= held.max()]  # no measure's largest share grows past it
        if not len(mine):
            break
        i = mine[np.argmin(np.abs(size[mine] - gap / 2))]
        to[i] = lo
        load[hi] -= size[i]
        load[lo] += size[i]
        held[hi] -= share[i]
        held[lo] += share[i]
    return to


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) for every row of ``docs``.

    Slots are gapless per shard; rows are numbered within hashed cells and the cells' counts give
    the offsets, so no shard is numbered in one task.  Rows that are equal in every respect get
    different slots.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    # rows that are equal in every respect are told apart by a number that is written with them
    rows = written(measured(docs).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    totals = np.array([total[0] or 0, total[1] or 0, total[2]], float)
    large = max(1.0, totals[0] / (shards * fine))
    even = max(1.0, totals[0] / shards)
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    groups = written(rows.groupBy("g").agg(*sums), "shard-groups")
    # a bundle's number comes from the group's key; the upper numbers are the thin ones
    h = F.pmod(F.xxhash64("g"), F.lit(WIDE * 30 + THIN))
    bundle = F.when(h < WIDE * 30, F.floor(h / 30)).otherwise(h - WIDE * 30 + WIDE).cast("long")
    big = [(r.g, r.b, r.t, r.r) for r in groups.where(F.col("b") >= large).orderBy("g").collect()]
    parts = {g: max(1, round(b * SPLIT / even)) for g, b, _, _ in big if b > even}
    split = spark.createDataFrame(list(parts.items()), "g string, n int")
    part = F.pmod(F.xxhash64("doc_id", "size", "row"), F.col("n")).cast("long")
    keys: list[tuple[str | None, int]] = [(g, 0) for g, *_ in big if g not in parts]
    items = [(b, t, r) for g, b, t, r in big if g not in parts]
    if parts:
        cut = (rows.join(F.broadcast(split), "g").withColumn("part", part).groupBy("g", "part").agg(*sums)
               .orderBy("g", "part").collect())
        keys += [(r.g, r.part) for r in cut]
        items += [(r.b, r.t, r.r) for r in cut]
    rest = groups.where(F.col("b") < large).groupBy(bundle.alias("bundle")).agg(
        F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).orderBy("bundle").collect()
    keys += [(None, r.bundle) for r in rest]
    items += [(r.b, r.t, r.r) for r in rest]
    to = place(np.array(items, float).reshape(-1, 3), shards, totals) if items else []
    placed = [(g, k, int(s)) for (g, k), s in zip(keys, to)]
    alone = spark.createDataFrame([x for x in placed if x[0] is not None], "g string, part long, shard int")
    bundles = spark.createDataFrame([x[1:] for x in placed if x[0] is None], "bundle long, in_bundle int")
    cells = max(1, round(totals[2] / CELL_ROWS))
    out = (rows.join(F.broadcast(split), "g", "left")
           .withColumn("part", F.coalesce(part, F.lit(0).cast("long")))
           .withColumn("bundle", bundle)
           .join(F.broadcast(alone), ["g", "part"], "left").join(F.broadcast(bundles), "bundle", "left")
           .select("doc_id", "size", "text_crc32", F.coalesce("shard", "in_bundle").alias("shard"),
                   F.pmod(F.xxhash64("doc_id", "g", "row"), F.lit(cells)).alias("cell")))
    out = written(out, "shard-placed")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = out.groupBy("shard", "cell").count().select(
        "shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("at"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (out.withColumn("n", F.row_number().over(inside)).join(start, ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("at") + F.col("n") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
