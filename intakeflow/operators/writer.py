"""First-wins idempotent writes (K2 = W2 + J1, P3).

Semantics: a month-partitioned target keeps, per (month, key), the first row
that ever arrived.  Uniqueness is scoped per month because each month is its
own table in the reference (its unique index is per table).  Rows with a NULL
key column are never duplicates of anything (a unique index ignores them).

Scale notes
  * W2 is ``groupBy(scope+keys).agg(min(struct(order..., rest...)))`` - an
    aggregate with a map-side partial step (sort-based, as the buffer holds
    strings), so a key holding a third of all rows is folded per map task
    before the shuffle (no window over a key, no straggler).
  * J1 reads only the key columns of the *touched* months: a semi join with the
    batch's months, of which a calendar has at most 120,000 (``YYYYMM``), prunes the
    target's partitions at run time; AQE decides whether the key side is small enough
    to broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.functions.columns import qcol
from intakeflow.operators.route import FALLBACK, MONTH
from intakeflow.session import Beside, ensure_checkpoint_dir, folder_size, path_exists, read_note, write_note

# Group key of rows that are duplicates of nothing (see ``first_per_key``).
ALONE = "__alone"
HASH = "__hash"
# Types, besides plain strings, whose equal values have equal hashes.
HASHED = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
# Rows of a batch up to which its key hashes are broadcast, and one task can write a whole month of it.
SMALL_BATCH = 1_000_000
# Contested keys up to which their hashes are broadcast (some 50 MB); with more of them all rows are compared.
MOST_CONTESTED = 1_000_000


def align_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a frame are NULL (first-seen order)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _null_key(keys: Sequence[str]):
    cond = F.lit(False)
    for k in keys:
        cond = cond | qcol(k).isNull()
    return cond


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Keep the first row of each key by ``order_cols`` (then the other columns).

    Rows with a NULL key part are all kept.
    """
    if not keys:
        return df
    cols = df.columns
    # Key columns are constant inside a group, so they are left out of the ordering.
    ordered = [c for c in order_cols if c not in keys]
    payload = ordered + [c for c in cols if c not in keys and c not in ordered]
    packed = F.struct(*[qcol(c).alias(c) for c in payload])
    # one pass: a row with a NULL key part gets a number of its own in the group key
    alone = F.when(_null_key(keys), F.monotonically_increasing_id())
    return (df.withColumn(ALONE, alone).groupBy(*[qcol(k) for k in keys], ALONE)
            .agg(F.min(packed).alias("_first"))
            .select(*[qcol(k) for k in keys], *[F.col("_first").getField(c).alias(c) for c in payload])
            .select(*[qcol(c) for c in cols]))


def plan_first_wins(new: DataFrame, existing: DataFrame | None, keys: Sequence[str],
                    order_cols: Sequence[str], scope: Sequence[str] = (MONTH,)) -> DataFrame:
    """K2: rows of ``new`` that a first-wins insert would store.

    ``existing`` is the target (only the scope+key columns are read).
    """
    full_key = list(scope) + [k for k in keys if k not in scope]
    if not keys:
        return new
    firsts = first_per_key(new, full_key, order_cols)
    if existing is None:
        return firsts
    existing_keys = existing.select(*[qcol(k) for k in full_key])
    # NULL-key rows never match in an equi anti join, so they pass - as in a unique index.
    return firsts.join(existing_keys, full_key, "left_anti").select(*[qcol(c) for c in new.columns])


def _key_hash(full_key: Sequence[str]):
    return F.xxhash64(*[qcol(c) for c in full_key]).alias(HASH)


def _types(df: DataFrame, full_key: Sequence[str]) -> list[T.DataType]:
    return [f.dataType for f in df.select(*[qcol(c) for c in full_key]).schema]


def key_index(spark: SparkSession, target_path: str, new: DataFrame | None,
              existing: DataFrame | Callable[[], DataFrame | None] | None, keys: Sequence[str]) -> str | None:
    """The folder of the target's keys and their hashes, few files for every batch, built from the target at first.

    It holds every (month, key) of the target, and may hold more (each batch's are written before its rows), so a key
    that it lacks is new.  None where equal keys may differ in their hashes (types or collations), or
    where the target is written to without it (``new`` None says so); such an index is not used again.
    ``existing`` is the target, or finds it where it is needed."""
    folder = target_path.rstrip("/") + "_keys"
    full_key = [MONTH] + [k for k in keys if k != MONTH]
    types = _types(new, full_key) if new is not None else []
    mark = hashlib.md5(repr([full_key, [t.simpleString() for t in types]]).encode()).hexdigest()
    there = path_exists(spark, folder)
    if there and path_exists(spark, f"{folder}/_stale"):
        return None
    if there and path_exists(spark, f"{folder}/_complete-{mark}"):
        return folder
    usable = new is not None and all(t == T.StringType() or isinstance(t, HASHED) for t in types)
    if callable(existing):
        existing = existing() if usable and not there else None
    if usable and existing is not None and types != _types(existing, full_key):
        usable = False
    if there or not usable:  # of other keys, or never completed
        if there:
            write_note(spark, f"{folder}/_stale", "")
        return None
    first = (new.limit(0) if existing is None else existing.where(~_null_key(keys)))
    first.select(_key_hash(full_key), *[qcol(c) for c in full_key]).write.mode("append").parquet(folder)
    write_note(spark, f"{folder}/_state", _state(spark, target_path))
    write_note(spark, f"{folder}/_complete-{mark}", "")
    return folder


def _state(spark: SparkSession, target_path: str) -> str:
    """What the target looks like from outside: its files and bytes."""
    return "files {} bytes {}".format(*folder_size(spark, target_path))


def contested_keys(new: DataFrame, index: str | DataFrame, keys: Sequence[str], n: int) -> tuple[DataFrame | None, int]:
    """The hashes (checkpointed) of the keys of ``new``, ``n`` rows, that another row of it or the target may hold too, and
    their number; None if there are none, or too many to be broadcast.  Only hashes are shuffled, and of the index none where the
    batch's hashes can be broadcast.  Keys that merely share a hash cost a comparison and change nothing."""
    full_key = [MONTH] + [k for k in keys if k != MONTH]
    hashes = new.where(~_null_key(keys)).select(_key_hash(full_key))
    stored = new.sparkSession.read.schema(f"{HASH} long").parquet(index) if isinstance(index, str) else index.select(HASH)
    mine = F.broadcast(hashes) if n <= SMALL_BATCH else hashes
    seen = stored.join(mine, HASH, "left_semi")
    found = (hashes.withColumn("n", F.lit(1)).unionByName(seen.withColumn("n", F.lit(2)))
             .groupBy(HASH).agg(F.sum("n").alias("n")).where("n > 1").select(HASH))
    # cut loose from the index, which is written next
    ensure_checkpoint_dir(new.sparkSession)
    found = found.checkpoint(eager=True)
    many = found.count()
    return (found if 0 < many <= MOST_CONTESTED else None), many


def uncontested_or_first(new: DataFrame, existing: DataFrame | None, keys: Sequence[str], order_cols: Sequence[str],
                         contested: DataFrame) -> DataFrame:
    """As ``plan_first_wins``: rows of a key that no other row has are stored as they are, the others are compared.
    ``existing`` may have its keys' hashes already."""
    full_key = [MONTH] + [k for k in keys if k != MONTH]
    rows = new.withColumn(HASH, F.when(~_null_key(keys), _key_hash(full_key)))
    some = F.broadcast(contested)
    alone = rows.join(some, HASH, "left_anti").drop(HASH)
    others = rows.join(some, HASH, "left_semi").drop(HASH)
    if existing is not None:
        if HASH not in existing.columns:
            existing = existing.withColumn(HASH, _key_hash(full_key))
        existing = existing.join(some, HASH, "left_semi").drop(HASH)
    return alone.unionByName(plan_first_wins(others, existing, keys, order_cols))


def read_target(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame | None:
    """Target table restricted to the given months (partition pruning); None if absent."""
    if not path_exists(spark, path):  # first write to this target
        return None
    try:
        df = spark.read.option("basePath", path).parquet(path)
    except Exception as exc:  # noqa: BLE001 - a folder without data files yet
        if "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise
    df = df.withColumn(MONTH, F.col(MONTH).cast("string"))
    if months is not None:
        df = df.filter(F.col(MONTH).isin(list(months)))
    return df


def write_first_wins(new: DataFrame, target_path: str, keys: Sequence[str],
                     order_cols: Sequence[str], archived_months: Sequence[str] = (),
                     quarantine_path: str | None = None,
                     finish: Callable[[DataFrame], DataFrame] | None = None, cached: bool = False,
                     once_cached: Callable[[], None] | None = None) -> dict:
    """K2 end to end: dedupe, anti-join against the target, append by month.

    ``new`` must carry ``month`` (see ``route_months``).  Returns counts
    ``received``, ``inserted``, ``ignored``, ``fallback_routed`` and
    ``rejected_archived``.  Replaying the same batch inserts 0 rows (T7).  Rows
    routed to an ARCHIVED month are not written to the target (L7): they are counted
    as rejected and appended to the dataset at ``quarantine_path`` (default: beside the
    target), never dropped.  ``finish`` reshapes the surviving rows
    just before they are stored (e.g. field encryption, which must not touch the keys).  ``cached`` says that ``new``
    reads a cached frame: it is gone through more than once then, and whole rows pass one shuffle only.
    ``once_cached`` is called when that frame has been read for the first time, and before anything is written.

    Counts stay exact when executors are lost: the input counts come from a
    per-month aggregate job (job results, one row per month - which also gives the
    months for pruning), and ``inserted`` from an observation in the write's result
    stage, whose task metrics are applied once per task.
    """
    spark = new.sparkSession
    fb = F.col(FALLBACK).cast("long") if FALLBACK in new.columns else F.lit(0).cast("long")
    archived = F.col(MONTH).isin(list(archived_months)) if archived_months else F.lit(False)
    quarantine_path = quarantine_path or target_path.rstrip("/") + "_quarantine"
    rows = new.groupBy(MONTH).agg(F.count(F.lit(1)).alias("n"), F.sum(fb).alias("fb"),
                                  F.count_if(archived).alias("rej")).collect()
    received, fallback, rej = (sum(int(r[c] or 0) for r in rows) for c in ("n", "fb", "rej"))
    body = new.drop(FALLBACK) if FALLBACK in new.columns else new
    if once_cached is not None:
        once_cached()
    if rej:
        (body.filter(archived).withColumn("quarantine_reason", F.lit("archived_month"))
         .write.mode("append").partitionBy(MONTH).parquet(quarantine_path))
    body = body.filter(~archived)

    def existing() -> DataFrame | None:
        """The target's keys of the months this batch touches; asked for where the key index does not do."""
        found = read_target(spark, target_path) if keys else None
        if found is None:
            return None
        months = spark.createDataFrame([(r[MONTH],) for r in rows if r["rej"] < r["n"]], f"{MONTH} string")
        return found.join(F.broadcast(months), MONTH, "left_semi").select(MONTH, *[qcol(k) for k in keys])

    # REBALANCE by month: AQE sizes the write tasks per month (few files per month partition,
    # a hot month split into several tasks) instead of every task writing into every month.
    obs_out = Observation("inserted")
    contested, many, sure = None, -1, False
    index = key_index(spark, target_path, body if cached else None, lambda: read_target(spark, target_path), keys) if keys else None
    if index is not None:
        # a target that looks as after the last batch holds just the index's keys; otherwise it is asked
        sure = read_note(spark, f"{index}/_state") == _state(spark, target_path)
        write_note(spark, f"{index}/_state", "a batch is written")
        full_key = [MONTH] + [k for k in keys if k != MONTH]
        mine = body.where(~_null_key(keys)).select(_key_hash(full_key), *[qcol(c) for c in full_key])
        indexed = spark.read.schema(mine.schema).parquet(index)  # listed before it is added to
        stored = indexed if sure else existing()
        adding = (mine.coalesce(1) if received <= SMALL_BATCH else mine).write.mode("append")
        added = Beside(lambda: adding.parquet(index))
        try:
            contested, many = contested_keys(body, indexed, keys, received - rej)
        finally:
            added.wait()
        added.result()  # the keys lie there before any row does
    if many == 0:
        to_insert = body
    elif contested is not None:
        to_insert = uncontested_or_first(body, stored, keys, order_cols, contested)
    else:
        to_insert = plan_first_wins(body, existing(), keys, order_cols)
    if finish is not None:
        to_insert = finish(to_insert)
    if received <= SMALL_BATCH:  # also a single month is little work for one task
        to_insert = to_insert.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)), MONTH)
    else:
        to_insert = to_insert.hint("rebalance", MONTH)
    to_insert = to_insert.observe(obs_out, F.count(F.lit(1)).alias("n"))
    to_insert.write.mode("append").partitionBy(MONTH).parquet(target_path)
    inserted = int(obs_out.get["n"])
    if sure:
        write_note(spark, f"{index}/_state", _state(spark, target_path))
    return {"received": received, "inserted": inserted, "ignored": received - inserted - rej,
            "fallback_routed": fallback, "rejected_archived": rej}
