"""Ordered scans per key that stay balanced when one key is huge.

A window ``partitionBy(key).orderBy(t)`` sends every row of a key to one task;
a task (or path) holding a third of all rows would become one straggler.
Instead:

1. ``chunked``: range-partition on (key, order) - Spark samples the bounds, so
   a hot key is split over many partitions - and pin each row's partition id
   as ``_chunk`` with a reliable checkpoint (ids stay fixed if tasks re-run).
2. Windows run per (chunk, key): each bounded by the chunk size.
3. What crosses a chunk boundary (previous row, rows since the last marker,
   last marker value) comes from one small summary row per (key, chunk),
   scanned with a window per key over at most ``n_chunks`` rows, and joined
   back on (key, chunk).

The primitives below give rows-since-last-marker (gaps and islands) and, in
one pass, that plus the previous row; the stability and debounce scans carry
their own state (first/last signature, latest session start) the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intakeflow.session import ensure_checkpoint_dir
from intakeflow.spec import BREAKER_FAILURE_THRESHOLD, BREAKER_RECOVERY_SECONDS

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], n_chunks: int | None = None) -> DataFrame:
    """Rows range-partitioned on (keys, order) with a fixed ``_chunk`` id (reliable checkpoint)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_chunks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]])
    return ranged.withColumn(CHUNK, F.spark_partition_id()).checkpoint(eager=True)


def _local(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(CHUNK, *keys).orderBy(*order)


def _across(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK)


def with_rows_since_marker(ch: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column,
                           name: str = "_since") -> DataFrame:
    """Add ``name`` = i - m, where m is the position of the last marker row strictly before row i
    in the key (0 when there is none; positions start at 1)."""
    w = _local(keys, order)
    with_rn = ch.withColumn("_mk", marker).withColumn("_rn", F.row_number().over(w))
    local_m = F.max(F.when(F.col("_mk"), F.col("_rn"))).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    with_rn = with_rn.withColumn("_lm", local_m)
    summ = with_rn.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.max(F.when(F.col("_mk"), F.col("_rn"))).alias("_last_mk"))
    a = _across(keys)
    cum = F.sum("_cnt").over(a.rowsBetween(Window.unboundedPreceding, 0))
    summ = summ.withColumn("_cum", cum).withColumn(
        "_trail", F.when(F.col("_last_mk").isNotNull(), F.col("_cnt") - F.col("_last_mk")))
    prior = F.last(F.when(F.col("_last_mk").isNotNull(), F.struct("_cum", "_trail")), ignorenulls=True) \
        .over(a.rowsBetween(Window.unboundedPreceding, -1))
    summ = summ.withColumn("_pm", prior)
    carry = F.when(F.col("_pm").isNull(), F.col("_cum") - F.col("_cnt")).otherwise(
        F.col("_pm._trail") + (F.col("_cum") - F.col("_cnt") - F.col("_pm._cum")))
    summ = summ.select(*keys, CHUNK, carry.alias("_carry"))
    j = with_rn.join(summ, [*keys, CHUNK], "left")
    since = F.when(F.col("_lm").isNotNull(), F.col("_rn") - F.col("_lm")).otherwise(F.col("_rn") + F.col("_carry"))
    return j.withColumn(name, since.cast("long")).drop("_mk", "_rn", "_lm", "_carry")


def with_previous_and_since(ch: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                            marker: Column, prev: str = "_prev", since: str = "_since") -> DataFrame:
    """``with_previous`` and ``with_rows_since_marker`` in one pass (the marker must not depend
    on the previous row): one summary aggregate, one window over summaries, one join."""
    w = _local(keys, order)
    packed = F.struct(*[F.col(c) for c in cols])
    loc = (ch.withColumn("_mk", marker).withColumn("_rn", F.row_number().over(w))
           .withColumn(prev, F.lag(packed).over(w))
           .withColumn("_lm", F.max(F.when(F.col("_mk"), F.col("_rn"))).over(
               w.rowsBetween(Window.unboundedPreceding, -1))))
    summ = loc.groupBy(*keys, CHUNK).agg(
        F.max_by(packed, F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("_cnt"),
        F.max(F.when(F.col("_mk"), F.col("_rn"))).alias("_last_mk"))
    a = _across(keys)
    summ = (summ.withColumn("_cum", F.sum("_cnt").over(a.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_trail", F.when(F.col("_last_mk").isNotNull(), F.col("_cnt") - F.col("_last_mk"))))
    prior = F.last(F.when(F.col("_last_mk").isNotNull(), F.struct("_cum", "_trail")), ignorenulls=True) \
        .over(a.rowsBetween(Window.unboundedPreceding, -1))
    summ = summ.withColumn("_pm", prior)
    carry = F.when(F.col("_pm").isNull(), F.col("_cum") - F.col("_cnt")).otherwise(
        F.col("_pm._trail") + (F.col("_cum") - F.col("_cnt") - F.col("_pm._cum")))
    summ = summ.select(*keys, CHUNK, F.lag("_last").over(a).alias("_carry_prev"), carry.alias("_carry"))
    j = loc.join(summ, [*keys, CHUNK], "left")
    n = F.when(F.col("_lm").isNotNull(), F.col("_rn") - F.col("_lm")).otherwise(F.col("_rn") + F.col("_carry"))
    return (j.withColumn(prev, F.coalesce(F.col(prev), F.col("_carry_prev")))
            .withColumn(since, n.cast("long"))
            .drop("_mk", "_rn", "_lm", "_carry", "_carry_prev"))


# ---------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------
def failure_streaks(outcomes: DataFrame, key: str = "task_id", order: Sequence[str] = ("ts", "id"),
                    threshold: int = BREAKER_FAILURE_THRESHOLD, n_chunks: int | None = None) -> DataFrame:
    """Consecutive FAILED outcomes per task, reset by SUCCESS.

    ``consecutive_failures`` is the count after the row (0 after a success);
    ``tripped`` marks rows where it reaches ``threshold``.
    """
    ch = chunked(outcomes, [key], order, n_chunks)
    s = with_rows_since_marker(ch, [key], order, F.col("outcome") == "SUCCESS")
    run = F.when(F.col("outcome") == "FAILED", F.col("_since")).otherwise(F.lit(0)).cast("long")
    return s.select(*outcomes.columns, run.alias("consecutive_failures"),
                    (run >= threshold).alias("tripped"))


def breaker_replay(outcomes: DataFrame, key: str = "task_id", order: Sequence[str] = ("ts", "id"),
                   threshold: int = BREAKER_FAILURE_THRESHOLD, timeout_s: int = BREAKER_RECOVERY_SECONDS,
                   n_chunks: int | None = None) -> DataFrame:
    """T9 as a scan: the breaker state before and after each outcome of a task.

    Rule per outcome at time t: an OPEN breaker whose last failure is more than
    ``timeout_s`` old becomes HALF_OPEN; SUCCESS closes it and zeroes the count;
    FAILED adds one and opens it when it was HALF_OPEN or the count reaches
    ``threshold`` (and re-stamps the opening time).  Because SUCCESS resets
    everything and every failure after the threshold re-stamps the time, the
    state before row i depends only on the failures since the last success
    (k) and the time of the previous row - a gaps-and-islands scan.
    """
    ch = chunked(outcomes, [key], order, n_chunks)
    s = with_previous_and_since(ch, [key], order, [order[0]], F.col("outcome") == "SUCCESS")
    k = (F.col("_since") - 1).cast("long")
    prev_t = F.col("_prev").getField(order[0])
    gap_s = F.timestamp_diff("MICROSECOND", prev_t, F.col(order[0]))
    before = F.when(k >= threshold, F.when(gap_s > timeout_s * 1_000_000, F.lit("HALF_OPEN"))
                    .otherwise(F.lit("OPEN"))).otherwise(F.lit("CLOSED"))
    after = F.when(F.col("outcome") == "SUCCESS", F.lit("CLOSED")).when(
        (before == "HALF_OPEN") | (k + 1 >= threshold), F.lit("OPEN")).otherwise(F.lit("CLOSED"))
    return s.select(*outcomes.columns, k.alias("failures_before"), before.alias("state_before"),
                    after.alias("state_after"))


def stability_runs(observations: DataFrame, signature: Sequence[str], key: str = "file_path",
                   order: Sequence[str] = ("ts", "id"), checks: int = 3,
                   n_chunks: int | None = None) -> DataFrame:
    """Run length of identical observations per path; the watcher fires when its
    counter reaches ``checks`` and then starts counting afresh.

    ``run_length`` is the raw run; ``stable_count`` the watcher's counter
    (1..checks); ``fire`` marks the observations that emit the file.  One summary row
    per (key, chunk) carries the first and last signature, so a chunk's first row
    knows whether it continues the previous chunk's run.
    """
    ch = chunked(observations, [key], order, n_chunks)
    w = _local([key], order)
    sig = F.struct(*[F.col(c) for c in signature])
    loc = (ch.withColumn("_sig", sig).withColumn("_lag", F.lag(sig).over(w))
           .withColumn("_rn", F.row_number().over(w)))
    first = F.col("_rn") == 1
    loc = loc.withColumn("_inner", ~first & ~F.col("_lag").eqNullSafe(F.col("_sig")))
    summ = loc.groupBy(key, CHUNK).agg(
        F.min_by("_sig", F.struct(*order)).alias("_fsig"), F.max_by("_sig", F.struct(*order)).alias("_lsig"),
        F.count(F.lit(1)).alias("_cnt"), F.max(F.when(F.col("_inner"), F.col("_rn"))).alias("_lin"))
    a = _across([key])
    prev_last = F.lag("_lsig").over(a)
    summ = summ.withColumn("_fc", prev_last.isNull() | ~prev_last.eqNullSafe(F.col("_fsig")))
    summ = summ.withColumn("_last_mk", F.coalesce(F.col("_lin"), F.when(F.col("_fc"), F.lit(1))))
    summ = (summ.withColumn("_cum", F.sum("_cnt").over(a.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_trail", F.when(F.col("_last_mk").isNotNull(), F.col("_cnt") - F.col("_last_mk"))))
    prior = F.last(F.when(F.col("_last_mk").isNotNull(), F.struct("_cum", "_trail")), ignorenulls=True) \
        .over(a.rowsBetween(Window.unboundedPreceding, -1))
    summ = summ.withColumn("_pm", prior)
    carry = F.when(F.col("_pm").isNull(), F.col("_cum") - F.col("_cnt")).otherwise(
        F.col("_pm._trail") + (F.col("_cum") - F.col("_cnt") - F.col("_pm._cum")))
    summ = summ.select(key, CHUNK, "_fc", carry.alias("_carry"))
    j = loc.join(summ, [key, CHUNK], "left")
    marker = F.col("_inner") | (first & F.col("_fc"))
    j = j.withColumn("_mk", marker)
    lm = F.max(F.when(F.col("_mk"), F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    since = F.when(lm.isNotNull(), F.col("_rn") - lm).otherwise(F.col("_rn") + F.col("_carry"))
    run = F.when(F.col("_mk"), F.lit(1)).otherwise(since + 1).cast("long")
    counter = ((run - 1) % checks + 1).cast("long")
    return j.select(*observations.columns, run.alias("run_length"), counter.alias("stable_count"),
                    (counter == checks).alias("fire"))


def debounce_sessions(events: DataFrame, gap_seconds: float, key: str = "file_path",
                      order: Sequence[str] = ("ts", "id"), n_chunks: int | None = None) -> DataFrame:
    """T4: events of one path closer than ``gap_seconds`` (inclusive) collapse into one
    session that fires ``gap_seconds`` after its last event.

    Output: one row per session (key, session_start, session_end, events, fire_at).
    One summary row per (key, chunk) carries both what crosses a chunk boundary - the
    previous event time and the latest session start - and the final grouping has a
    map-side partial step, so a hot path's sessions are reduced before the shuffle.
    """
    t = F.col(order[0])
    gap_us = int(gap_seconds * 1_000_000)
    ch = chunked(events, [key], order, n_chunks)
    w = _local([key], order)
    local = (ch.withColumn("_lag", F.lag(t).over(w))
             .withColumn("_first", F.row_number().over(w) == 1))
    # a row with an in-chunk predecessor starts a session when the gap exceeds the limit
    inner_start = ~F.col("_first") & (F.timestamp_diff("MICROSECOND", F.col("_lag"), t) > gap_us)
    local = local.withColumn("_inner", inner_start)
    summ = local.groupBy(key, CHUNK).agg(
        F.min_by(t, F.struct(*order)).alias("_f"), F.max_by(t, F.struct(*order)).alias("_l"),
        F.max(F.when(F.col("_inner"), t)).alias("_ls"))
    a = _across([key])
    prev_last = F.lag("_l").over(a)
    summ = summ.withColumn("_fs", prev_last.isNull() | (F.timestamp_diff("MICROSECOND", prev_last, F.col("_f")) > gap_us))
    summ = summ.withColumn("_cm", F.coalesce(F.col("_ls"), F.when(F.col("_fs"), F.col("_f"))))
    summ = summ.select(key, CHUNK, "_fs", F.last("_cm", ignorenulls=True).over(
        a.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    j = local.join(summ, [key, CHUNK], "left")
    starts = F.col("_inner") | (F.col("_first") & F.col("_fs"))
    run_start = F.max(F.when(starts, t)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = j.withColumn("_start", F.coalesce(run_start, F.col("_carry")))
    g = m.groupBy(key, F.col("_start").alias("session_start")).agg(
        F.max(t).alias("session_end"), F.count(F.lit(1)).alias("events"))
    return g.withColumn("fire_at", F.col("session_end") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(float(gap_seconds))))
