"""File ledger.

Storage is an append-only event table; the "current" row of a file is a fold
of its events.  Open-source Spark has no MERGE on parquet, and an event log
is also what makes replays and audits cheap.

Key: (task_id, file_path, file_mtime).  Event kinds:
  SNAPSHOT    baseline state imported from an existing ledger (carries status, retry_count, ...)
  CLAIMED     a worker took the file (owner, lease)
  PROCESSING  the owner started work
  SUCCESS     counts and time recorded
  FAILED      error type / message; retry_count + 1
  SKIPPED     reason
  RETRY       manual retry: status PENDING, counters and errors cleared (L3)
  DEAD_LETTER the file was diverted (K7); never claimable again until a RETRY
  ARCHIVED    archive path of a SUCCESS file

Stored, events are partitioned by task and by the day of the file's modification.  A claim reads the days of
the files it lists only (``file_slice``), so its cost follows the files at hand and not the history.  Files
whose outcome is still open, which a later run takes up again whatever it lists, are kept as a small set of
keys beside the log, a new version with every claim (``write_open``, before the claim's own events, so that no open
file is ever missing from it; the log says what has become of them).

Scale: the fold is two aggregates around one equi join on the key, with no
window over a key and no collect.  Events are joined with the reset markers of their
keys, which are one row per file; where that side is small enough to broadcast, the
second aggregate's partial step still runs before the shuffle.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.functions.columns import file_id, lease_expiry, ts_lit
from intakeflow.session import path_exists
from intakeflow.spec import CLAIM_LEASE_SECONDS, RETRY_BACKOFF_SECONDS

KEY = ("task_id", "file_path", "file_mtime")
STATUS_EVENTS = ("SNAPSHOT", "CLAIMED", "PROCESSING", "SUCCESS", "FAILED", "SKIPPED", "RETRY")
RESET_EVENTS = ("SNAPSHOT", "RETRY")

EVENT_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("file_path", T.StringType()),
    T.StructField("file_mtime", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()), T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("owner", T.StringType()),
    T.StructField("file_size", T.LongType()), T.StructField("file_hash", T.StringType()),
    T.StructField("retry_count", T.LongType()), T.StructField("row_count", T.LongType()),
    T.StructField("valid_row_count", T.LongType()), T.StructField("processing_time_ms", T.LongType()),
    T.StructField("error_type", T.StringType()), T.StructField("error_message", T.StringType()),
    T.StructField("archive_path", T.StringType()), T.StructField("claim_expires_at", T.TimestampNTZType()),
    T.StructField("processed_at", T.TimestampNTZType()),
])


def conform(events: DataFrame) -> DataFrame:
    """Give an event frame the full event schema (missing columns NULL)."""
    return events.select(*[
        (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in EVENT_SCHEMA.fields])


def snapshot_events(current: DataFrame, event_time: Column | None = None) -> DataFrame:
    """Baseline events from an existing current-state ledger (one SNAPSHOT per file)."""
    t = event_time if event_time is not None else F.col("created_at")
    cols = {c: F.col(c) for c in current.columns}
    return conform(current.select(
        *[cols[k] for k in KEY], F.lit("SNAPSHOT").alias("event"), t.alias("event_time"),
        F.lit(0).cast("long").alias("seq"),
        *[cols[c] for c in ("status", "retry_count", "row_count", "valid_row_count",
                            "processing_time_ms", "error_type", "error_message", "claim_expires_at",
                            "processed_at", "file_size", "file_hash")
          if c in cols],
    ))


DAY = "mtime_day"
DAY_MS = 86_400_000
OPEN_STATES = ("PENDING", "CLAIMED", "PROCESSING", "FAILED")


def _day(mtime: Column) -> Column:
    return F.coalesce(F.floor(mtime / DAY_MS), F.lit(-1)).cast("int")


def append_events(events: DataFrame, path: str) -> None:
    """Append events to a stored ledger."""
    (conform(events).withColumn(DAY, _day(F.col("file_mtime"))).write.mode("append")
     .partitionBy("task_id", DAY).parquet(path))


def _escaped(spark: SparkSession, value: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def file_slice(spark: SparkSession, path: str, task_id: str, days: Iterable[int]) -> DataFrame:
    """The events of a task's files that were modified on ``days``; other days' folders are not even listed."""
    folders = [f"{path}/task_id={_escaped(spark, task_id)}/{DAY}={int(d)}" for d in sorted(set(days))]
    folders = [f for f in folders if path_exists(spark, f)]
    if not folders:  # an empty relation that the optimizer sees through
        return conform(spark.sql("SELECT 1 AS none WHERE false"))
    stored = T.StructType([*EVENT_SCHEMA.fields, T.StructField(DAY, T.StringType())])
    return conform(spark.read.schema(stored).option("basePath", path).parquet(*folders))


def _open_versions(spark: SparkSession, path: str, task_id: str) -> list[int]:
    """Whole versions of a task's open keys, oldest first."""
    folder = f"{path.rstrip('/')}_open/task_id={_escaped(spark, task_id)}"
    if not path_exists(spark, folder):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and path_exists(spark, f"{folder}/{n}/_SUCCESS"))


def open_keys(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """The keys of all of a task's files whose outcome may be open (some may have ended since)."""
    versions = _open_versions(spark, path, task_id)
    schema = T.StructType([f for f in EVENT_SCHEMA.fields if f.name in KEY])
    if versions:
        return spark.read.schema(schema).parquet(f"{path.rstrip('/')}_open/task_id={_escaped(spark, task_id)}/v={versions[-1]}")
    whole = f"{path}/task_id={_escaped(spark, task_id)}"
    if not path_exists(spark, whole):
        return spark.createDataFrame([], schema)
    # a ledger without such a set: found once from all events
    stored = T.StructType([*EVENT_SCHEMA.fields, T.StructField(DAY, T.StringType())])
    events = spark.read.schema(stored).option("basePath", path).parquet(whole)
    return fold(events).filter(F.col("status").isin(*OPEN_STATES) & ~F.col("dead_lettered")).select(*KEY)


def write_open(keys: DataFrame, path: str, task_id: str) -> None:
    """A new version of a task's open keys; all but the two last versions are removed."""
    spark = keys.sparkSession
    versions = _open_versions(spark, path, task_id)
    folder = f"{path.rstrip('/')}_open/task_id={_escaped(spark, task_id)}"
    keys.select(*KEY).distinct().write.mode("overwrite").parquet(f"{folder}/v={versions[-1] + 1 if versions else 0}")
    jvm = spark.sparkContext._jvm
    for v in versions[:-1]:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def reopen(events: DataFrame, path: str, task_id: str) -> None:
    """L3 on a stored ledger: append a task's ``retry_events``, so that the next run takes these files up again."""
    events = events.filter(F.col("task_id") == task_id)
    write_open(open_keys(events.sparkSession, path, task_id).unionByName(events.select(*KEY)), path, task_id)
    append_events(events, path)


def _order() -> Column:
    return F.struct(F.col("event_time"), F.col("seq"))


def fold(events: DataFrame, lease_seconds: int = CLAIM_LEASE_SECONDS, failed_at: bool = False) -> DataFrame:
    """L2: current state per key from the event log (all keys at once); ``failed_at``: with the last failure's time."""
    ev = conform(events)
    o = _order()
    reset = ev.groupBy(*KEY).agg(
        F.max(F.when(F.col("event").isin(*RESET_EVENTS), o)).alias("_reset"))
    j = ev.join(reset, list(KEY), "left")
    after = F.col("_reset").isNull() | (o >= F.col("_reset"))

    def last(value: Column, cond: Column) -> Column:
        return F.max_by(value, F.when(cond, o))

    ev_is = lambda *names: F.col("event").isin(*names)
    status_ev = last(F.struct("event", "status"), ev_is(*STATUS_EVENTS))
    snap_retry = last(F.col("retry_count"), ev_is("SNAPSHOT") & (o == F.col("_reset")))
    agg = j.groupBy(*KEY).agg(
        status_ev.alias("_st"),
        F.min("event_time").alias("created_at"),
        (F.coalesce(snap_retry, F.lit(0)) + F.count_if(
            ev_is("FAILED") & (F.col("_reset").isNull() | (o > F.col("_reset"))))).alias("retry_count"),
        last(F.struct("row_count", "valid_row_count", "processing_time_ms"),
             ev_is("SUCCESS", "SNAPSHOT")).alias("_ok"),
        last(F.coalesce(F.col("processed_at"), F.col("event_time")),
             ev_is("SUCCESS") | (ev_is("SNAPSHOT") & F.col("processed_at").isNotNull())).alias("_ok_t"),
        last(F.struct("error_type", "error_message"), ev_is("FAILED", "SKIPPED", "SNAPSHOT") & after).alias("_err"),
        last(F.struct("owner", "event_time", "claim_expires_at", "event"),
             ev_is("CLAIMED", "SNAPSHOT") & after).alias("_claim"),
        last(F.col("archive_path"), ev_is("ARCHIVED")).alias("archive_path"),
        F.count_if(ev_is("DEAD_LETTER") & after).alias("_dead"),
        last(F.struct("file_size", "file_hash"), F.col("file_size").isNotNull()).alias("_id"),
        F.max(F.when(ev_is("FAILED"), F.col("event_time"))).alias("failed_at"),
    )
    st = F.col("_st.event")
    status = (F.when(st == "SNAPSHOT", F.col("_st.status")).when(st == "RETRY", F.lit("PENDING"))
              .otherwise(st))
    claim_exp = F.when(F.col("_claim.event") == "SNAPSHOT", F.col("_claim.claim_expires_at")) \
        .otherwise(lease_expiry(F.col("_claim.event_time"), lease_seconds))
    return agg.select(
        file_id(*KEY).alias("id"), *KEY, F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
        status.alias("status"), "retry_count",
        F.when(status.isin("FAILED", "SKIPPED"), F.col("_err.error_type")).alias("error_type"),
        F.when(status.isin("FAILED", "SKIPPED"), F.col("_err.error_message")).alias("error_message"),
        F.col("_ok.row_count").alias("row_count"), F.col("_ok.valid_row_count").alias("valid_row_count"),
        F.col("_ok.processing_time_ms").alias("processing_time_ms"),
        F.when(status.isin("CLAIMED", "PROCESSING"), F.col("_claim.owner")).alias("claimed_by"),
        F.when(status.isin("CLAIMED", "PROCESSING"), claim_exp).alias("claim_expires_at"),
        F.col("_ok_t").alias("processed_at"), "created_at", "archive_path",
        (F.col("_dead") > 0).alias("dead_lettered"),
        F.col("_id.file_size").alias("file_size"), F.col("_id.file_hash").alias("file_hash"),
        *(["failed_at"] if failed_at else []),
    )


# ---------------------------------------------------------------------------
# Claim rule on the pre-image
# ---------------------------------------------------------------------------
def claim_decisions(arrivals: DataFrame, current: DataFrame, as_of: _dt.datetime,
                    max_retries: int | Column = 3, extra: Sequence[str] = ()) -> DataFrame:
    """Decide, for each listed file, whether this run claims it (``extra``: columns of ``current`` to keep).

    CLAIM_NEW       no ledger row
    CLAIM_RETRY     FAILED with retry_count < max_retries and not dead-lettered
    CLAIM_PENDING   PENDING (after a manual retry; G3)
    CLAIM_EXPIRED   CLAIMED / PROCESSING whose lease ended before as_of
    HOLD            anything else (reason = current status)
    All conditions read the ledger as it was before this run (G2).
    """
    arrivals = arrivals.dropDuplicates(list(KEY))
    cur_cols = ["status", "retry_count", "claim_expires_at",
                *extra]
    cur = current.select(*KEY, *cur_cols,
                         (F.col("dead_lettered") if "dead_lettered" in current.columns
                          else F.lit(False)).alias("dead_lettered"))
    j = arrivals.join(cur, list(KEY), "left")
    mr = max_retries if isinstance(max_retries, Column) else F.lit(max_retries)
    s = F.col("status")
    decision = (F.when(s.isNull(), F.lit("CLAIM_NEW"))
                .when((s == "FAILED") & (F.col("retry_count") < mr) & ~F.coalesce(F.col("dead_lettered"), F.lit(False)),
                      F.lit("CLAIM_RETRY"))
                .when(s == "PENDING", F.lit("CLAIM_PENDING"))
                .when(s.isin("CLAIMED", "PROCESSING") & (F.col("claim_expires_at") < ts_lit(as_of)),
                      F.lit("CLAIM_EXPIRED"))
                .otherwise(F.lit("HOLD")))
    return j.withColumn("decision", decision).withColumnRenamed("status", "prior_status")


def claim_events(decisions: DataFrame, owner: str, as_of: _dt.datetime,
                 lease_seconds: int = CLAIM_LEASE_SECONDS) -> DataFrame:
    """CLAIMED events for the files this run claims."""
    got = decisions.filter(F.col("decision").startswith("CLAIM"))
    return conform(got.select(
        *KEY, F.lit("CLAIMED").alias("event"), ts_lit(as_of).alias("event_time"),
        F.lit(1).cast("long").alias("seq"), F.lit(owner).alias("owner"),
        *[c for c in ("file_size", "file_hash") if c in got.columns],
        lease_expiry(ts_lit(as_of), lease_seconds).alias("claim_expires_at")))


# ---------------------------------------------------------------------------
# Outcomes -> events
# ---------------------------------------------------------------------------
def retry_events(current: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """L3: manual retry of every FAILED file in ``current`` (filter first to retry a subset)."""
    return conform(current.filter(F.col("status") == "FAILED").select(
        *KEY, F.lit("RETRY").alias("event"), ts_lit(as_of).alias("event_time"),
        F.lit(2).cast("long").alias("seq")))


def classify_outcome(error_kind: Column) -> Column:
    """Skip -> SKIPPED; retryable -> RETRY; anything else -> FAILED (fatal)."""
    return (F.when(error_kind.isNull(), F.lit("SUCCESS"))
            .when(error_kind == "skip", F.lit("SKIPPED"))
            .when(error_kind == "retryable", F.lit("RETRY"))
            .otherwise(F.lit("FAILED")))


def dead_letter(current: DataFrame, max_retries: int | Column = 3,
                retryable_types: Sequence[str] = ("RetryableError",)) -> DataFrame:
    """FAILED files to divert: fatal errors at once, retryable ones at ``max_retries``."""
    mr = max_retries if isinstance(max_retries, Column) else F.lit(max_retries)
    failed = current.filter(F.col("status") == "FAILED")
    fatal = ~F.coalesce(F.col("error_type").isin(*retryable_types), F.lit(False))
    reason = F.when(fatal, F.lit("fatal")).when(F.col("retry_count") >= mr, F.lit("retries_exhausted"))
    return failed.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def dead_letter_events(dead: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """K7: DEAD_LETTER events for the rows of ``dead_letter`` (reason kept as the message)."""
    return conform(dead.select(
        *KEY, F.lit("DEAD_LETTER").alias("event"), ts_lit(as_of).alias("event_time"),
        F.lit(3).cast("long").alias("seq"), F.col("reason").alias("error_message")))


def write_quarantine(dead: DataFrame, path: str) -> None:
    """K7: append the diverted files' identity and reason to the quarantine dataset."""
    dead.select(*KEY, "file_name", "retry_count", "error_type", "error_message", "reason") \
        .write.mode("append").parquet(path)


def backoff_delay(retry_count: Column, backoff: Sequence[int] = RETRY_BACKOFF_SECONDS) -> Column:
    """Seconds to wait after the n-th failure (last value repeats)."""
    arr = F.array(*[F.lit(int(b)) for b in backoff])
    idx = F.least(F.greatest(retry_count, F.lit(1)), F.lit(len(backoff))).cast("int")
    return F.element_at(arr, idx)


def worklist(decisions: DataFrame, tasks: DataFrame, as_of: _dt.datetime,
             last_failure: Column | None = None,
             backoff: Sequence[int] = RETRY_BACKOFF_SECONDS) -> DataFrame:
    """Claimable files with their task priority, due now, ordered by
    (priority, file_mtime, file_path).

    ``tasks`` is the configured task table (one row per task).
    """
    got = decisions.filter(F.col("decision").startswith("CLAIM"))
    if last_failure is not None:
        due = last_failure + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                backoff_delay(F.col("retry_count"), backoff))
        got = got.withColumn("next_attempt_at",
                             F.when(F.col("decision") == "CLAIM_RETRY", due)) \
            .filter(F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= ts_lit(as_of)))
    j = got.join(tasks.select("task_id", "priority"), "task_id", "inner")  # AQE picks the join
    return j.orderBy("priority", "file_mtime", "file_path")


def task_table(spark, priorities: Mapping[str, int]) -> DataFrame:
    """Task settings as a small DataFrame."""
    return spark.createDataFrame([(k, int(v)) for k, v in sorted(priorities.items())],
                                 "task_id string, priority int")


def listing_minus_done(listing: DataFrame, current: DataFrame) -> DataFrame:
    """Listed files whose key is not already SUCCESS."""
    done = current.filter(F.col("status") == "SUCCESS").select(*KEY)
    return listing.join(done, list(KEY), "left_anti")


def status_lookup(current: DataFrame, task_id: str, file_path: str, file_mtime: int | None = None) -> DataFrame:
    """L4: status and retry count of one file; without an mtime the newest version answers."""
    hit = current.filter((F.col("task_id") == task_id) & (F.col("file_path") == file_path))
    if file_mtime is not None:
        return hit.filter(F.col("file_mtime") == file_mtime).select(*KEY, "status", "retry_count")
    return hit.orderBy(F.desc("file_mtime")).limit(1).select(*KEY, "status", "retry_count")
