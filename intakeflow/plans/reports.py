"""Reporting queries over the ledger (current view), quality log and audit log.

Every report is computed for all tasks at once with one grouped aggregate
(partial + final), instead of one query per task.  Paged / top-N reports end
with a TakeOrderedAndProject (per-partition top-k, then a merge of k rows per
partition), never a global sort of the whole table.  ``as_of`` replaces NOW().
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intakeflow.functions.columns import avg_half_up, display_time, ts_lit
from intakeflow.spec import (AUDIT_EXPORT_LIMIT, ERROR_TEXT_CHARS, PENDING_STATES, RECENT_FILES,
                             REGISTRY_LIMIT, STATS_DAYS, TREND_DAYS, clamp_days, page_args)


def _is(status: str) -> Column:
    return F.col("status") == status


def _avg_success_ms() -> Column:
    avg = avg_half_up(F.when(_is("SUCCESS"), F.col("processing_time_ms")), 0, 0)
    return F.coalesce(avg.cast("bigint"), F.lit(0).cast("bigint"))


def _since(col: str, as_of: _dt.datetime, days: int) -> Column:
    return F.col(col) >= ts_lit(as_of) - F.make_dt_interval(F.lit(days))


# ---------------------------------------------------------------------------
# A1-A5, A13
# ---------------------------------------------------------------------------
def task_stats(pf: DataFrame) -> DataFrame:
    """A1: per task totals by status, average success time, rows, last processed (NULL -> 0)."""
    return pf.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is("SUCCESS")).alias("success"),
        F.count_if(_is("FAILED")).alias("failed"),
        F.count_if(F.col("status").isin(*PENDING_STATES)).alias("pending"),
        F.count_if(_is("SKIPPED")).alias("skipped"),
        _avg_success_ms().alias("avg_processing_ms"),
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.max("processed_at").alias("last_processed"))


def daily_stats(pf: DataFrame, as_of: _dt.datetime, days=STATS_DAYS[0]) -> DataFrame:
    """Per task and created day over the last ``days`` (clamped 1..90)."""
    n = clamp_days(days, STATS_DAYS)
    return pf.filter(_since("created_at", as_of, n)).groupBy(
        "task_id", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is("SUCCESS")).alias("success"),
        F.count_if(_is("FAILED")).alias("failed"),
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("rows_processed"),
        _avg_success_ms().alias("avg_ms"))


def status_summary(pf: DataFrame) -> DataFrame:
    """A3: files and rows per status, plus total rows of SUCCESS files on every row."""
    g = pf.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"),
                                 F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("row_sum"))
    # g has one row per status value (at most six); the window is over that tiny result.
    total = F.sum(F.when(F.col("status") == "SUCCESS", F.col("row_sum")).otherwise(0)).over(
        Window.partitionBy())
    return g.withColumn("total_success_rows", F.coalesce(total, F.lit(0)).cast("bigint"))


def dashboard_kpi(pf: DataFrame) -> DataFrame:
    """A4 (G6): total, success, failed, pending (= PENDING + CLAIMED + PROCESSING); SKIPPED only in total."""
    return pf.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is("SUCCESS")).alias("success"),
        F.count_if(_is("FAILED")).alias("failed"),
        F.count_if(F.col("status").isin(*PENDING_STATES)).alias("pending"),
        F.coalesce(F.sum(F.when(_is("SUCCESS"), F.col("row_count"))), F.lit(0)).cast("bigint")
        .alias("total_success_rows"))


def filter_files(pf: DataFrame, status: str | None = None, task_id: str | None = None) -> DataFrame:
    """Optional equality filters, ANDed."""
    if status:
        pf = pf.filter(F.col("status") == status)
    if task_id:
        pf = pf.filter(F.col("task_id") == task_id)
    return pf


def page(df: DataFrame, order: Sequence[Column], page_no=1, size=None) -> DataFrame:
    """O1: ``ORDER BY ... LIMIT size OFFSET (page-1)*size`` with clamped arguments."""
    p, s = page_args(page_no, size)
    return df.orderBy(*order).offset((p - 1) * s).limit(s) if p > 1 else df.orderBy(*order).limit(s)


FILE_LIST_COLS = ("id", "task_id", "file_name", "file_path", "status", "row_count", "valid_row_count",
                  "retry_count", "error_type", "claim_expires_at", "processing_time_ms",
                  "created_at", "processed_at")


def file_page(pf: DataFrame, status=None, task_id=None, page_no=1, size=None) -> DataFrame:
    """O1 + P4: newest files first (id breaks ties)."""
    return page(filter_files(pf, status, task_id).select(*FILE_LIST_COLS),
                [F.desc("created_at"), F.desc("id")], page_no, size)


def file_count(pf: DataFrame, status=None, task_id=None, size=None) -> DataFrame:
    """A5: total rows under the filters and page count ``max(1, ceil(total/size))``."""
    _, s = page_args(1, size)
    c = filter_files(pf, status, task_id).agg(F.count(F.lit(1)).alias("total"))
    return c.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(s))).cast("bigint"))


def render_file_rows(pf: DataFrame, full: bool = False) -> DataFrame:
    """P10: each row as JSON; NULL fields dropped unless ``full``; the path only in the full view."""
    cols = [c for c in FILE_LIST_COLS if full or c != "file_path"]
    if full:
        cols += [c for c in ("error_message", "archive_path", "file_hash") if c in pf.columns]
    # timestamps as the reference prints them: str(datetime) -> 'YYYY-MM-DD HH:MM:SS'
    opts = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}
    if full:
        opts["ignoreNullFields"] = "false"
    return pf.select("id", F.to_json(F.struct(*cols), opts).alias("json"))


def get_file(pf: DataFrame, file_id: int) -> DataFrame:
    """Point lookup by id (full columns)."""
    return pf.filter(F.col("id") == file_id)


def recent_files(pf: DataFrame, n: int = RECENT_FILES) -> DataFrame:
    """O2 + P9: the n most recent files with display time ``processed_at or created_at``."""
    return pf.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select(
        "id", "file_name", "task_id", "status", "row_count", "processing_time_ms",
        display_time(F.col("processed_at"), F.col("created_at")).alias("time"))


def latest_errors(pf: DataFrame, task_id: str, n: int = 10) -> DataFrame:
    """Latest n ledger rows of a task, error text cut to 300 characters."""
    return pf.filter(F.col("task_id") == task_id).orderBy(F.desc("created_at"), F.desc("id")).limit(n) \
        .select("id", "file_name", "status", "error_type",
                F.substring("error_message", 1, ERROR_TEXT_CHARS).alias("error_message"), "created_at")


def status_distribution(pf: DataFrame, task_id: str) -> DataFrame:
    """Count by status for one task."""
    return pf.filter(F.col("task_id") == task_id).groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


# ---------------------------------------------------------------------------
# Quality log: A8, W1, O4
# ---------------------------------------------------------------------------
def latest_reports(dq: DataFrame) -> DataFrame:
    """The latest quality row per file (a replayed batch appends its rows again)."""
    return latest_per(dq, "file_id", [c for c in ("batch_time", "batch_id") if c in dq.columns])


def quality_trend(dq: DataFrame, as_of: _dt.datetime, days=TREND_DAYS[0]) -> DataFrame:
    """Per task and day: batches, avg / min score (2 places), rows and error rows.

    ``dq`` holds one row per file (``latest_reports`` of an append-only log)."""
    n = clamp_days(days, TREND_DAYS)
    return dq.filter(_since("batch_time", as_of, n)).groupBy(
        "task_id", F.to_date("batch_time").alias("day")).agg(
        F.count(F.lit(1)).alias("batch_count"),
        avg_half_up(F.col("quality_score"), 2, 2).alias("avg_score"),
        F.round(F.min("quality_score"), 2).alias("min_score"),
        F.sum("total_rows").cast("bigint").alias("total_rows"),
        F.sum("error_rows").cast("bigint").alias("error_rows"))


def latest_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The latest row per key for all keys at once (``max_by``, combined map-side; no window)."""
    cols = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return got.select(key, *[F.col("_r").getField(c).alias(c) for c in cols])


def quality_page(dq: DataFrame, task_id: str, page_no=1, size=None) -> DataFrame:
    """A task's quality reports, newest first."""
    return page(dq.filter(F.col("task_id") == task_id), [F.desc("batch_time"), F.desc("file_id")],
                page_no, size)


# ---------------------------------------------------------------------------
# Audit log: P5, P6, O5, K5
# ---------------------------------------------------------------------------
def filter_audit(audit: DataFrame, username: str | None = None, action: str | None = None,
                 start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Username equality and literal, case-insensitive ``action`` substring
    (UTF8_LCASE collation, G8); ``timestamp >= start`` and ``<= end 23:59:59``."""
    if username:
        audit = audit.filter(F.col("username") == username.strip())
    if action:
        audit = audit.filter(F.collate(F.col("action"), "UTF8_LCASE").contains(F.lit(action.strip())))
    if start_date:
        audit = audit.filter(F.col("timestamp") >= F.to_timestamp(F.lit(start_date.strip())))
    if end_date:
        audit = audit.filter(F.col("timestamp") <= F.to_timestamp(F.lit(end_date.strip() + " 23:59:59")))
    return audit


def audit_page(audit: DataFrame, page_no=1, size=None, **filters) -> DataFrame:
    """O5."""
    return page(filter_audit(audit, **filters), [F.desc("timestamp"), F.desc("id")], page_no, size)


def audit_export(audit: DataFrame, username: str | None = None, action: str | None = None) -> DataFrame:
    """K5: 5 columns, newest first, at most 10000 rows; date filters are not applied (as in the reference)."""
    return filter_audit(audit, username, action).orderBy(F.desc("timestamp"), F.desc("id")) \
        .limit(AUDIT_EXPORT_LIMIT).select("timestamp", "username", "user_ip", "action", "target")


def write_csv(df: DataFrame, path: str) -> None:
    """K4/K5: CSV with a header in column order.  For bounded results (exports, previews)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# ---------------------------------------------------------------------------
# rollups
# ---------------------------------------------------------------------------
def daily_rollup(pf: DataFrame, dq: DataFrame) -> DataFrame:
    """A10 (J4): per (task, day): files by status, rows, valid rows, avg quality, avg time.

    Of several quality rows of a file the latest counts, so re-runs count a file once."""
    q = latest_reports(dq).select(F.col("file_id").alias("id"), "quality_score")
    j = pf.join(q, "id", "left")
    return j.groupBy("task_id", F.to_date("created_at").alias("stat_date")).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(_is("SUCCESS")).alias("success_files"),
        F.count_if(_is("FAILED")).alias("failed_files"),
        F.count_if(_is("SKIPPED")).alias("skipped_files"),
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum("valid_row_count"), F.lit(0)).cast("bigint").alias("valid_rows"),
        avg_half_up(F.col("quality_score"), 2, 2).alias("avg_quality_score"),
        avg_half_up(F.col("processing_time_ms"), 0, 2).alias("avg_processing_ms"))


def write_daily_rollup(rollup: DataFrame, path: str) -> None:
    """A10 (materialised): write per-day rows partitioned by ``stat_date``; the days present in
    ``rollup`` replace their partitions (dynamic overwrite), all other days are kept."""
    (rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("stat_date").parquet(path))


def metrics_rollup(pf: DataFrame) -> DataFrame:
    """Counter metrics in long form (metric, task_id, label, value).

    One aggregate reduces the ledger to (task, status, error_type) cells; the
    metric rows are re-aggregations of that small result.
    """
    cells = pf.groupBy("task_id", "status", "error_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(_is("SUCCESS"), F.col("row_count"))).alias("rows_ok"),
        F.sum(F.when(_is("SUCCESS"), F.col("row_count") - F.col("valid_row_count"))).alias("rows_bad"))
    files = cells.groupBy("task_id", "status").agg(F.sum("n").alias("value")).select(
        F.lit("files_total").alias("metric"), "task_id", F.col("status").alias("label"), "value")
    rows_ok = cells.groupBy("task_id").agg(F.sum("rows_ok").alias("value")).select(
        F.lit("rows_processed").alias("metric"), "task_id", F.lit("").alias("label"), "value")
    rows_bad = cells.groupBy("task_id").agg(F.sum("rows_bad").alias("value")).select(
        F.lit("rows_failed").alias("metric"), "task_id", F.lit("").alias("label"), "value")
    errors = cells.filter(F.col("error_type").isNotNull()).groupBy("task_id", "error_type").agg(
        F.sum("n").alias("value")).select(F.lit("errors_total").alias("metric"), "task_id",
                                          F.col("error_type").alias("label"), "value")
    out = files.unionByName(rows_ok).unionByName(rows_bad).unionByName(errors)
    return out.withColumn("value", F.coalesce(F.col("value"), F.lit(0)).cast("bigint"))


# ---------------------------------------------------------------------------
# O3: registry listing
# ---------------------------------------------------------------------------
def registry_listing(registry: DataFrame, task_id: str | None = None) -> DataFrame:
    """O3: newest months first, at most 200, optional task filter."""
    if task_id:
        registry = registry.filter(F.col("task_id") == task_id)
    return registry.orderBy(F.desc("year_month"), F.desc("task_id")).limit(REGISTRY_LIMIT)
