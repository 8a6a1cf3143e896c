"""Driver queries: ledger / quality / audit reports."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from intakeflow.functions.columns import avg_half_up_sql
from intakeflow.plans import reports as R
from intakeflow.plans.catalog import AS_OF_ORDERS, register
from intakeflow.sources.fixtures import (AUDIT_SQL, DQ_SQL, PF_SQL, audit_rows, ledger_rows,
                                         quality_log_rows, with_cte)

# Report windows: the ledger fixture ends on 2001-08-01, so the day-window reports
# look back from the day after it.
AS_OF_STATS = _dt.datetime(2001, 8, 2, 0, 0, 0)
AS_OF_STATS_SQL = "TIMESTAMP '2001-08-02 00:00:00'"

_AVG_MS = ("coalesce(CAST(" + avg_half_up_sql("CASE WHEN status = 'SUCCESS' THEN processing_time_ms END", 0, 0)
           + " AS BIGINT), 0)")


@register("task_stats", oracle=with_cte(f"""
SELECT task_id, count(*) AS total,
       count(*) FILTER (WHERE status = 'SUCCESS') AS success,
       count(*) FILTER (WHERE status = 'FAILED') AS failed,
       count(*) FILTER (WHERE status IN ('PENDING', 'CLAIMED', 'PROCESSING')) AS pending,
       count(*) FILTER (WHERE status = 'SKIPPED') AS skipped,
       {_AVG_MS} AS avg_processing_ms,
       CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows,
       max(processed_at) AS last_processed
FROM pf GROUP BY task_id
""", pf=PF_SQL))
def task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: per-task file statistics for all tasks in one aggregate."""
    return R.task_stats(ledger_rows(spark, sf_dir))


@register("daily_stats", oracle=with_cte(f"""
SELECT task_id, CAST(created_at AS DATE) AS day, count(*) AS total,
       count(*) FILTER (WHERE status = 'SUCCESS') AS success,
       count(*) FILTER (WHERE status = 'FAILED') AS failed,
       CAST(coalesce(sum(row_count), 0) AS BIGINT) AS rows_processed,
       {_AVG_MS} AS avg_ms
FROM pf WHERE created_at >= {AS_OF_STATS_SQL} - INTERVAL 90 DAY
GROUP BY ALL
""", pf=PF_SQL))
def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task and day over the last 90 days (the clamp maximum)."""
    return R.daily_stats(ledger_rows(spark, sf_dir), AS_OF_STATS, days=365)


@register("status_summary", oracle=with_cte("""
SELECT status, count(*) AS cnt, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS row_sum,
       CAST((SELECT coalesce(sum(row_count), 0) FROM pf WHERE status = 'SUCCESS') AS BIGINT) AS total_success_rows
FROM pf GROUP BY status
""", pf=PF_SQL))
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: files and rows per status, with total rows of successful files."""
    return R.status_summary(ledger_rows(spark, sf_dir))


@register("dashboard_kpi", oracle=with_cte("""
SELECT count(*) AS total,
       count(*) FILTER (WHERE status = 'SUCCESS') AS success,
       count(*) FILTER (WHERE status = 'FAILED') AS failed,
       count(*) FILTER (WHERE status IN ('PENDING', 'CLAIMED', 'PROCESSING')) AS pending,
       CAST(coalesce(sum(row_count) FILTER (WHERE status = 'SUCCESS'), 0) AS BIGINT) AS total_success_rows
FROM pf
""", pf=PF_SQL))
def dashboard_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: dashboard file KPIs (pending = PENDING + CLAIMED + PROCESSING)."""
    return R.dashboard_kpi(ledger_rows(spark, sf_dir))


_FILE_COLS = ", ".join(R.FILE_LIST_COLS)


@register("file_page", oracle=with_cte(f"""
SELECT {_FILE_COLS} FROM pf WHERE status = 'SUCCESS' AND task_id = 'task_1'
ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100
""", pf=PF_SQL))
def file_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page (50 per page) of successful task_1 files, newest first."""
    return R.file_page(ledger_rows(spark, sf_dir), status="SUCCESS", task_id="task_1", page_no=3, size=50)


@register("file_page_count", oracle=with_cte("""
SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages
FROM pf WHERE status = 'SUCCESS' AND task_id = 'task_1'
""", pf=PF_SQL))
def file_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: total and page count for the same filters."""
    return R.file_count(ledger_rows(spark, sf_dir), status="SUCCESS", task_id="task_1", size=50)


@register("recent_files", oracle=with_cte("""
SELECT id, file_name, task_id, status, row_count, processing_time_ms,
       coalesce(processed_at, created_at) AS time
FROM pf ORDER BY created_at DESC, id DESC LIMIT 10
""", pf=PF_SQL))
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most recent files with display time."""
    return R.recent_files(ledger_rows(spark, sf_dir))


@register("latest_errors", oracle=with_cte("""
SELECT id, file_name, status, error_type, substr(error_message, 1, 300) AS error_message, created_at
FROM pf WHERE task_id = 'task_2' ORDER BY created_at DESC, id DESC LIMIT 20
""", pf=PF_SQL))
def latest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest 20 ledger rows of task_2 with error text cut to 300 characters."""
    return R.latest_errors(ledger_rows(spark, sf_dir), "task_2", 20)


@register("file_lookup", oracle=with_cte("SELECT * FROM pf WHERE id = 7", pf=PF_SQL))
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file by id with every column."""
    return R.get_file(ledger_rows(spark, sf_dir), 7)


@register("status_distribution", oracle=with_cte(
    "SELECT status, count(*) AS cnt FROM pf WHERE task_id = 'task_3' GROUP BY status", pf=PF_SQL))
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of one task."""
    return R.status_distribution(ledger_rows(spark, sf_dir), "task_3")


@register("quality_trend", oracle=with_cte(f"""
SELECT task_id, CAST(batch_time AS DATE) AS day, count(*) AS batch_count,
       {avg_half_up_sql("quality_score", 2, 2)} AS avg_score, round(min(quality_score), 2) AS min_score,
       CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(sum(error_rows) AS BIGINT) AS error_rows
FROM dq WHERE batch_time >= TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 90 DAY
GROUP BY ALL
""", dq=DQ_SQL))
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quality trend per task over the last 90 days."""
    return R.quality_trend(quality_log_rows(spark, sf_dir), AS_OF_ORDERS, days=90)


@register("quality_latest", oracle=with_cte("""
SELECT task_id, file_id, batch_time, total_rows, error_rows, quality_score FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY batch_time DESC, file_id DESC) AS rn FROM dq) t
WHERE rn = 1
""", dq=DQ_SQL))
def quality_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest quality report of every task (max_by, no per-task sort)."""
    return R.latest_per(quality_log_rows(spark, sf_dir), "task_id", ["batch_time", "file_id"])


@register("quality_page", oracle=with_cte("""
SELECT * FROM dq WHERE task_id = 'task_2' ORDER BY batch_time DESC, file_id DESC LIMIT 20 OFFSET 20
""", dq=DQ_SQL))
def quality_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page (20 per page) of task_2's quality reports."""
    return R.quality_page(quality_log_rows(spark, sf_dir), "task_2", page_no=2, size=20)


@register("audit_page", oracle=with_cte("""
SELECT * FROM audit
WHERE lower(action) LIKE '%error%' AND timestamp >= TIMESTAMP '2024-01-05 00:00:00'
  AND timestamp <= TIMESTAMP '2024-01-20 23:59:59'
ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 50
""", audit=AUDIT_SQL))
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows whose action contains 'Error' (any case) in a date range, page 2."""
    return R.audit_page(audit_rows(spark, sf_dir), page_no=2, size=50, action="Error",
                        start_date="2024-01-05", end_date="2024-01-20")


@register("audit_export", oracle=with_cte("""
SELECT timestamp, username, user_ip, action, target FROM audit
WHERE username = 'user7' ORDER BY timestamp DESC, id DESC LIMIT 10000
""", audit=AUDIT_SQL))
def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: one user's audit rows, newest first, capped at 10000 (the export's limit)."""
    return R.audit_export(audit_rows(spark, sf_dir), username="user7")


@register("daily_rollup", oracle=with_cte(f"""
SELECT pf.task_id, CAST(pf.created_at AS DATE) AS stat_date, count(*) AS total_files,
       count(*) FILTER (WHERE status = 'SUCCESS') AS success_files,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_files,
       count(*) FILTER (WHERE status = 'SKIPPED') AS skipped_files,
       CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows,
       CAST(coalesce(sum(valid_row_count), 0) AS BIGINT) AS valid_rows,
       {avg_half_up_sql("dq.quality_score", 2, 2)} AS avg_quality_score,
       {avg_half_up_sql("processing_time_ms", 0, 2)} AS avg_processing_ms
FROM pf LEFT JOIN dq ON dq.file_id = pf.id GROUP BY ALL
""", pf=PF_SQL, dq=DQ_SQL))
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (task, day) statistics joined with each file's quality score."""
    return R.daily_rollup(ledger_rows(spark, sf_dir), quality_log_rows(spark, sf_dir))


@register("metrics_rollup", oracle=with_cte("""
SELECT 'files_total' AS metric, task_id, status AS label, count(*) AS value FROM pf GROUP BY ALL
UNION ALL
SELECT 'rows_processed', task_id, '', CAST(coalesce(sum(row_count) FILTER (WHERE status = 'SUCCESS'), 0) AS BIGINT)
FROM pf GROUP BY task_id
UNION ALL
SELECT 'rows_failed', task_id, '',
       CAST(coalesce(sum(row_count - valid_row_count) FILTER (WHERE status = 'SUCCESS'), 0) AS BIGINT)
FROM pf GROUP BY task_id
UNION ALL
SELECT 'errors_total', task_id, error_type, count(*) FROM pf WHERE error_type IS NOT NULL GROUP BY ALL
""", pf=PF_SQL))
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter metrics by task and label in long form."""
    return R.metrics_rollup(ledger_rows(spark, sf_dir))


