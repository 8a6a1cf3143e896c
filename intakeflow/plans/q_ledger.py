"""Driver queries: ledger decisions and month lifecycle."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeflow.operators import ledger as L
from intakeflow.operators.lifecycle import ageing_candidates, apply_retention, registry_from_counts
from intakeflow.operators.route import month_counts
from intakeflow.plans.catalog import AS_OF_ORDERS, register
from intakeflow.plans.q_ingest import first_wins_table
from intakeflow.plans.reports import registry_listing
from intakeflow.sources.fixtures import DQ_SQL, PF_SQL, ledger_rows, quality_log_rows, table, with_cte
from intakeflow.streaming.alerts import all_alerts, failed_files_alerts, failure_alerts, quality_alerts

OWNER = "worker-1"
MAX_RETRIES = 3
# Task settings (J5): priority per task; lower runs first.
PRIORITIES = {"task_1": 3, "task_2": 1, "task_3": 2, "task_4": 5, "task_5": 4}
_PRIO_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITIES.items())


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory listing: every ledger file re-listed, plus customer files never seen."""
    seen = ledger_rows(spark, sf_dir).select("id", *L.KEY)
    cust = table(spark, sf_dir, "customer").select(
        (-F.col("c_custkey")).alias("id"), F.lit("task_1").alias("task_id"),
        F.concat(F.lit("/in/cust_"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("file_path"),
        (F.lit(1719000000000) + F.col("c_custkey") * 1000).alias("file_mtime"))
    return seen.unionByName(cust)


_ARRIVALS_SQL = """
SELECT id, task_id, file_path, file_mtime FROM pf
UNION ALL
SELECT -c_custkey, 'task_1', '/in/cust_' || CAST(c_custkey AS STRING) || '.csv', 1719000000000 + c_custkey * 1000
FROM customer
"""

_DECISION_SQL = f"""
SELECT a.id, a.task_id, a.file_path, a.file_mtime, p.status AS prior_status, p.retry_count,
       p.claim_expires_at, p.created_at,
       CASE WHEN p.status IS NULL THEN 'CLAIM_NEW'
            WHEN p.status = 'FAILED' AND p.retry_count < {MAX_RETRIES} THEN 'CLAIM_RETRY'
            WHEN p.status = 'PENDING' THEN 'CLAIM_PENDING'
            WHEN p.status IN ('CLAIMED', 'PROCESSING') AND p.claim_expires_at < TIMESTAMP '2001-12-01 00:00:00'
                 THEN 'CLAIM_EXPIRED'
            ELSE 'HOLD' END AS decision
FROM a LEFT JOIN pf p ON p.task_id = a.task_id AND p.file_path = a.file_path AND p.file_mtime = a.file_mtime
"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pf = ledger_rows(spark, sf_dir)
    d = L.claim_decisions(_arrivals(spark, sf_dir), pf, AS_OF_ORDERS, MAX_RETRIES)
    return d.join(pf.select(*L.KEY, "created_at"), list(L.KEY), "left")


@register("claim_decision", oracle=with_cte(
    "SELECT id, task_id, file_path, file_mtime, prior_status, decision FROM d",
    pf=PF_SQL, a=_ARRIVALS_SQL, d=_DECISION_SQL))
def claim_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim rule for a re-listed directory against the ledger's pre-image."""
    return _decisions(spark, sf_dir).select("id", *L.KEY, "prior_status", "decision")


@register("claimable_worklist", oracle=with_cte(f"""
SELECT id, task_id, file_path, file_mtime, decision, CASE task_id {_PRIO_SQL} END AS priority
FROM d
WHERE decision LIKE 'CLAIM%' AND CASE task_id {_PRIO_SQL} END IS NOT NULL
  AND (decision <> 'CLAIM_RETRY' OR created_at + to_seconds(
        [5, 30, 120][least(greatest(retry_count, 1), 3)]) <= TIMESTAMP '2001-12-01 00:00:00')
""", pf=PF_SQL, a=_ARRIVALS_SQL, d=_DECISION_SQL))
def claimable_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimable files that are due, with task priority, in work order (the ledger
    rows carry no failure time, so ``created_at`` stands in for the last failure)."""
    d = _decisions(spark, sf_dir)
    w = L.worklist(d, L.task_table(spark, PRIORITIES), AS_OF_ORDERS, last_failure=F.col("created_at"))
    return w.select("id", *L.KEY, "decision", "priority")


_FOLD_COLS = ("task_id", "file_path", "file_mtime", "file_name", "status", "retry_count", "error_type",
              "error_message", "row_count", "valid_row_count", "processing_time_ms", "claim_expires_at",
              "processed_at", "created_at")


@register("retry_reset", oracle=with_cte("""
SELECT task_id, file_path, file_mtime, file_name,
       CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status,
       CASE WHEN status = 'FAILED' THEN 0 ELSE retry_count END AS retry_count,
       CASE WHEN status IN ('SKIPPED') THEN error_type END AS error_type,
       CASE WHEN status IN ('SKIPPED') THEN error_message END AS error_message,
       row_count, valid_row_count, processing_time_ms,
       CASE WHEN status IN ('CLAIMED', 'PROCESSING') THEN claim_expires_at END AS claim_expires_at,
       processed_at, created_at
FROM pf
""", pf=PF_SQL))
def retry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 + L2: import the ledger as events, retry every FAILED file, fold back to current state."""
    pf = ledger_rows(spark, sf_dir)
    events = L.snapshot_events(pf).unionByName(L.retry_events(pf, AS_OF_ORDERS))
    return L.fold(events).select(*_FOLD_COLS)


@register("dead_letter", oracle=with_cte("""
SELECT id, task_id, file_path, retry_count, error_type,
       CASE WHEN error_type IS NULL OR error_type <> 'RetryableError' THEN 'fatal' ELSE 'retries_exhausted' END AS reason
FROM pf WHERE status = 'FAILED' AND (error_type IS NULL OR error_type <> 'RetryableError' OR retry_count >= 2)
""", pf=PF_SQL))
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to divert - fatal failures, or retryable ones that reached max_retries (2)."""
    d = L.dead_letter(ledger_rows(spark, sf_dir), max_retries=2)
    return d.select("id", "task_id", "file_path", "retry_count", "error_type", "reason")


_REGISTRY_SQL = """
SELECT 'task_lineitem' AS task_id, 'lineitem_' || month AS table_name,
       substr(month, 1, 4) || '-' || substr(month, 5, 2) AS year_month, 'ACTIVE' AS lifecycle_status,
       count(*) AS row_count, TIMESTAMP '2001-12-01 00:00:00' AS created_at
FROM (SELECT * FROM (SELECT strftime(l_shipdate, '%Y%m') AS month, row_number() OVER (
        PARTITION BY strftime(l_shipdate, '%Y%m'), l_orderkey, l_linenumber ORDER BY l_partkey % 2) AS rn
      FROM lineitem) t WHERE rn = 1) k
GROUP BY month
"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = month_counts(first_wins_table(spark, sf_dir), "lineitem")
    return registry_from_counts(counts, "task_lineitem", "lineitem", AS_OF_ORDERS)


@register("month_registry", oracle=with_cte(
    "SELECT * FROM r ORDER BY year_month DESC, task_id DESC LIMIT 200", r=_REGISTRY_SQL))
def month_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month registry of the first-wins target with row counts, newest first (max 200)."""
    return registry_listing(_registry(spark, sf_dir))


@register("retention_archive", oracle=with_cte("""
SELECT task_id, table_name, year_month,
       CASE WHEN year_month <= '1999-12' AND lifecycle_status = 'ACTIVE' THEN 'ARCHIVED' ELSE lifecycle_status END
         AS lifecycle_status,
       row_count, created_at,
       CASE WHEN year_month <= '1999-12' AND lifecycle_status = 'ACTIVE' THEN TIMESTAMP '2001-12-01 00:00:00' END
         AS archived_at
FROM r
""", r=_REGISTRY_SQL))
def retention_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 24 months retention at 2001-12-01, months up to 1999-12 become ARCHIVED."""
    return apply_retention(_registry(spark, sf_dir), 24, AS_OF_ORDERS)


AS_OF_ARCHIVE = _dt.datetime(2024, 6, 29, 0, 0, 0)


@register("archive_ageing", oracle=with_cte("""
SELECT file_path AS path,
       make_timestamp(file_mtime * 1000) < TIMESTAMP '2024-06-29 00:00:00' - INTERVAL 7 DAY
         AND NOT lower(file_path) LIKE '%.zip' AS compress,
       make_timestamp(file_mtime * 1000) < TIMESTAMP '2024-06-29 00:00:00' - INTERVAL 90 DAY AS cleanup
FROM pf
""", pf=PF_SQL))
def archive_ageing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive-folder compress (older than 7 days, not .zip) and cleanup (90 days) candidates."""
    pf = ledger_rows(spark, sf_dir)
    listing = pf.select(F.col("file_path").alias("path"),
                        F.timestamp_millis("file_mtime").cast("timestamp_ntz").alias("modificationTime"))
    return ageing_candidates(listing, AS_OF_ARCHIVE, 7, 90).select("path", "compress", "cleanup")


@register("alerts", oracle=with_cte("""
SELECT 'quality_low' AS kind, task_id, CAST(file_id AS STRING) AS file_name, quality_score AS value
FROM dq WHERE quality_score < 80
UNION ALL
SELECT CASE WHEN error_type IS NULL OR error_type <> 'RetryableError' THEN 'pipeline_failure' ELSE 'dead_letter' END,
       task_id, file_name, CAST(retry_count AS DOUBLE)
FROM pf WHERE status = 'FAILED' AND (error_type IS NULL OR error_type <> 'RetryableError' OR retry_count >= 2)
UNION ALL
SELECT 'failed_files', task_id, NULL, CAST(count(*) AS DOUBLE) FROM pf WHERE status = 'FAILED'
GROUP BY task_id HAVING count(*) > 10
""", pf=PF_SQL, dq=DQ_SQL))
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-quality, fatal-failure, dead-letter and too-many-failures alert rows (base names only)."""
    pf = ledger_rows(spark, sf_dir)
    q = quality_alerts(quality_log_rows(spark, sf_dir))
    f = failure_alerts(L.dead_letter(pf, max_retries=2))
    return all_alerts(q, f, failed_files_alerts(pf, threshold=10))


@register("status_lookup", oracle=with_cte("""
SELECT * FROM (SELECT task_id, file_path, file_mtime, status, retry_count FROM pf
               WHERE task_id = 'task_3' AND file_path = '/in/order_' || (SELECT CAST(max(id) AS STRING) FROM pf
                                                                       WHERE task_id = 'task_3') || '.csv'
               ORDER BY file_mtime DESC LIMIT 1) t
""", pf=PF_SQL))
def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: status and retry count of one file by (task, path); without an mtime the newest answers."""
    pf = ledger_rows(spark, sf_dir)
    newest = pf.filter(F.col("task_id") == "task_3").agg(F.max("id")).first()[0]
    return L.status_lookup(pf, "task_3", f"/in/order_{newest}.csv")
