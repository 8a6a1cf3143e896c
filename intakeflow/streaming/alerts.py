"""Alert rows.

Rules: quality score below the minimum (default 80), fatal failure, dead-letter;
plus the two documented thresholds (failed files per task, work-list size).
Alerts carry only the base name of a file (P11).  The same functions run on
a batch DataFrame or inside ``foreachBatch`` on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.functions.columns import base_name
from intakeflow.spec import QUALITY_ALERT_MIN_SCORE

ALERT_COLS = ("kind", "task_id", "file_name", "value")


def quality_alerts(quality: DataFrame, min_score: float = QUALITY_ALERT_MIN_SCORE,
                   path_col: str = "file_path") -> DataFrame:
    name = base_name(F.col(path_col)) if path_col in quality.columns else F.col("file_id").cast("string")
    return quality.filter(F.col("quality_score") < min_score).select(
        F.lit("quality_low").alias("kind"), "task_id", name.alias("file_name"),
        F.col("quality_score").cast("double").alias("value"))


def failure_alerts(dead: DataFrame) -> DataFrame:
    """Rows of ``ledger.dead_letter``: fatal failures and exhausted retries."""
    kind = F.when(F.col("reason") == "fatal", F.lit("pipeline_failure")).otherwise(F.lit("dead_letter"))
    return dead.select(kind.alias("kind"), "task_id", base_name(F.col("file_path")).alias("file_name"),
                       F.col("retry_count").cast("double").alias("value"))


def failed_files_alerts(current: DataFrame, threshold: int = 10) -> DataFrame:
    """(doc-only) tasks with more than ``threshold`` FAILED files."""
    g = current.filter(F.col("status") == "FAILED").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > threshold).select(
        F.lit("failed_files").alias("kind"), "task_id", F.lit(None).cast("string").alias("file_name"),
        F.col("n").cast("double").alias("value"))


def backlog_alerts(worklist: DataFrame, queue_size_max: int = 400) -> DataFrame:
    """(doc-only) tasks whose claimable backlog exceeds ``queue_size_max``."""
    g = worklist.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > queue_size_max).select(
        F.lit("queue_backlog").alias("kind"), "task_id", F.lit(None).cast("string").alias("file_name"),
        F.col("n").cast("double").alias("value"))


def all_alerts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
