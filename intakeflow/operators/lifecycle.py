"""Month lifecycle (L6, L7, L8) and the month registry.

The registry is derived state: months present in the target plus lifecycle
events (ARCHIVED, DROPPED) appended over time.  Retention is a filter over
the registry - calendar-sized, never the data itself.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeflow.functions.columns import ts_lit
from intakeflow.operators.route import MONTH


def cutoff_month(as_of: _dt.date | _dt.datetime, retention_months: int) -> str:
    """``YYYY-MM`` of ``as_of - retention_months`` (calendar months)."""
    y, m = as_of.year, as_of.month - retention_months
    while m <= 0:
        m += 12
        y -= 1
    return f"{y:04d}-{m:02d}"


def apply_retention(registry: DataFrame, retention_months: int, as_of: _dt.date | _dt.datetime,
                    archived_at: _dt.datetime | None = None) -> DataFrame:
    """ACTIVE months with ``year_month <= cutoff`` become ARCHIVED; 0 or less = never."""
    if retention_months <= 0:
        return registry
    cut = cutoff_month(as_of, retention_months)
    hit = (F.col("year_month") <= F.lit(cut)) & (F.col("lifecycle_status") == "ACTIVE")
    ts = ts_lit(archived_at or as_of)
    prior = F.col("archived_at") if "archived_at" in registry.columns else F.lit(None).cast("timestamp_ntz")
    cols = [c for c in registry.columns if c != "archived_at"]
    return registry.select(
        *[F.when(hit, F.lit("ARCHIVED")).otherwise(F.col(c)).alias(c) if c == "lifecycle_status" else F.col(c)
          for c in cols],
        F.when(hit, ts).otherwise(prior).alias("archived_at"))


def drop_archived(registry: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """ARCHIVED -> DROPPED (all archived months, or the listed ``YYYY-MM`` values)."""
    hit = F.col("lifecycle_status") == "ARCHIVED"
    if months is not None:
        hit = hit & F.col("year_month").isin(list(months))
    return registry.withColumn("lifecycle_status", F.when(hit, F.lit("DROPPED")).otherwise(F.col("lifecycle_status")))


def delete_month_partitions(spark: SparkSession, target_path: str, months: Sequence[str]) -> int:
    """Remove the partition folders of dropped months (``month=YYYYMM``) through the Hadoop FS."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(target_path)
    fs = base.getFileSystem(conf)
    n = 0
    for m in months:
        p = jvm.org.apache.hadoop.fs.Path(base, f"{MONTH}={m}")
        if fs.exists(p) and fs.delete(p, True):
            n += 1
    return n


def registry_from_counts(month_rows: DataFrame, task_id: str, base_table: str,
                         created_at: _dt.datetime) -> DataFrame:
    """Registry rows (ACTIVE) with row counts, from per-month counts of the target."""
    m = month_rows.filter(F.col(MONTH).isNotNull())
    return m.select(
        F.lit(task_id).alias("task_id"),
        F.concat(F.lit(base_table + "_"), F.col(MONTH)).alias("table_name"),
        F.concat(F.substring(MONTH, 1, 4), F.lit("-"), F.substring(MONTH, 5, 2)).alias("year_month"),
        F.lit("ACTIVE").alias("lifecycle_status"),
        F.col("row_count").cast("bigint").alias("row_count"),
        ts_lit(created_at).alias("created_at"))


def archived_months(registry: DataFrame) -> DataFrame:
    """Months a writer must not accept (ARCHIVED or DROPPED), as ``YYYYMM``."""
    return registry.filter(F.col("lifecycle_status").isin("ARCHIVED", "DROPPED")).select(
        F.regexp_replace("year_month", "-", "").alias(MONTH))


def ageing_candidates(listing: DataFrame, as_of: _dt.datetime, compress_after_days: int,
                      cleanup_after_days: int, mtime: Column | None = None) -> DataFrame:
    """Archive-folder files older than N days by mtime.

    ``compress`` excludes ``.zip`` files; ``cleanup`` applies to all.  N <= 0 disables a rule.
    ``mtime`` defaults to ``modificationTime`` (binaryFile listing) or ``modified_at`` (``list_files``).
    """
    if mtime is not None:
        t = mtime
    else:  # a binaryFile listing, or the output of sources.files.list_files
        t = F.col("modificationTime") if "modificationTime" in listing.columns else F.col("modified_at")
    age_ok = lambda n: (F.lit(n > 0) & (t < ts_lit(as_of) - F.make_dt_interval(F.lit(max(n, 0)))))
    is_zip = F.lower(F.col("path")).endswith(".zip")
    return listing.select(
        "*",
        (age_ok(compress_after_days) & ~is_zip).alias("compress"),
        age_ok(cleanup_after_days).alias("cleanup"))
