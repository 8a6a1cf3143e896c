"""Month routing.

Every valid row gets a ``month`` (``YYYYMM``) from the task's partition field;
the month is the partition column of one table per task, which replaces the
reference's one-physical-table-per-month layout.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeflow.functions.columns import month_suffix, qcol, table_name, ts_lit, year_month
from intakeflow.spec import TaskSpec, month_of

MONTH = "month"
FALLBACK = "_route_fallback"


def route_months(df: DataFrame, spec: TaskSpec, as_of: _dt.datetime | _dt.date) -> DataFrame:
    """F1/K1: add ``month`` and ``_route_fallback`` (True when the as_of month was used)."""
    field = spec.partition_field
    if field and field in df.columns:
        m, fb = month_suffix(qcol(field), df.schema[field].dataType, spec.partition_format, as_of)
    else:
        m, fb = F.lit(month_of(as_of)), F.lit(True)
    return df.withColumn(MONTH, m).withColumn(FALLBACK, fb)


def month_counts(routed: DataFrame, base_table: str) -> DataFrame:
    """Rows per month table plus a grand-total row (month NULL).

    One grouped count per month; the total is summed from those few rows (the month
    shuffle is reused), instead of a rollup that expands every input row twice.
    """
    per = routed.groupBy(MONTH).agg(F.count(F.lit(1)).alias("row_count"))
    total = per.agg(F.sum("row_count").cast("bigint").alias("row_count")).select(
        F.lit(None).cast("string").alias(MONTH), "row_count")
    g = per.unionByName(total)
    return g.select(
        F.col(MONTH),
        F.when(F.col(MONTH).isNotNull(), year_month(F.col(MONTH))).alias("year_month"),
        F.when(F.col(MONTH).isNotNull(), table_name(base_table, F.col(MONTH))).alias("table_name"),
        F.col("row_count"))


def registry_additions(written: DataFrame, registry: DataFrame | None, task_id: str,
                       base_table: str, created_at: _dt.datetime) -> DataFrame:
    """K8: months first written by this batch, as new registry rows (insert-ignore).

    ``written`` needs only the ``month`` column; the anti join runs on the
    distinct months, so its size is bounded by the calendar, not the data.
    """
    months = written.select(MONTH).distinct()
    new = months.select(
        F.lit(task_id).alias("task_id"),
        table_name(base_table, F.col(MONTH)).alias("table_name"),
        year_month(F.col(MONTH)).alias("year_month"),
        F.lit("ACTIVE").alias("lifecycle_status"),
        ts_lit(created_at).alias("created_at"))
    if registry is None:
        return new
    return new.join(registry.select("task_id", "table_name"), ["task_id", "table_name"], "left_anti")
