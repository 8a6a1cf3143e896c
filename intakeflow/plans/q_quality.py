"""Driver queries: quality scoring and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeflow.functions.columns import avg_half_up, avg_half_up_sql
from intakeflow.operators.cleaners import test_clean_flagged
from intakeflow.operators.quality import quality_report, with_band
from intakeflow.plans.catalog import register
from intakeflow.sources.fixtures import DQ_SQL, RAW_SQL, quality_log_rows, raw_rows, with_cte

REQUIRED = ("value", "date")
_BLANK = "(name IS NULL OR trim(name) = '' OR name = 'None')"
# Input files of the dirty rows: eight delivery files by order key.
_FILE_SQL = "'/in/raw_' || CAST(CAST(id AS BIGINT) % 8 AS STRING) || '.csv'"


def _raw_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_rows(spark, sf_dir)
    return raw.withColumn("file_path", F.concat(
        F.lit("/in/raw_"), (F.col("id").cast("bigint") % 8).cast("string"), F.lit(".csv")))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_with_file(spark, sf_dir)
    # the report counts missing required values on the input rows
    return test_clean_flagged(raw.select("file_path", *[F.col(c).alias(f"in_{c}") for c in REQUIRED],
                                         "id", "name", "value", "date", "status", "score"),
                              keep=["file_path"] + [f"in_{c}" for c in REQUIRED]) \
        .select("file_path", *[F.col(f"in_{c}").alias(c) for c in REQUIRED], "_valid")


_COUNTS = f"""
SELECT {_FILE_SQL} AS file_path, count(*) AS total_rows,
       count(*) FILTER (WHERE {_BLANK}) AS error_rows,
       count(*) FILTER (WHERE value IS NULL OR value = '') AS n_value,
       count(*) FILTER (WHERE date IS NULL OR date = '') AS n_date
FROM raw GROUP BY 1
"""

_REPORT = f"""
SELECT file_path, total_rows, error_rows, total_rows - error_rows AS valid_rows,
       round(CASE WHEN total_rows > 0 THEN (n_value + n_date) / (total_rows * 2.0) ELSE 0.0 END, 4) AS null_rate,
       round(CASE WHEN total_rows > 0 THEN error_rows / total_rows::DOUBLE ELSE 0.0 END, 4) AS error_rate,
       round(greatest(0.0, 100.0 - 60.0 * CASE WHEN total_rows > 0 THEN error_rows / total_rows::DOUBLE ELSE 0.0 END
                                  - 40.0 * CASE WHEN total_rows > 0 THEN (n_value + n_date) / (total_rows * 2.0) ELSE 0.0 END), 2)
         AS quality_score,
       n_value, n_date
FROM c
"""


@register("quality_report", oracle=with_cte(
    "SELECT * EXCLUDE (n_value, n_date) FROM r", raw=RAW_SQL, c=_COUNTS, r=_REPORT))
def quality_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 per input file: totals, error and null rates, score = 100 - 60 err - 40 null."""
    return quality_report(_flagged(spark, sf_dir), ["file_path"], REQUIRED).drop("error_details")


@register("quality_null_fields", oracle=with_cte("""
SELECT file_path, 'value' AS detail, n_value AS n FROM c WHERE n_value > 0
UNION ALL SELECT file_path, 'date', n_date FROM c WHERE n_date > 0
UNION ALL SELECT file_path, 'transform_errors', error_rows FROM c WHERE error_rows > 0
""", raw=RAW_SQL, c=_COUNTS))
def quality_null_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-field missing counts and transform errors (zero entries omitted), one row per detail."""
    rep = quality_report(_flagged(spark, sf_dir), ["file_path"], REQUIRED)
    return rep.select("file_path", F.explode("error_details").alias("detail", "n"))


@register("quality_band", oracle=with_cte(f"""
SELECT task_id,
       CASE WHEN quality_score >= 90 THEN 'good' WHEN quality_score >= 70 THEN 'fair' ELSE 'attention' END AS band,
       count(*) AS files, {avg_half_up_sql("quality_score", 2, 2)} AS avg_score
FROM dq GROUP BY ALL
""", dq=DQ_SQL))
def quality_band_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files per task and quality band."""
    return with_band(quality_log_rows(spark, sf_dir)).groupBy("task_id", "band").agg(
        F.count(F.lit(1)).alias("files"), avg_half_up(F.col("quality_score"), 2, 2).alias("avg_score"))


@register("quality_rerun_latest", oracle=with_cte("""
SELECT file_id, task_id, batch_time, total_rows, error_rows, quality_score FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY batch_time DESC, run DESC) AS rn FROM (
    SELECT *, 0 AS run FROM dq
    UNION ALL
    SELECT file_id, task_id, batch_time + INTERVAL 1 DAY, total_rows, 0, 100.0, 1 FROM dq WHERE error_rows > 0) u
  WHERE file_id > 0) t
WHERE rn = 1
""", dq=DQ_SQL))
def quality_rerun_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the quality log is appended on every run; a file's latest report replaces the earlier ones
    (rows without a ledger id, ``file_id <= 0``, are not kept).  Files with errors are re-run a day
    later (clean this time)."""
    from intakeflow.operators.quality import latest_per_file

    dq = quality_log_rows(spark, sf_dir).withColumn("run", F.lit(0))
    rerun = dq.filter(F.col("error_rows") > 0).select(
        "file_id", "task_id", (F.col("batch_time") + F.expr("INTERVAL 1 DAY")).alias("batch_time"),
        "total_rows", F.lit(0).cast("bigint").alias("error_rows"), F.lit(100.0).alias("quality_score"),
        F.lit(1).alias("run"))
    latest = latest_per_file(dq.unionByName(rerun), "file_id", "batch_time", tie="run")
    return latest.drop("run")
