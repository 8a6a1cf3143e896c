"""Driver queries: cleaners and validity split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeflow.operators.cleaners import (deduplicate, fillna_and_trim, normalize_dates,
                                           test_clean, test_clean_flagged)
from intakeflow.operators.split import counters, error_rows
from intakeflow.plans.catalog import register
from intakeflow.sources.fixtures import RAW_SQL, raw_rows, table, with_cte

_VALUE = ("CASE WHEN try_cast(value AS DOUBLE) IS NULL OR isnan(try_cast(value AS DOUBLE)) "
          "THEN 0.0 ELSE try_cast(value AS DOUBLE) END")
_SCORE_X = ("CASE WHEN try_cast(score AS DOUBLE) IS NULL OR isnan(try_cast(score AS DOUBLE)) "
            "THEN 0.0 ELSE try_cast(score AS DOUBLE) END")
_STATUS = "lower(trim(coalesce(status, 'None')))"
_BLANK = "(name IS NULL OR trim(name) = '' OR name = 'None')"

TEST_CLEAN_SQL = f"""
SELECT coalesce(id, '') AS id, trim(name) AS name, {_VALUE} AS value,
       strftime(try_strptime(substr(date, 1, 10), '%Y-%m-%d'), '%Y-%m-%d') AS date,
       CASE WHEN {_STATUS} IN ('', 'none', 'nan') THEN 'unknown' ELSE {_STATUS} END AS status,
       CAST(trunc(least(greatest({_SCORE_X}, 0.0), 100.0)) AS INTEGER) AS score
FROM raw WHERE NOT {_BLANK}
"""


@register("clean_composite", oracle=with_cte(TEST_CLEAN_SQL, raw=RAW_SQL))
def clean_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5 (F8, F5, F4, F6, F7) on dirty string rows."""
    return test_clean(raw_rows(spark, sf_dir))


def _fill(c: str) -> str:
    t = f"trim(coalesce({c}, 'None'))"
    return f"CASE WHEN {t} IN ('nan', 'None', 'NaN') THEN '' ELSE {t} END AS {c}"


_RAW_COLS = ("id", "name", "value", "date", "status", "score")


@register("clean_fillna_trim", oracle=with_cte(f"""
SELECT {", ".join(_fill(c) for c in _RAW_COLS)}
FROM raw WHERE NOT ({" AND ".join(f"{c} IS NULL" for c in _RAW_COLS)})
""", raw=RAW_SQL))
def clean_fillna_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop all-NULL rows, strip text and blank the null tokens."""
    return fillna_and_trim(raw_rows(spark, sf_dir))


@register("clean_fillna_typed", oracle="""
SELECT p_partkey AS key, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS INTEGER) AS size,
       CAST(CASE WHEN p_partkey % 5 IN (0, 1) THEN 0 ELSE p_size / 2.0 END AS DOUBLE) AS ratio,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'x y' END AS note
FROM part WHERE p_partkey % 7 <> 0
""")
def clean_fillna_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of nulls only go; nulls and NaNs of number columns become 0, of text columns empty."""
    k, gone = F.col("p_partkey"), F.col("p_partkey") % 7 == 0
    size = F.col("p_size").cast("int")
    rows = table(spark, sf_dir, "part").select(
        F.when(~gone, k).alias("key"), F.when(~gone & (k % 3 != 0), size).alias("size"),
        F.when(~gone & (k % 5 != 1), F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(size / 2.0)).alias("ratio"),
        F.when(~gone & (k % 4 != 0), F.lit("  x y ")).alias("note"))
    return fillna_and_trim(rows)


@register("clean_dedup", oracle=with_cte("SELECT DISTINCT * FROM raw", raw=RAW_SQL))
def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact duplicate rows removed."""
    return deduplicate(raw_rows(spark, sf_dir))


_PARSED = ("coalesce(try_strptime(date, '%Y-%m-%d %H:%M:%S'), try_strptime(date, '%Y-%m-%dT%H:%M:%S'), "
           "try_strptime(date, '%Y-%m-%d %H:%M'), try_strptime(date, '%Y-%m-%d'), "
           "try_strptime(date, '%Y/%m/%d %H:%M:%S'), try_strptime(date, '%Y/%m/%d'))")


@register("clean_dates", oracle=with_cte(f"""
SELECT id, name, value,
       CASE WHEN (SELECT avg(CASE WHEN {_PARSED} IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM raw) > 0.5
            THEN strftime({_PARSED}, '%Y-%m-%d') ELSE date END AS date,
       status, score
FROM raw
""", raw=RAW_SQL))
def clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """columns named like dates are normalised when more than half their values parse."""
    return normalize_dates(raw_rows(spark, sf_dir))


@register("validity_split", oracle=with_cte(f"""
SELECT id, name, value, date, status, score, 'blank name' AS _error FROM raw WHERE {_BLANK}
""", raw=RAW_SQL))
def validity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows of the composite cleaner with their original values (true identity)."""
    raw = raw_rows(spark, sf_dir)
    flagged = test_clean_flagged(raw.select(*[F.col(c).alias(f"in_{c}") for c in raw.columns], *raw.columns),
                                 keep=[f"in_{c}" for c in raw.columns])
    errs = error_rows(flagged)
    return errs.select(*[F.col(f"in_{c}").alias(c) for c in raw.columns], "_error")


@register("run_summary", oracle=with_cte(f"""
SELECT count(*) AS raw_count,
       count(*) FILTER (WHERE NOT {_BLANK}) AS valid_count,
       count(*) FILTER (WHERE {_BLANK}) AS error_count,
       count(*) - count(*) FILTER (WHERE NOT {_BLANK}) AS dropped
FROM raw
""", raw=RAW_SQL))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original vs cleaned counts of one run; dropped = original - cleaned."""
    c = counters(test_clean_flagged(raw_rows(spark, sf_dir)))
    return c.withColumn("dropped", F.col("raw_count") - F.col("valid_count"))


@register("clean_preview", oracle=with_cte(TEST_CLEAN_SQL.strip() + """
ORDER BY CAST(id AS BIGINT), name, value, date, status, score LIMIT 50""", raw=RAW_SQL))
def clean_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbench preview - first 50 cleaned rows in a stable order (the limit is the feature)."""
    out = test_clean(raw_rows(spark, sf_dir))
    return out.orderBy(F.col("id").cast("bigint"), "name", "value", "date", "status", "score").limit(50)


def _flag_rows(rows: list) -> list:
    """A user row function: reject rows without a name, mark the others processed."""
    out = []
    for r in rows:
        name = r.get("name")
        if name is None or str(name).strip() == "" or str(name) == "None":
            out.append(None)
        else:
            out.append({**r, "processed": True})
    return out


@register("row_udf_flag", oracle=with_cte(f"""
SELECT id, name, CASE WHEN NOT {_BLANK} THEN TRUE END AS processed, NOT {_BLANK} AS _valid FROM raw
""", raw=RAW_SQL))
def row_udf_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python row function over Arrow batches; rejected rows come back with their identity."""
    from pyspark.sql import types as T

    from intakeflow.operators.cleaners import apply_row_function

    ided = raw_rows(spark, sf_dir).withColumn("_row_id", F.monotonically_increasing_id())
    out_schema = T.StructType([T.StructField("processed", T.BooleanType())])
    res = apply_row_function(ided, _flag_rows, out_schema, keep=("id", "name"))
    return res.select("id", "name", "processed", "_valid")


@register("frame_udf_dedup", oracle=with_cte("""
SELECT DISTINCT 'raw_' || CAST(CAST(id AS BIGINT) // 1000 AS STRING) AS _file, * FROM raw
""", raw=RAW_SQL))
def frame_udf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas ``clean_data(df)`` run once per file (files of at most 1000 order keys)."""
    from intakeflow.operators.cleaners import apply_frame_function

    raw = raw_rows(spark, sf_dir)
    files = raw.withColumn("_file", F.concat(F.lit("raw_"), F.floor(F.col("id").cast("bigint") / 1000)
                                             .cast("bigint").cast("string")))

    def clean_data(pdf):
        return pdf.drop_duplicates(keep="first").reset_index(drop=True)

    return apply_frame_function(files, clean_data, files.schema)


def _cast_fail(col: str, cast: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL AND {cast} IS NULL THEN '{col}' END"


# Integer cast as Spark does it: whole numbers only (no fractions, no exponents), blanks trimmed.
_INT = "CASE WHEN regexp_full_match(trim(score), '[+-]?[0-9]+') THEN TRY_CAST(score AS INTEGER) END"
_FAILS = ", ".join([_cast_fail("id", "TRY_CAST(id AS BIGINT)"), _cast_fail("value", "TRY_CAST(value AS DOUBLE)"),
                    _cast_fail("date", "TRY_CAST(date AS DATE)"), _cast_fail("score", _INT)])


@register("conform_target", oracle=with_cte(f"""
SELECT TRY_CAST(id AS BIGINT) AS id, name, TRY_CAST(value AS DOUBLE) AS value, TRY_CAST(date AS DATE) AS date,
       status, {_INT} AS score,
       concat_ws(', ', {_FAILS}) = '' AS _valid,
       CASE WHEN concat_ws(', ', {_FAILS}) <> '' THEN 'cast failed: ' || concat_ws(', ', {_FAILS}) END AS _error
FROM raw
""", raw=RAW_SQL))
def conform_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty rows cast to the month table's schema; a non-NULL value that does not cast
    makes the row an error naming the columns."""
    from pyspark.sql import types as T

    from intakeflow.operators.conform import conform_to_target

    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("date", T.DateType()),
                           T.StructField("status", T.StringType()), T.StructField("score", T.IntegerType())])
    return conform_to_target(raw_rows(spark, sf_dir), target)
