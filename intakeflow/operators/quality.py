"""Quality scoring.

One aggregate per file (or per batch key) produces the whole report; the
aggregate is partial/final, so a file holding a third of all rows is reduced
map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeflow.functions.columns import qcol, quality_band
from intakeflow.operators.cleaners import VALID
from intakeflow.spec import QUALITY_ERROR_WEIGHT, QUALITY_NULL_WEIGHT


def _is_blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def score_columns(total: Column, errors: Column, nulls: Column, n_required: int) -> list[Column]:
    """A6 from counts: valid, null_rate, error_rate (4 places) and score (2 places)."""
    t = total.cast("double")
    error_rate = F.when(total > 0, errors.cast("double") / t).otherwise(F.lit(0.0))
    if n_required:
        null_rate = F.when(total > 0, nulls.cast("double") / (t * F.lit(float(n_required)))) \
            .otherwise(F.lit(0.0))
    else:
        null_rate = F.lit(0.0)
    score = F.greatest(F.lit(0.0), F.lit(100.0) - error_rate * QUALITY_ERROR_WEIGHT
                       - null_rate * QUALITY_NULL_WEIGHT)
    return [(total - errors).alias("valid_rows"),
            F.round(null_rate, 4).alias("null_rate"),
            F.round(error_rate, 4).alias("error_rate"),
            F.round(score, 2).alias("quality_score")]


def quality_report(flagged: DataFrame, by: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """A6 + A7 per group ``by`` (e.g. the file).

    ``flagged`` holds every input row with ``_valid``; a required field counts
    as missing when NULL or ``''``.  ``error_details`` maps each required field
    with at least one missing value to its count, plus ``transform_errors``
    when rows were rejected.  With ``by=()`` the report covers the whole input
    (an empty input scores 100).
    """
    aggs = [F.count(F.lit(1)).alias("total_rows"),
            F.count_if(~F.coalesce(F.col(VALID), F.lit(False))).alias("error_rows")]
    # a required field the data does not have at all is missing in every row
    aggs += [(F.count_if(_is_blank(qcol(f))) if f in flagged.columns else F.count(F.lit(1))).alias(f"_null_{i}")
             for i, f in enumerate(required)]
    g = flagged.groupBy(*[qcol(b) for b in by]).agg(*aggs) if by else flagged.agg(*aggs)
    nulls = sum((F.col(f"_null_{i}") for i in range(len(required))), F.lit(0).cast("long"))
    details = F.create_map(
        *[x for i, f in enumerate(required) for x in (F.lit(f), F.col(f"_null_{i}"))],
        F.lit("transform_errors"), F.col("error_rows"))
    return g.select(
        *[qcol(b) for b in by], "total_rows", "error_rows",
        *score_columns(F.col("total_rows"), F.col("error_rows"), nulls, len(required)),
        F.map_filter(details, lambda k, v: v > 0).alias("error_details"))


def with_band(df: DataFrame, score: str = "quality_score") -> DataFrame:
    """F15."""
    return df.withColumn("band", quality_band(F.col(score)))


def latest_per_file(log: DataFrame, file_col: str = "file_id", time_col: str = "batch_time",
                    tie: str = "id") -> DataFrame:
    """K3: the quality log is append-only; a re-run's row replaces earlier rows of the same file.

    ``max_by`` over a struct is an aggregate with a map-side partial step (no window per key).
    Rows with ``file_id <= 0`` are not part of the log.
    """
    log = log.filter(F.col(file_col) > 0)
    cols = [c for c in log.columns if c != file_col]
    packed = F.struct(*[qcol(c) for c in cols])
    order = F.struct(qcol(time_col), qcol(tie)) if tie in log.columns else F.struct(qcol(time_col))
    latest = log.groupBy(file_col).agg(F.max_by(packed, order).alias("_r"))
    return latest.select(file_col, *[F.col("_r").getField(c).alias(c) for c in cols])
