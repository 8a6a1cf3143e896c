"""Validity split and run counters (P1, P2, A12, A14, on_row_error).

A cleaner marks rows with ``_valid`` instead of dropping them, so valid and
error rows come from one scan and keep their identity (no positional pairing,
no join back to the input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from intakeflow.errors import FAIL, MESSAGE_CHARS
from intakeflow.operators.cleaners import REASON, VALID


class RowErrorAbort(RuntimeError):
    """on_row_error = abort and at least one row failed."""


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col(VALID)).drop(VALID, REASON)


def error_rows(flagged: DataFrame) -> DataFrame:
    """Rows whose flag is false or NULL (a NULL flag counts as not valid)."""
    return flagged.filter(~F.coalesce(F.col(VALID), F.lit(False))).drop(VALID)


def pass_through(df: DataFrame) -> DataFrame:
    """No cleaner configured - every row is valid."""
    return df.withColumn(VALID, F.lit(True)).withColumn(REASON, F.lit(None).cast("string"))


def counters(flagged: DataFrame) -> DataFrame:
    """A12/A14 as one aggregate: raw (original), valid (cleaned), error (dropped)."""
    return flagged.agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(F.col(VALID)).alias("valid_count"),
        F.count_if(~F.coalesce(F.col(VALID), F.lit(False))).alias("error_count"))


def observe_counters(flagged: DataFrame) -> tuple[DataFrame, Observation]:
    """A14 without an extra job: the counters ride along the write of ``flagged``.

    Exact when the observed frame runs in the writing job's result stage (no shuffle
    between it and the write); observed below a shuffle, a recomputed map stage after an
    executor loss may count twice - use ``counters`` (a job result) there.
    """
    obs = Observation("run_counters")
    return flagged.observe(obs, F.count(F.lit(1)).alias("raw_count"),
                           F.count_if(F.col(VALID)).alias("valid_count")), obs


def enforce_on_row_error(flagged: DataFrame, policy: str) -> DataFrame:
    """``skip``: error rows are set aside; ``abort``: any error row fails the file.

    The abort check is a ``raise_error`` inside the plan, so it costs no extra job.
    """
    if policy == "skip":
        return flagged
    if policy != "abort":
        raise ValueError("policy must be 'skip' or 'abort'")
    return flagged.withColumn(
        VALID, F.when(F.col(VALID), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("row error (on_row_error=abort): "),
                                   F.coalesce(F.col(REASON), F.lit("rejected"))))).cast("boolean"))


def mark_row_errors(flagged: DataFrame, policy: str) -> DataFrame:
    """``abort`` as data: a row error is a row that fails its file, the other files go on."""
    if policy == "skip":
        return flagged
    if policy != "abort":
        raise ValueError("policy must be 'skip' or 'abort'")
    message = F.when(~F.col(VALID), F.substring(F.concat(
        F.lit("fatal: row error (on_row_error=abort): "), F.coalesce(F.col(REASON), F.lit("rejected"))), 1, MESSAGE_CHARS))
    return flagged.withColumn(FAIL, F.coalesce(F.col(FAIL), message) if FAIL in flagged.columns else message)
