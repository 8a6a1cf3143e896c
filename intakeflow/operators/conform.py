"""Target-schema conformance (K1 template replacement, G9, P3, F18).

The month table's schema is a ``StructType`` per task.  Rows are conformed
with ``try_cast`` per column: a non-NULL value that does not cast is a row
error (the reference's database silently coerced it, G9); a missing column is
NULL (P3); columns the target does not have are dropped or rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.functions.columns import qcol
from intakeflow.operators.cleaners import REASON, VALID


def conform_to_target(flagged: DataFrame, target: T.StructType, extra: str = "drop",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """Cast to the target schema; failed casts mark the row invalid with the column names.

    ``flagged`` may carry ``_valid`` / ``_error`` from a cleaner; ``keep`` names bookkeeping
    columns (file, row, month...) carried through unchanged.
    """
    if extra not in ("drop", "error"):
        raise ValueError("extra must be 'drop' or 'error'")
    bookkeeping = set(keep) | {VALID, REASON}
    unknown = [c for c in flagged.columns if c not in target.fieldNames() and c not in bookkeeping]
    if unknown and extra == "error":
        raise ValueError(f"columns not in the target schema: {unknown}")
    cast_cols, failures = [], []
    for f in target.fields:
        if f.name in flagged.columns:
            src = qcol(f.name)
            same = flagged.schema[f.name].dataType == f.dataType
            val = src if same else src.try_cast(f.dataType)
            if not same:
                failures.append(F.when(src.isNotNull() & val.isNull(), F.lit(f.name)))
        else:
            val = F.lit(None).cast(f.dataType)
        cast_cols.append(val.alias(f.name))
    bad = F.concat_ws(", ", *failures) if failures else F.lit("")
    valid_in = F.col(VALID) if VALID in flagged.columns else F.lit(True)
    reason_in = F.col(REASON) if REASON in flagged.columns else F.lit(None).cast("string")
    cast_error = F.when(bad != "", F.concat(F.lit("cast failed: "), bad))
    return flagged.select(
        *cast_cols, *[qcol(k) for k in keep if k in flagged.columns],
        (valid_in & (bad == "")).alias(VALID),
        F.coalesce(reason_in, cast_error).alias(REASON))
