"""Reading vectors that take part in searches and joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USABLE = ("{c} is not null and exists({c}, x -> x <> 0) "
          "and not exists({c}, x -> x is null or isnan(x) or abs(x) = double('infinity'))")


def usable(column: str = "embedding"):
    """True for a vector that is not null or zero and has only finite components."""
    return F.coalesce(F.expr(USABLE.format(c=f"`{column}`")), F.lit(False))


def typed(df: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))
