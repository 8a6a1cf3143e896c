"""Field encryption before routing (P12): AES-GCM through Spark's built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeflow.functions.columns import qcol


def encrypt_column(c: Column, key: Column) -> Column:
    """base64(AES-GCM(text)); NULL stays NULL.  A random IV makes equal inputs differ."""
    return F.base64(F.aes_encrypt(c.cast("string").cast("binary"), key, F.lit("GCM")))


def decrypt_column(c: Column, key: Column) -> Column:
    """Inverse of ``encrypt_column``; a wrong key or damaged text gives NULL."""
    return F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def encrypt_fields(df: DataFrame, fields: Sequence[str], key: str | bytes) -> DataFrame:
    """Encrypt the configured columns that exist in ``df`` (others untouched)."""
    k = F.lit(key.encode() if isinstance(key, str) else key)
    return df.select(*[encrypt_column(qcol(c), k).alias(c) if c in fields else qcol(c) for c in df.columns])


def decrypt_fields(df: DataFrame, fields: Sequence[str], key: str | bytes) -> DataFrame:
    k = F.lit(key.encode() if isinstance(key, str) else key)
    return df.select(*[decrypt_column(qcol(c), k).alias(c) if c in fields else qcol(c) for c in df.columns])
