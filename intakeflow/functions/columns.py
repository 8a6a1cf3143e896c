"""Scalar column expressions (F1-F18, P9-P11).  All JVM-side, codegen friendly."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.spec import (CLAIM_LEASE_SECONDS, NULL_TOKENS_EXACT, NULL_TOKENS_LOWER,
                             QUALITY_BAND_FAIR, QUALITY_BAND_GOOD, UNKNOWN_STATUS, month_of,
                             strptime_to_spark)

# Python's str.strip() removes every character for which str.isspace() holds; Spark's
# one-argument trim() removes only U+0020, so the full set is passed (derived, not listed).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def qcol(name: str) -> Column:
    """reference a column whose name may hold ``.``, ``:`` or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` semantics."""
    return F.trim(c, F.lit(PY_WHITESPACE))


# %z in text: +0800, +08:00, +08:00:30 or Z (fixed by strptime)
_OFFSET = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2}(\.\d+)?)?)"


def parse_with(c: Column, fmt: str) -> Column:
    """``datetime.strptime(str(v), fmt)`` or NULL when the text does not fully match.

    The wall clock of the text counts: with ``%z`` the offset must be there and is then left
    out of account.  ``%y`` follows strptime's pivot (69-99 are 19xx).
    """
    text = c.cast("string")
    if "%z" in fmt:
        if not fmt.endswith("%z"):
            raise ValueError(f"%z is supported at the end of a format only, not in {fmt!r}")
        text = F.when(text.rlike(_OFFSET + "$"), F.regexp_replace(text, _OFFSET + "$", ""))
        fmt = fmt[:-2]
    parsed = F.try_to_timestamp(text, F.lit(strptime_to_spark(fmt)))
    if "%y" in fmt:
        parsed = F.when(F.year(parsed) >= 2069, parsed - F.make_ym_interval(F.lit(100))).otherwise(parsed)
    return parsed


def month_suffix(c: Column, dtype: T.DataType, fmt: str,
                 as_of: _dt.datetime | _dt.date) -> tuple[Column, Column]:
    """``YYYYMM`` of the partition field, and a flag set when the as_of month was used.

    Text values are parsed with ``fmt``; date/timestamp values are used directly.
    Missing, empty or unparsable values fall back to the month of ``as_of``.
    """
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        parsed = c
    elif isinstance(dtype, T.StringType):
        parsed = F.when(c != "", parse_with(c, fmt))
    else:  # numbers etc.: str(v) then strptime; 0 is falsy and falls back
        parsed = F.when(c.cast("string") != "0", parse_with(c, fmt))
    suffix = F.date_format(parsed, "yyyyMM")
    return F.coalesce(suffix, F.lit(month_of(as_of))), suffix.isNull()


def year_month(suffix: Column) -> Column:
    """``YYYYMM`` -> ``YYYY-MM``."""
    return F.concat(F.substring(suffix, 1, 4), F.lit("-"), F.substring(suffix, 5, 2))


def table_name(base: str, suffix: Column) -> Column:
    """F2 (display): ``base_YYYYMM``."""
    return F.concat(F.lit(base + "_"), suffix)


def normalize_date(c: Column) -> Column:
    """first 10 characters must parse as ``%Y-%m-%d``; result ``YYYY-MM-DD`` or NULL."""
    parsed = F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-M-d"))
    return F.date_format(parsed, "yyyy-MM-dd")


# Accepted layouts for the automatic date normaliser (F13), tried in order.
AUTO_DATE_PATTERNS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
                      "yyyy/M/d H:m:s", "yyyy/M/d")


def parse_any_date(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in AUTO_DATE_PATTERNS])


def to_number(c: Column) -> Column:
    """numeric coerce; unparsable, NULL and NaN -> 0.0 (infinity kept).

    Java's number suffixes (``5D``, ``7f``) are not numbers here.
    """
    text = py_strip(c.cast("string"))
    x = F.when(~text.rlike("(?i)[0-9.][df]$"), text.try_cast("double"))
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def clamp_int(c: Column, lo: int = 0, hi: int = 100) -> Column:
    """number clamped to lo..hi and truncated to int; bad -> 0 (infinity clamps)."""
    x = to_number(c)
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))).cast("int")


def status_token(c: Column, unknown: str = UNKNOWN_STATUS) -> Column:
    """``str(v).lower().strip()``; '', 'none', 'nan' -> unknown (NULL reads as 'None')."""
    s = py_strip(F.lower(F.coalesce(c.cast("string"), F.lit("None"))))
    return F.when(s.isin(*NULL_TOKENS_LOWER), F.lit(unknown)).otherwise(s)


def blank_name(c: Column) -> Column:
    """F8 predicate: NULL, blank after strip, or the literal text 'None'."""
    s = c.cast("string")
    return s.isNull() | (py_strip(s) == "") | (s == "None")


def text_fill(c: Column) -> Column:
    """strip; NULL and the tokens nan/None/NaN -> ''."""
    s = py_strip(F.coalesce(c.cast("string"), F.lit("None")))
    return F.when(s.isin(*NULL_TOKENS_EXACT), F.lit("")).otherwise(s)


def quality_band(score: Column) -> Column:
    """>= 90 good, >= 70 fair, else attention."""
    return (F.when(score >= QUALITY_BAND_GOOD, F.lit("good"))
            .when(score >= QUALITY_BAND_FAIR, F.lit("fair")).otherwise(F.lit("attention")))


def base_name(path: Column) -> Column:
    """Last path element."""
    return F.element_at(F.split(path, "/"), -1)


def file_id(*key: str) -> Column:
    """Non-negative 63-bit id of a file version, the same in the ledger and the quality log."""
    return F.xxhash64(*[F.col(k) for k in key]).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def lease_expiry(as_of: Column, seconds: int = CLAIM_LEASE_SECONDS) -> Column:
    """as_of + lease."""
    return as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def display_time(processed_at: Column, created_at: Column) -> Column:
    """``processed_at or created_at``."""
    return F.coalesce(processed_at, created_at)


def avg_half_up(c: Column, decimals_in: int, places: int) -> Column:
    """``ROUND(AVG(c), places)`` computed exactly, as a decimal engine would.

    ``c`` holds non-negative fixed-point values with ``decimals_in`` decimals
    (e.g. scores stored as DECIMAL(5,2), or integer milliseconds).  The sum is
    taken over scaled integers and divided with HALF_UP in integer arithmetic,
    so no binary-float tie can round differently between engines.
    """
    if places < decimals_in:
        raise ValueError("places must be >= decimals_in")
    scaled = F.round(c * F.lit(10 ** decimals_in)).cast("bigint")
    s = F.sum(scaled) * F.lit(10 ** (places - decimals_in))
    n = F.count(c)
    q = (F.lit(2) * s + n).cast("bigint")
    units = F.when(n > 0, F.call_function("div", q, (F.lit(2) * n).cast("bigint")))  # whole numbers throughout
    return (units / F.lit(10 ** places)).cast("double")


def avg_half_up_sql(expr: str, decimals_in: int, places: int) -> str:
    """DuckDB twin of ``avg_half_up``."""
    s = f"sum(CAST(round(({expr}) * {10 ** decimals_in}) AS BIGINT)) * {10 ** (places - decimals_in)}"
    n = f"count({expr})"
    return (f"CAST(CASE WHEN {n} > 0 THEN ((2 * {s} + {n}) // (2 * {n})) END AS DOUBLE) "
            f"/ {10 ** places}")


def ts_lit(value: _dt.datetime | _dt.date) -> Column:
    """A wall-clock ``TIMESTAMP_NTZ`` literal, independent of the driver's and the session's zone.

    (``F.lit(datetime)`` goes through the driver process's local zone into a zoned
    timestamp; the data's timestamps are zone-less.)
    """
    if not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
