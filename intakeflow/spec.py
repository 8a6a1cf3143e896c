"""Task parameters (data fields only) and fixed values shared with the reference behaviour."""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results)
# ---------------------------------------------------------------------------
# Ledger status values.
STATUSES = ("PENDING", "CLAIMED", "PROCESSING", "SUCCESS", "FAILED", "SKIPPED")
# Statuses counted as "pending" in task statistics.
PENDING_STATES = ("PENDING", "CLAIMED", "PROCESSING")
# Month-table lifecycle values.
LIFECYCLE = ("ACTIVE", "ARCHIVED", "DROPPED")
# Accepted file extensions, matched lower-cased, and the reader each one selects.
EXTENSIONS = (".csv", ".json", ".xlsx", ".xls")
FORMATS = {".csv": "csv", ".json": "json", ".xlsx": "excel", ".xls": "excel"}
# Table-name rule: lowercase letters, digits, underscore; starts with a letter; at most 64 chars.
TABLE_NAME_PATTERN = r"^[a-z][a-z0-9_]*$"
TABLE_NAME_MAX_LEN = 64
# Claim lease in seconds.
CLAIM_LEASE_SECONDS = 600
# Retry back-off in seconds for attempts 1, 2, 3.
RETRY_BACKOFF_SECONDS = (5, 30, 120)
# Circuit breaker: failures to open, seconds before a half-open probe.
BREAKER_FAILURE_THRESHOLD = 5
BREAKER_RECOVERY_SECONDS = 60
# Quality score weights, minimum score before an alert, quality bands.
QUALITY_ERROR_WEIGHT = 60.0
QUALITY_NULL_WEIGHT = 40.0
QUALITY_ALERT_MIN_SCORE = 80.0
QUALITY_BAND_GOOD = 90.0
QUALITY_BAND_FAIR = 70.0
# Column-name keywords that mark a date column for the date normaliser.
DATE_KEYWORDS = ("date", "time", "日期", "时间", "dt", "ts")
# Status given to blank values by the composite cleaner.
UNKNOWN_STATUS = "unknown"
# Values treated as "no value" by the text cleaners.
NULL_TOKENS_LOWER = ("", "none", "nan")
NULL_TOKENS_EXACT = ("nan", "None", "NaN")
# Page defaults.
PAGE_SIZE_DEFAULT = 50
PAGE_SIZE_MAX = 200
RECENT_FILES = 10
REGISTRY_LIMIT = 200
AUDIT_EXPORT_LIMIT = 10000
ERROR_TEXT_CHARS = 300
PREVIEW_ROWS = 50
# Report windows in days: (default, min, max).
STATS_DAYS = (7, 1, 90)
TREND_DAYS = (30, 1, 90)
# Fingerprint sample size in bytes.
FINGERPRINT_SAMPLE = 4096
# Charset sniffing: bytes sampled from the head and the middle.


@dataclass(frozen=True)
class TaskSpec:
    task_id: str
    base_table: str
    keys: tuple[str, ...] = ()
    partition_field: str | None = None
    partition_format: str = "%Y-%m-%d"
    required_fields: tuple[str, ...] = ()
    retention_months: int = 0
    max_retries: int = 3
    extensions: tuple[str, ...] = (".csv",)
    encoding: str | None = None
    json_path: str | None = None
    priority: int = 5
    on_row_error: str = "skip"  # "skip" or "abort"
    encrypt_fields: tuple[str, ...] = field(default_factory=tuple)
    retry_backoff: tuple[int, ...] = RETRY_BACKOFF_SECONDS
    debounce_seconds: float = 3.0
    stability_check_count: int = 3
    compress_after_days: int = 7
    cleanup_after_days: int = 90

    def __post_init__(self):
        check_table_name(self.base_table)
        if self.on_row_error not in ("skip", "abort"):
            raise ValueError("on_row_error must be 'skip' or 'abort'")


def check_table_name(name: str) -> str:
    """reject names that are not plain lowercase identifiers."""
    if name != name.strip():
        raise ValueError(f"invalid table name {name!r}: outer blanks")
    if len(name) > TABLE_NAME_MAX_LEN:
        raise ValueError(f"invalid table name {name!r}: longer than {TABLE_NAME_MAX_LEN}")
    if not re.fullmatch(TABLE_NAME_PATTERN, name):
        raise ValueError(f"invalid table name {name!r}: must match {TABLE_NAME_PATTERN}")
    return name


def clamp_days(value, default_min_max: tuple[int, int, int]) -> int:
    """Clamp a day window, junk -> default."""
    default, lo, hi = default_min_max
    try:
        n = int(value)
    except (TypeError, ValueError):
        n = default
    return min(hi, max(lo, n))


def page_args(page, size) -> tuple[int, int]:
    """O1: page >= 1; size defaults to 50 and is clamped to 1..200; junk -> default."""
    try:
        p = max(1, int(page))
    except (TypeError, ValueError):
        p = 1
    try:
        s = min(PAGE_SIZE_MAX, max(1, int(size)))
    except (TypeError, ValueError):
        s = PAGE_SIZE_DEFAULT
    return p, s


def strptime_to_spark(fmt: str) -> str:
    """Translate a Python strptime format to a Spark datetime pattern.

    Python's %m/%d/%H/%M/%S accept one or two digits, so the lenient
    single-letter Spark fields are used for them - except where two fields
    touch (``%Y%m%d``), where Python reads two digits and so do we.
    """
    lenient = {"%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}
    fixed = {"%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}
    other = {"%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%j": "D",
             "%I": "h", "%p": "a"}
    tokens, i = [], 0
    while i < len(fmt):
        two = fmt[i:i + 2]
        if two == "%%":
            tokens.append(("lit", "%"))
            i += 2
        elif two in lenient or two in other:
            tokens.append(("dir", two))
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unsupported directive {two!r} in date format {fmt!r}")
        else:
            tokens.append(("lit", fmt[i]))
            i += 1
    out = []
    for j, (kind, val) in enumerate(tokens):
        if kind == "dir":
            touching = (j > 0 and tokens[j - 1][0] == "dir") or (j + 1 < len(tokens) and tokens[j + 1][0] == "dir")
            if val in lenient:
                out.append(fixed[val] if touching else lenient[val])
            else:
                out.append(other[val])
        elif val.isalpha():
            out.append(f"'{val}'")
        elif val == "'":
            out.append("''")
        else:
            out.append(val)
    return "".join(out)


def month_of(as_of: _dt.datetime | _dt.date) -> str:
    return f"{as_of.year:04d}{as_of.month:02d}"
