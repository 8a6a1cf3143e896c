"""Cleaners (F4-F14, F16, U1-U5): ``DataFrame -> DataFrame`` functions and user-code adapters.

Built-in cleaners are native column expressions (one projection / filter,
whole-stage codegen).  User code runs through two adapters:

* ``apply_row_function`` (U1): ``fn(rows: list[dict]) -> list[dict | None]`` applied
  per Arrow batch with ``mapInPandas``; every output row is paired with its
  input by a row id, so omitted / rejected inputs come back as error rows
  carrying their true identity (G1).
* ``apply_frame_function`` (U2): ``fn(pandas.DataFrame) -> pandas.DataFrame`` applied to
  one *file* at a time with ``groupBy(file).applyInPandas``.  A file is the
  unit the user function is written for; files are size-capped upstream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.errors import FAIL, failure, time_limit
from intakeflow.functions.columns import (blank_name, clamp_int, normalize_date, parse_any_date,
                                          py_strip, qcol, status_token, text_fill, to_number)
from intakeflow.spec import DATE_KEYWORDS

VALID = "_valid"
ROW_ID = "_row_id"
REASON = "_error"


def _col_or_null(df: DataFrame, name: str) -> Column:
    return qcol(name) if name in df.columns else F.lit(None).cast("string")


# ---------------------------------------------------------------------------
# Composite "test_clean" (rows variant output shape, G19 decisions)
# ---------------------------------------------------------------------------
TEST_CLEAN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("date", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("score", T.IntegerType()),
])


def test_clean_flagged(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """U5 with a validity flag instead of a filter: F8 -> ``_valid``; F5, F4, F6, F7 projections."""
    name = _col_or_null(df, "name")
    return df.select(
        *[qcol(c) for c in keep],
        F.coalesce(_col_or_null(df, "id").cast("string"), F.lit("")).alias("id"),
        py_strip(name.cast("string")).alias("name"),
        to_number(_col_or_null(df, "value")).alias("value"),
        normalize_date(_col_or_null(df, "date")).alias("date"),
        status_token(_col_or_null(df, "status")).alias("status"),
        clamp_int(_col_or_null(df, "score")).alias("score"),
        (~blank_name(name)).alias(VALID),
        F.when(blank_name(name), F.lit("blank name")).alias(REASON),
    )


def test_clean(df: DataFrame) -> DataFrame:
    """Drop blank names; value -> number (bad -> 0); date -> YYYY-MM-DD or NULL;
    score clamped to 0..100 as int; status lower-cased with blanks -> 'unknown'."""
    return test_clean_flagged(df).filter(F.col(VALID)).drop(VALID, REASON)


# ---------------------------------------------------------------------------
# Fill and trim
# ---------------------------------------------------------------------------
def fillna_and_trim(df: DataFrame) -> DataFrame:
    """F9 drop all-NULL rows; F10 text: strip, NULL/nan/None/NaN -> ''; F11 numbers: NULL/NaN -> 0."""
    df = df.dropna(how="all")
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.StringType):
            out.append(text_fill(c).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.coalesce(F.nanvl(c, F.lit(None).cast(f.dataType)),
                                  F.lit(0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# ---------------------------------------------------------------------------
# exact duplicates
# ---------------------------------------------------------------------------
def deduplicate(df: DataFrame) -> DataFrame:
    """drop exact duplicate rows (all columns; a hash aggregate with map-side combine)."""
    return df.dropDuplicates()


# ---------------------------------------------------------------------------
# automatic date normalisation (two passes: one aggregate, one projection)
# ---------------------------------------------------------------------------
def date_candidates(df: DataFrame) -> list[str]:
    """Columns whose lower-cased name contains a date keyword and hold text or dates."""
    out = []
    for f in df.schema.fields:
        low = f.name.lower()
        if any(k in low for k in DATE_KEYWORDS) and isinstance(
                f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.append(f.name)
    return out


def normalize_dates(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """convert a candidate column to YYYY-MM-DD when more than ``min_share`` of rows parse."""
    cands = date_candidates(df)
    if not cands:
        return df
    shares = df.agg(*[
        (F.count_if(parse_any_date(qcol(c)).isNotNull()) / F.count(F.lit(1))).alias(f"s{i}")
        for i, c in enumerate(cands)]).first()  # one row, one value per candidate column
    convert = {c for i, c in enumerate(cands) if shares[f"s{i}"] is not None and shares[f"s{i}"] > min_share}
    return df.select(*[
        F.date_format(parse_any_date(qcol(c)), "yyyy-MM-dd").alias(c) if c in convert else qcol(c)
        for c in df.columns])


# ---------------------------------------------------------------------------
# F14, P13, F16
# ---------------------------------------------------------------------------
def trim_column_names(df: DataFrame) -> DataFrame:
    """strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def adults_only(df: DataFrame, column: str = "age", minimum: int = 18) -> DataFrame:
    """Keep rows with ``age >= 18`` when the column exists."""
    if column not in df.columns:
        return df
    return df.filter(to_number(qcol(column)) >= minimum)


def nan_to_null(df: DataFrame) -> DataFrame:
    """F16: NaN -> NULL in floating columns before output."""
    return df.select(*[
        F.nanvl(qcol(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else qcol(f.name)
        for f in df.schema.fields])


# ---------------------------------------------------------------------------
# Registry (name -> DataFrame function)
# ---------------------------------------------------------------------------
CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "deduplicate": deduplicate,
    "fillna_and_trim": fillna_and_trim,
    "normalize_dates": normalize_dates,
    "test_clean": test_clean,
}


def cleaner(name: str) -> Callable[[DataFrame], DataFrame]:
    try:
        return CLEANERS[name]
    except KeyError:
        raise KeyError(f"unknown cleaner {name!r}; known: {sorted(CLEANERS)}") from None


def list_cleaners() -> list[str]:
    return sorted(CLEANERS)


def run_cleaners(df: DataFrame, names: Iterable[str]) -> DataFrame:
    for n in names:
        df = df.transform(cleaner(n))
    return df


# ---------------------------------------------------------------------------
# Row-function adapter with row identity
# ---------------------------------------------------------------------------
class TransformContractError(RuntimeError):
    """U4: user code returned something other than a list of dicts / None."""


def _outputs(fn: Callable[[list[dict]], list], rows: list[dict], id_col: str, by_row: list[bool]) -> list:
    """``(input row or None, output dict)`` pairs of one call of the user function.

    Outputs that carry the id belong to that row.  Outputs without ids belong to the inputs in
    order when there are as many as inputs; otherwise the function is called once per row, for
    this and all later calls, so that omitted and split rows keep their identity.
    """
    def call(some: list[dict]) -> list:
        result = fn([dict(r) for r in some])
        if not isinstance(result, list):
            raise TransformContractError(f"transform must return a list, got {type(result).__name__}")
        for pos, r in enumerate(result):
            if r is not None and not isinstance(r, dict):
                raise TransformContractError(f"row {pos} is {type(r).__name__}, not a dict")
        return result

    if not by_row[0]:
        result = call(rows)
        by_id = {r[id_col]: r for r in rows}
        if all(r is None or r.get(id_col) in by_id for r in result) and any(r is not None for r in result):
            return [(by_id[r[id_col]], r) for r in result if r is not None]
        if len(result) == len(rows):
            return [(by_id.get(r.get(id_col), row), r) for row, r in zip(rows, result) if r is not None]
        if len(rows) == 1 or not result:
            return [(rows[0], r) for r in result if r is not None]
        by_row[0] = True
    return [(row, r) for row in rows for r in call([row]) if r is not None]


def apply_row_function(df: DataFrame, fn: Callable[[list[dict]], list], out_schema: T.StructType,
                       id_col: str = ROW_ID, keep: Iterable[str] = (), file_col: str = "_file",
                       errors: str = "raise", seconds: float | None = None) -> DataFrame:
    """Run ``fn(rows) -> rows`` per Arrow batch, never over rows of two files at once.

    ``df`` must carry a unique ``id_col``.  An output row keeps the input's id
    when ``fn`` passes it through (dict copy); outputs without ids pair with inputs
    by position when their number is the same, else ``fn`` is called row by row.
    Inputs without a surviving output are emitted with
    ``_valid = false`` and the input row as JSON in ``_error``.  ``keep`` columns
    are copied from the paired input row onto every output (identity, G1).
    Output columns: keep + ``out_schema`` + id_col + ``_valid`` + ``_error``, and ``_fail`` with
    ``errors="file"``: an error of the function then is a row that fails its file (T8) instead of an
    error that ends the task, so the other files go on in the same pass.  A call that takes
    more than ``seconds`` ends with a ``RetryableError``.
    """
    import json

    import pandas as pd

    if errors not in ("raise", "file"):
        raise ValueError("errors must be 'raise' or 'file'")
    keep = [k for k in keep]
    fields = [f.name for f in out_schema.fields]
    kept_fields = [df.schema[k] for k in keep]
    fail = [FAIL] if errors == "file" else []
    schema = T.StructType(kept_fields + list(out_schema.fields) + [
        T.StructField(id_col, T.LongType()), T.StructField(VALID, T.BooleanType()),
        T.StructField(REASON, T.StringType()), *(T.StructField(c, T.StringType()) for c in fail)])

    def limited(rows: list[dict]) -> list:
        with time_limit(seconds):
            return fn(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_row = [False]
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            files: dict = {}
            for r in rows:
                files.setdefault(r.get(file_col), []).append(r)
            sources, outs, fails, seen = [], [], [], set()  # of every output row
            for some in files.values():
                try:
                    pairs = _outputs(limited, some, id_col, by_row)
                except Exception as exc:  # noqa: BLE001 - user code
                    if not fail:
                        raise
                    sources.append(some[0])
                    outs.append({})
                    fails.append(failure(exc))
                    seen.update(r[id_col] for r in some)
                    continue
                sources += [src for src, _ in pairs]
                outs += [r for _, r in pairs]
                fails += [None] * len(pairs)
                seen.update(src[id_col] for src, _ in pairs)
            bad = [r for r in rows if r[id_col] not in seen]
            valid = [f is None for f in fails] + [False] * len(bad)
            reasons = [None] * len(sources) + [json.dumps({k: v for k, v in r.items() if k != id_col}, default=str) for r in bad]
            sources += bad
            outs += [{}] * len(bad)
            made = {id_col: lambda: [r[id_col] for r in sources], VALID: lambda: valid, REASON: lambda: reasons,
                    **{c: lambda: fails + [None] * len(bad) for c in fail}}

            def column(c):
                if c in made:
                    return made[c]()
                return [r.get(c) for r in (outs if c in fields else sources)]

            yield pd.DataFrame({c: pd.Series(column(c), dtype=object) for c in schema.fieldNames()})

    return df.mapInPandas(run, schema)


def apply_frame_function(df: DataFrame, fn: Callable, out_schema: T.StructType,
                         file_col: str = "_file") -> DataFrame:
    """``fn(pandas.DataFrame) -> pandas.DataFrame`` per file (``groupBy(file).applyInPandas``).

    The contract hands the function a whole file, so a file goes to one Python worker; use native
    cleaners or the row adapter, which stream, where files are large.  A result that is no
    DataFrame is turned into one where pandas can (a list of dicts, a dict of lists; U4).  When
    ``out_schema`` holds ``_valid`` and ``_error``, a file whose function fails comes out as one
    row with ``_valid = false`` and the error, and the other files are unaffected; without
    these columns the error fails the job.
    """
    import pandas as pd

    names = out_schema.fieldNames()
    flagged = VALID in names and REASON in names

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        res = fn(pdf.drop(columns=[file_col]).reset_index(drop=True))
        if not isinstance(res, pd.DataFrame):
            if res is None or isinstance(res, (str, bytes)):
                raise TransformContractError(f"clean_data must return a DataFrame, got {type(res).__name__}")
            try:
                res = pd.DataFrame(res)
            except Exception as exc:
                raise TransformContractError(
                    f"clean_data must return a DataFrame, got {type(res).__name__}") from exc
        return res.copy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            res = call(pdf)
        except Exception as exc:  # noqa: BLE001 - user code
            if not flagged:
                raise
            res = pd.DataFrame({VALID: [False], REASON: [f"{type(exc).__name__}: {exc}"]})
        else:
            if flagged and VALID not in res.columns:
                res[VALID] = True
        res[file_col] = pdf[file_col].iloc[0] if len(pdf) else None
        for c in names:
            if c not in res.columns:
                res[c] = None
        return res[names]

    return df.groupBy(file_col).applyInPandas(run, out_schema)
