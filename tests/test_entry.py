"""Driver contract: entry() runs; every oracle belongs to a registered query; names are clean."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["month", "year_month", "table_name", "row_count"]
    total = [r.row_count for r in rows if r.month is None]
    assert total and total[0] == sum(r.row_count for r in rows if r.month is not None)


def test_catalogue_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40
    for name, fn in q.items():
        assert fn.__doc__, name


def test_extra_cleaners(spark):
    from pyspark.sql import functions as F

    from intakeflow.operators.cleaners import adults_only, nan_to_null, trim_column_names
    df = spark.createDataFrame([(" a ", 17.0, float("nan")), ("b", 30.0, 1.0)], "` x ` string, age double, v double")
    df = trim_column_names(df)
    assert df.columns == ["x", "age", "v"]
    assert [r.x for r in adults_only(df).collect()] == ["b"]
    assert nan_to_null(df).filter(F.col("v").isNull()).count() == 1


def test_frame_function_per_file(spark):
    import pytest

    from intakeflow.operators.cleaners import apply_frame_function
    df = spark.createDataFrame([("f1", i) for i in range(30)] + [("f2", 1)], "_file string, v int")
    assert apply_frame_function(df, lambda p: p[p.v % 2 == 1], df.schema).count() == 16
    # a list of dicts is turned into a frame (U4); text is not
    assert apply_frame_function(df, lambda p: p.to_dict("records"), df.schema).count() == 31
    with pytest.raises(Exception, match="must return a DataFrame"):
        apply_frame_function(df, lambda p: "nope", df.schema).collect()

    def fails(p):
        if len(p) > 1:
            raise ValueError("bad file")
        return p

    out = apply_frame_function(df, fails, _flagged(df.schema)).collect()
    assert sorted((r._file, r.v, r._valid, r._error) for r in out if r._valid) == [("f2", 1, True, None)]
    assert [(r._file, r._error) for r in out if not r._valid] == [("f1", "ValueError: bad file")]


def _flagged(schema):
    from pyspark.sql import types as T
    return T.StructType([*schema.fields, T.StructField("_valid", T.BooleanType()), T.StructField("_error", T.StringType())])


def test_row_function_identity_over_files(spark):
    from pyspark.sql import types as T

    from intakeflow.operators.cleaners import apply_row_function
    df = spark.createDataFrame([(i, f"file{i % 3}", f"v{i}") for i in range(12)],
                               "_row_id long, _file string, val string").coalesce(1)
    schema = T.StructType([T.StructField("up", T.StringType())])

    def omits(rows):  # new dicts without an id, some rows left out
        return [{"up": r["val"].upper()} for r in rows if int(r["val"][1:]) % 4]

    out = {r._row_id: (r._file, r.up, r._valid) for r in apply_row_function(df, omits, schema, keep=["_file"]).collect()}
    assert out == {i: (f"file{i % 3}", f"V{i}" if i % 4 else None, bool(i % 4)) for i in range(12)}

    def splits(rows):
        return [{"up": r["val"] + x} for r in rows for x in "ab"]

    got = sorted((r._row_id, r._file, r.up) for r in apply_row_function(df, splits, schema, keep=["_file"]).collect())
    assert got == sorted((i, f"file{i % 3}", f"v{i}{x}") for i in range(12) for x in "ab")


def test_row_function_contract(spark):
    import pytest
    from pyspark.sql import types as T

    from intakeflow.operators.cleaners import apply_row_function
    df = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "_row_id long, val string").coalesce(1)
    schema = T.StructType([T.StructField("up", T.StringType())])

    def positional(rows):  # new dicts without the id: paired by position; None rejects
        return [None if r["_row_id"] % 3 == 0 else {"up": r["val"].upper()} for r in rows]

    out = {r._row_id: (r.up, r._valid) for r in apply_row_function(df, positional, schema).collect()}
    assert out == {0: (None, False), 1: ("V1", True), 2: ("V2", True), 3: (None, False), 4: ("V4", True),
                   5: ("V5", True)}
    with pytest.raises(Exception, match="must return a list"):
        apply_row_function(df, lambda rows: "nope", schema).collect()
    with pytest.raises(Exception, match="not a dict"):
        apply_row_function(df, lambda rows: [1 for _ in rows], schema).collect()


def test_date_candidates_and_normaliser(spark):
    from intakeflow.operators.cleaners import date_candidates, normalize_dates
    df = spark.createDataFrame([(1, "2024-01-05 10:00:00", "2024/2/3", "x", "日期?"),
                                (2, "2024-01-06", "bad", "y", "z")],
                               "counts int, update_ts string, `Ship Date` string, note string, `日期` string")
    # 'counts' holds 'ts' but is numeric (G7); '日期' matches the keyword but half its values do not parse
    assert date_candidates(df) == ["update_ts", "Ship Date", "日期"]
    out = normalize_dates(df).collect()
    assert [r.update_ts for r in out] == ["2024-01-05", "2024-01-06"]
    assert [r["Ship Date"] for r in out] == ["2024/2/3", "bad"]  # exactly half parse: not > 0.5
    assert [r.counts for r in out] == [1, 2]
