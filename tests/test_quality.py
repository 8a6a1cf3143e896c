"""Quality score golden values from the reference's unit tests."""

from pyspark.sql import functions as F

from intakeflow.operators.quality import quality_report


def report(spark, n, errors, nulls_b=0, required=()):
    rows = [(i, i < errors, None if i < nulls_b else "x") for i in range(n)]
    df = spark.createDataFrame(rows, "i int, bad boolean, b string").withColumn("_valid", ~F.col("bad"))
    return quality_report(df, [], required).first()


def test_clean_batch(spark):
    r = report(spark, 2, 0)
    assert r.quality_score == 100.0 and r.error_rate == 0.0 and r.valid_rows == 2


def test_half_errors(spark):
    r = report(spark, 100, 50)
    assert r.quality_score == 70.0 and r.error_rate == 0.5 and r.valid_rows == 50
    assert r.error_details == {"transform_errors": 50}


def test_half_errors_with_nulls(spark):
    r = report(spark, 100, 50, nulls_b=10, required=("b",))
    assert r.quality_score == 66.0 and r.null_rate == 0.1
    assert r.error_details == {"b": 10, "transform_errors": 50}


def test_all_bad(spark):
    assert report(spark, 10, 10).quality_score == 40.0


def test_empty(spark):
    df = spark.createDataFrame([], "i int, b string").withColumn("_valid", F.lit(True))
    r = quality_report(df, [], ()).first()
    assert r.total_rows == 0 and r.quality_score == 100.0 and r.error_details == {}


def test_absent_required_field_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1,), (2,)], "i int").withColumn("_valid", F.lit(True))
    r = quality_report(df, [], ("b",)).first()
    assert r.null_rate == 1.0 and r.quality_score == 60.0 and r.error_details == {"b": 2}
