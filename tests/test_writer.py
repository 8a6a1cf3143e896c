"""First-wins writes (K2), replay safety (T7), column union."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from intakeflow.operators.route import route_months
from intakeflow.operators.writer import align_columns, plan_first_wins, write_first_wins
from intakeflow.spec import TaskSpec

SPEC = TaskSpec(task_id="t", base_table="smoke", keys=("id",), partition_field="date")
AS_OF = dt.datetime(2026, 1, 15)


def rows(spark, data):
    df = spark.createDataFrame(data, "id long, name string, date string, _row long")
    return route_months(df, SPEC, AS_OF)


def test_ignore_count(spark, tmpdir_path):
    target = f"{tmpdir_path}/target"
    first = rows(spark, [(1, "a", "2026-01-02", 0), (2, "b", "2026-01-03", 1)])
    c1 = write_first_wins(first, target, ["id"], ["_row"])
    assert c1["inserted"] == 2
    second = rows(spark, [(i, f"n{i}", "2026-01-05", i) for i in range(1, 6)])
    c2 = write_first_wins(second, target, ["id"], ["_row"])
    assert (c2["received"], c2["inserted"], c2["ignored"]) == (5, 3, 2)
    # replay of the same delivery: nothing new
    c3 = write_first_wins(second, target, ["id"], ["_row"])
    assert c3["inserted"] == 0 and c3["ignored"] == 5
    stored = spark.read.parquet(target).filter(F.col("id") == 1).first()
    assert stored.name == "a"  # first wins


def test_within_batch_first_and_months(spark):
    df = rows(spark, [(1, "late", "2026-01-02", 5), (1, "early", "2026-01-03", 1), (1, "feb", "2026-02-01", 9),
                      (None, "x", "2026-01-01", 2), (None, "y", "2026-01-01", 3)])
    got = {(r.month, r.id, r.name) for r in plan_first_wins(df, None, ["id"], ["_row"]).collect()}
    # uniqueness is per month table; NULL keys never collide
    assert got == {("202601", 1, "early"), ("202602", 1, "feb"), ("202601", None, "x"), ("202601", None, "y")}


def test_archived_month_rejected(spark, tmpdir_path):
    target = f"{tmpdir_path}/target"
    df = rows(spark, [(1, "a", "2025-01-02", 0), (2, "b", "2026-01-03", 1)])
    c = write_first_wins(df, target, ["id"], ["_row"], archived_months=["202501"])
    assert c["inserted"] == 1 and c["rejected_archived"] == 1
    held = spark.read.parquet(f"{target}_quarantine").collect()
    assert [(r.id, r.name, str(r.month), r.quarantine_reason) for r in held] == [(1, "a", "202501", "archived_month")]


def test_first_wins_reads_its_input_once(spark, tmpdir_path):
    df = rows(spark, [(i % 7, f"n{i}", "2026-01-02", i) for i in range(50)] + [(None, "x", "2026-01-02", 60)] * 2)
    src = f"{tmpdir_path}/src"
    df.write.parquet(src)
    plan = plan_first_wins(spark.read.parquet(src), None, ["id"], ["_row"])
    assert plan.count() == 9
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_key_union(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3, 4)], "b int, c int")
    c = spark.createDataFrame([(5,)], "a int")
    out = align_columns([a, b, c])
    assert out.columns == ["a", "b", "c"]
    assert [tuple(r) for r in out.collect()] == [(1, 2, None), (None, 3, 4), (5, None, None)]


def test_conform_smoke_target(spark):
    from pyspark.sql import types as T

    from intakeflow.operators.conform import conform_to_target
    # smoke_target template: id BIGINT key, name, value DOUBLE, date DATE, status, score INT, processed_at TIMESTAMP
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("date", T.DateType()),
                           T.StructField("status", T.StringType()), T.StructField("score", T.IntegerType()),
                           T.StructField("processed_at", T.TimestampType())])
    df = spark.createDataFrame([("1", "a", "2.5", "2026-01-02", "ok", "7", "x", "f"),
                                ("x", "b", "oops", "2026-01-03", "ok", "8", "y", "f")],
                               "id string, name string, value string, date string, status string, score string, "
                               "extra string, _file string")
    out = conform_to_target(df, target, keep=("_file",))
    assert out.columns == target.fieldNames() + ["_file", "_valid", "_error"]
    rows = {r.name: r for r in out.collect()}
    assert rows["a"]._valid and rows["a"].id == 1 and rows["a"].value == 2.5 and rows["a"].processed_at is None
    assert not rows["b"]._valid and rows["b"]._error == "cast failed: id, value"


def test_conform_odd_names_no_key(spark, tmpdir_path):
    from pyspark.sql import types as T

    from intakeflow.operators.conform import conform_to_target
    # cfd_target: odd column names, no business key -> plain append, every delivery kept
    target = T.StructType([T.StructField("U:0", T.DoubleType()), T.StructField("alpha.water", T.DoubleType()),
                           T.StructField("vtkValidPointMask", T.ByteType())])
    df = spark.createDataFrame([("0.5", "1", "1", "2026-01-02", 0)],
                               "`U:0` string, `alpha.water` string, vtkValidPointMask string, date string, _row long")
    routed = route_months(df, TaskSpec(task_id="c", base_table="cfd", partition_field="date"), AS_OF)
    conformed = conform_to_target(routed, target, keep=("month", "_row"))
    body = conformed.filter("_valid").drop("_valid", "_error")
    target_path = f"{tmpdir_path}/cfd"
    for _ in range(2):
        c = write_first_wins(body, target_path, [], ["_row"])
        assert c["inserted"] == 1
    stored = spark.read.parquet(target_path)
    assert stored.count() == 2 and stored.select("`alpha.water`").first()[0] == 1.0


def test_first_wins_odd_column_names(spark, tmpdir_path):
    df = spark.createDataFrame([("k1", 1.0, "2026-01-02", 2), ("k1", 2.0, "2026-01-03", 1), ("k2", 3.0, "2026-01-04", 0)],
                               "`U:0` string, `alpha.water` double, date string, _row long")
    routed = route_months(df, TaskSpec(task_id="c", base_table="cfd", partition_field="date"), AS_OF)
    target = f"{tmpdir_path}/odd"
    c1 = write_first_wins(routed, target, ["U:0"], ["_row"])
    c2 = write_first_wins(routed, target, ["U:0"], ["_row"])
    assert (c1["inserted"], c2["inserted"]) == (2, 0)
    got = {r[0]: r[1] for r in spark.read.parquet(target).select("`U:0`", "`alpha.water`").collect()}
    assert got == {"k1": 2.0, "k2": 3.0}


def test_drifting_deliveries_read_back_merged(spark, tmpdir_path):
    from intakeflow.streaming.intake import read_target
    target = f"{tmpdir_path}/drift"
    a = rows(spark, [(1, "a", "2026-01-02", 0)])
    b = route_months(spark.createDataFrame([(2, "b", "2026-01-03", 1, "extra")],
                                           "id long, name string, date string, _row long, note string"), SPEC, AS_OF)
    write_first_wins(a, target, ["id"], ["_row"])
    write_first_wins(b, target, ["id"], ["_row"])
    got = {r.id: r.note for r in read_target(spark, target).collect()}
    assert got == {1: None, 2: "extra"}


def _batches(spark):
    """Three batches with keys that come again, in one batch and in others, and NULL keys."""
    def one(b):
        return spark.range(400).select(
            F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise((F.col("id") * 7 + b * 300) % 1000).alias("k"),
            F.when(F.col("id") % 3 == 0, "200101").otherwise("200102").alias("month"),
            F.concat(F.lit(f"{b}-"), F.col("id").cast("string")).alias("v"), F.lit(b).alias("b"), F.col("id").alias("row"))
    return [one(b).unionByName(one(b).where("id % 20 = 0").withColumn("row", F.col("row") + 1000)) for b in range(3)]


def _stored(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("k", F.col("month").cast("string"), "v", "b", "row").collect()),
                  key=str)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_key_index_stores_what_the_target_itself_would(spark, tmp_path, monkeypatch, most):
    from intakeflow.operators import writer

    monkeypatch.setattr(writer, "MOST_CONTESTED", most)
    got = {}
    for cached in (False, True):
        path = f"{tmp_path}/{cached}"
        got[cached] = [writer.write_first_wins(b, path, ["k"], ["b", "row"], cached=cached) for b in _batches(spark)]
        # a batch that comes again adds its NULL keys only
        again = writer.write_first_wins(_batches(spark)[1].where("k is not null"), path, ["k"], ["b", "row"], cached=cached)
        assert again["inserted"] == 0
    assert got[False] == got[True]
    assert _stored(spark, f"{tmp_path}/False") == _stored(spark, f"{tmp_path}/True")


def test_key_index_is_not_believed_against_the_target(spark, tmp_path):
    from intakeflow.operators import writer
    from intakeflow.session import write_note

    path = f"{tmp_path}/t"
    first, second, _ = _batches(spark)
    write = lambda df: writer.write_first_wins(df, path, ["k"], ["b", "row"], cached=True)
    n = write(first)["inserted"]
    assert n > 0
    # a batch that ended between its keys and its rows
    keyed = second.where("k is not null")
    keyed.select(writer._key_hash(["month", "k"]), "month", "k").write.mode("append").parquet(path + "_keys")
    write_note(spark, path + "_keys/_state", "a batch is written")
    plain = writer.plan_first_wins(second, spark.read.parquet(path).withColumn("month", F.col("month").cast("string")),
                                   ["k"], ["b", "row"]).count()
    assert write(second)["inserted"] == plain > 0
    # rows written past the index: it is not used again
    other = second.limit(0).unionByName(first.where("row = 5").withColumn("k", F.lit(5000).cast("long")))
    writer.write_first_wins(other, path, ["k"], ["b", "row"])
    assert write(other)["inserted"] == 0


def test_target_is_not_listed_where_the_index_stands_for_it(spark, tmp_path, monkeypatch):
    """a target has a file a month and batch; a batch need not list them all to find the keys it holds."""
    from intakeflow.operators import writer

    path, got, read = f"{tmp_path}/t", [], writer.read_target
    for n, df in enumerate(_batches(spark)):
        if n:
            monkeypatch.setattr(writer, "read_target", lambda *a: pytest.fail("the target was read"))
        cached = df.persist()
        got.append(writer.write_first_wins(cached, path, ["k"], ["b", "row"], cached=True))
        cached.unpersist()
    monkeypatch.setattr(writer, "read_target", read)
    plain = [writer.write_first_wins(b, f"{tmp_path}/p", ["k"], ["b", "row"]) for b in _batches(spark)]
    assert got == plain and _stored(spark, path) == _stored(spark, f"{tmp_path}/p")


def test_rows_without_contested_keys_are_not_compared(spark, tmp_path):
    from intakeflow.operators import writer

    df = _batches(spark)[0].where("row < 1000 and k is not null").persist()
    path = f"{tmp_path}/t"
    index = writer.key_index(spark, path, df, None, ["k"])
    assert writer.contested_keys(df, index, ["k"], 400) == (None, 0)
    writer.write_first_wins(df, path, ["k"], ["b", "row"], cached=True)
    found, many = writer.contested_keys(df.where("row < 10"), index, ["k"], 10)
    assert many == df.where("row < 10").count() == found.count()
    df.unpersist()


def test_large_deliveries_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    from intakeflow.plans import q_sources

    monkeypatch.setattr(q_sources, "CSV_ROWS_PER_FILE", 100)
    spark.range(1050).selectExpr("id", "cast(id as string) as name").write.parquet(f"{tmp_path}/x.parquet")
    out = q_sources.write_csv_deliveries(spark, str(tmp_path), "x", even=False)
    per = spark.read.option("header", True).csv(out).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in per) == 1050 and max(r["count"] for r in per) <= 100
