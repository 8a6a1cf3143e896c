"""Structured Streaming: file intake (T1-T3, T6-T8) and stream = batch parity."""

import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.operators import cleaners as C
from intakeflow.operators.ledger import fold
from intakeflow.operators.sequence import breaker_replay, stability_runs
from intakeflow.sources.fixtures import file_event_rows, outcome_rows
from intakeflow.spec import TaskSpec
from intakeflow.streaming.intake import IntakePaths, read_target, start_intake
from intakeflow.streaming.stateful import breaker_stream, debounce_stream, stability_stream
from intakeflow.operators.sequence import debounce_sessions

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2026, 3, 1)


def _csv(path, header, rows):
    with open(path, "w", newline="") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def _paths(base):
    return IntakePaths(*(f"{base}/{n}" for n in ("target", "ledger", "quality", "alerts", "ckpt")))


def test_intake_stream_first_wins_and_redelivery(spark, tmpdir_path):
    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    header = ["id", "name", "value", "date", "status", "score"]
    _csv(f"{inbox}/a.csv", header, [(1, "ann", "1.5", "2026-01-02", "OK", 50), (2, "", "x", "2026-01-03", "", 5),
                                    (3, "cy", "", "2026-02-01", "None", 150)])
    _csv(f"{inbox}/b.csv", header, [(1, "dup", "9", "2026-01-09", "ok", 1), (4, "dee", "4", "bad", "new", 4)])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    spec = TaskSpec(task_id="smoke", base_table="smoke", keys=("id",), partition_field="date",
                    required_fields=("value",))

    def flag(df):
        return C.test_clean_flagged(df, keep=[c for c in df.columns if c.startswith("_") or c == "task_id"])

    paths = _paths(f"{tmpdir_path}/run1")
    q = start_intake(spark, inbox, spec, schema, paths, flag=flag, available_now=True, max_files_per_trigger=1,
                     as_of=lambda: AS_OF)
    q.awaitTermination(120)
    assert q.exception() is None
    target = read_target(spark, paths.target)
    got = {(r.month, r.id): r.name for r in target.collect()}
    # row 2 has a blank name (error row); id 1 arrives first in a.csv (first file batch)
    assert got == {("202601", "1"): "ann", ("202602", "3"): "cy", ("202603", "4"): "dee"}
    cur = {os.path.basename(r.file_path): r for r in fold(spark.read.parquet(paths.ledger)).collect()}
    assert {k: (v.status, v.row_count, v.valid_row_count) for k, v in cur.items()} == {
        "a.csv": ("SUCCESS", 3, 2), "b.csv": ("SUCCESS", 2, 2)}
    qrows = spark.read.parquet(paths.quality).collect()
    qual = {os.path.basename(r.file_path): r.quality_score for r in qrows}
    assert qual["a.csv"] < 100.0 and qual["b.csv"] == 100.0
    # redelivery through a fresh checkpoint: the ledger says SUCCESS, nothing is loaded again
    again = IntakePaths(paths.target, paths.ledger, paths.quality, paths.alerts, f"{tmpdir_path}/ckpt2")
    q2 = start_intake(spark, inbox, spec, schema, again, flag=flag, available_now=True, as_of=lambda: AS_OF)
    q2.awaitTermination(120)
    assert read_target(spark, paths.target).count() == 3


def _stream_of(spark, df, base):
    src = f"{base}/src"
    df.write.parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(src)


def _run_to_table(stream, base, mode="append"):
    out = f"{base}/out"
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck")
         .outputMode(mode).trigger(availableNow=True).start(out))
    q.awaitTermination(180)
    assert q.exception() is None
    return out


def test_breaker_stream_equals_batch(spark, tmpdir_path):
    oc = outcome_rows(spark, SF).repartition(4)
    out = _run_to_table(breaker_stream(_stream_of(spark, oc.orderBy("ts", "id"), tmpdir_path)), tmpdir_path)
    s = {(r.id, r.failures_before, r.state_before, r.state_after) for r in spark.read.parquet(out).collect()}
    b = {(r.id, r.failures_before, r.state_before, r.state_after) for r in breaker_replay(oc).collect()}
    assert s == b


def test_stability_stream_equals_batch(spark, tmpdir_path):
    ev = file_event_rows(spark, SF)
    out = _run_to_table(stability_stream(_stream_of(spark, ev.orderBy("ts", "id"), tmpdir_path),
                                         ["file_day", "file_size"], 3), tmpdir_path)
    s = {(r.id, r.fire) for r in spark.read.parquet(out).collect()}
    b = {(r.id, r.fire) for r in stability_runs(ev, ["file_day", "file_size"], checks=3).collect()}
    assert s == b


def test_debounce_stream_closed_sessions(spark, tmpdir_path):
    ev = file_event_rows(spark, SF).select("id", "file_path", "ts")
    stream = _stream_of(spark, ev, tmpdir_path)
    out = _run_to_table(debounce_stream(stream, 600, "0 seconds"), tmpdir_path)
    s = {(r.file_path, r.session_start, r.events) for r in spark.read.parquet(out).collect()}
    b = {(r.file_path, r.session_start, r.events) for r in debounce_sessions(ev, 600).collect()}
    # append mode emits a session once the watermark has passed it; every emitted one equals the batch twin
    assert s and s <= b


def test_intake_stream_json_and_excel(spark, tmpdir_path):
    from intakeflow.streaming.intake import explode_json_path
    from tests.xlsx_fixture import make_xlsx

    spec = TaskSpec(task_id="js", base_table="js", keys=("id",), partition_field="date", json_path="data.item",
                    extensions=(".json",))
    js = f"{tmpdir_path}/js"
    os.makedirs(js)
    with open(f"{js}/a.json", "w") as f:
        f.write('{"data": [{"id": "1", "date": "2026-01-02"}, {"id": "2", "date": "2026-02-03"}]}')
    with open(f"{js}/bad.json", "w") as f:
        f.write('{"data": [{"id": "3", "date": ')
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
    schema = T.StructType([T.StructField("data", T.ArrayType(item))])
    paths = _paths(f"{tmpdir_path}/jsrun")
    q = start_intake(spark, js, spec, schema, paths, fmt="json", available_now=True, as_of=lambda: AS_OF,
                     prepare=lambda df: explode_json_path(df, spec.json_path))
    q.awaitTermination(120)
    assert q.exception() is None
    assert {(r.month, r.id) for r in read_target(spark, paths.target).collect()} == {("202601", "1"), ("202602", "2")}
    cur = {os.path.basename(r.file_path): r.status for r in fold(spark.read.parquet(paths.ledger)).collect()}
    assert cur == {"a.json": "SUCCESS", "bad.json": "SKIPPED"}

    # with the schema of the items, documents are read in ranges
    paths = _paths(f"{tmpdir_path}/jsitems")
    q = start_intake(spark, js, spec, item, paths, fmt="json", available_now=True, as_of=lambda: AS_OF)
    q.awaitTermination(120)
    assert q.exception() is None
    assert {(r.month, r.id) for r in read_target(spark, paths.target).collect()} == {("202601", "1"), ("202602", "2")}
    cur = {os.path.basename(r.file_path): r.status for r in fold(spark.read.parquet(paths.ledger)).collect()}
    assert cur == {"a.json": "SUCCESS", "bad.json": "SKIPPED"}

    xl = f"{tmpdir_path}/xl"
    os.makedirs(xl)
    with open(f"{xl}/a.xlsx", "wb") as f:
        f.write(make_xlsx([["id", "date"], [1, "2026-01-05"], [2, "2026-03-01"]]))
    with open(f"{xl}/broken.xlsx", "wb") as f:
        f.write(b"not a zip")
    xspec = TaskSpec(task_id="xl", base_table="xl", keys=("id",), partition_field="date", extensions=(".xlsx",))
    xschema = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
    xpaths = _paths(f"{tmpdir_path}/xlrun")
    q = start_intake(spark, xl, xspec, xschema, xpaths, fmt="excel", available_now=True, as_of=lambda: AS_OF)
    q.awaitTermination(120)
    assert q.exception() is None
    assert {(r.month, r.id) for r in read_target(spark, xpaths.target).collect()} == {("202601", "1"), ("202603", "2")}
    cur = {os.path.basename(r.file_path): r.status for r in fold(spark.read.parquet(xpaths.ledger)).collect()}
    assert cur == {"a.xlsx": "SUCCESS", "broken.xlsx": "SKIPPED"}


def test_batch_intake_equals_stream(spark, tmpdir_path):
    from intakeflow.streaming.intake import run_batch_intake

    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    header = ["id", "name", "value", "date", "status", "score"]
    for i in range(4):
        _csv(f"{inbox}/d{i}.csv", header, [(k, f"n{k}", "1", f"2026-0{1 + k % 3}-0{1 + i}", "ok", 1)
                                           for k in range(i * 5, i * 5 + 8)])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    spec = TaskSpec(task_id="b", base_table="b", keys=("id",), partition_field="date")
    bp = _paths(f"{tmpdir_path}/batch")
    counts = run_batch_intake(spark, inbox, spec, schema, bp, as_of=lambda: AS_OF)
    assert counts["received"] == 32 and counts["inserted"] == 23
    again = run_batch_intake(spark, inbox, spec, schema, bp, run_id=1, as_of=lambda: AS_OF)
    assert again["received"] == 0  # every file is already SUCCESS in the ledger
    sp = _paths(f"{tmpdir_path}/stream")
    q = start_intake(spark, inbox, spec, schema, sp, available_now=True, as_of=lambda: AS_OF)
    q.awaitTermination(120)
    key = lambda p: sorted((r.month, r.id) for r in read_target(spark, p).collect())
    assert key(bp.target) == key(sp.target)


def test_reports_over_intake_outputs(spark, tmpdir_path):
    from intakeflow.plans import reports
    from intakeflow.streaming.intake import run_batch_intake

    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    _csv(f"{inbox}/a.csv", ["id", "date"], [(1, "2026-01-02"), (2, "2026-02-02")])
    spec = TaskSpec(task_id="r", base_table="r", keys=("id",), partition_field="date")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
    paths = _paths(f"{tmpdir_path}/run")
    run_batch_intake(spark, inbox, spec, schema, paths, as_of=lambda: AS_OF)
    stats = reports.task_stats(fold(spark.read.parquet(paths.ledger))).first()
    assert (stats.task_id, stats.total, stats.success, stats.total_rows) == ("r", 1, 1, 2)
    assert stats.avg_processing_ms >= 0
    trend = reports.quality_trend(spark.read.parquet(paths.quality), AS_OF + dt.timedelta(days=1), days=7).first()
    assert trend.batch_count == 1 and trend.avg_score == 100.0


def test_intake_options(spark, tmpdir_path):
    import pytest

    from intakeflow.functions.crypto import decrypt_fields
    from intakeflow.streaming.intake import ext_glob, run_batch_intake

    assert ext_glob((".csv", ".json"), "csv") == "*.[cC][sS][vV]"
    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    _csv(f"{inbox}/A.CSV", ["id", "name", "date"], [(1, "ann", "2026-01-02"), (2, "", "2026-01-03")])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "date")])

    def flag(df):
        return df.withColumn("_valid", F.col("name") != "").withColumn("_error", F.lit(None).cast("string"))

    enc = TaskSpec(task_id="e", base_table="e", keys=("id",), partition_field="date", encrypt_fields=("name",))
    p1 = _paths(f"{tmpdir_path}/enc")
    run_batch_intake(spark, inbox, enc, schema, p1, flag=flag, as_of=lambda: AS_OF, encryption_key="0123456789abcdef")
    stored = read_target(spark, p1.target)
    assert stored.first().name != "ann"
    assert decrypt_fields(stored, ["name"], "0123456789abcdef").first().name == "ann"
    abort = TaskSpec(task_id="a", base_table="a", keys=("id",), partition_field="date", on_row_error="abort")
    p2 = _paths(f"{tmpdir_path}/abort")
    with pytest.raises(Exception, match="on_row_error=abort"):
        run_batch_intake(spark, inbox, abort, schema, _paths(f"{tmpdir_path}/raise"), flag=flag, as_of=lambda: AS_OF,
                         isolate_errors=False)
    run_batch_intake(spark, inbox, abort, schema, p2, flag=flag, as_of=lambda: AS_OF)  # the file fails, the run does not
    cur = fold(spark.read.parquet(p2.ledger)).first()
    assert (cur.status, cur.error_type, cur.dead_lettered) == ("FAILED", "FatalError", True)
    assert "row error" in cur.error_message
    # the same key again with another ciphertext: nothing is inserted; keys cannot be encrypted
    _csv(f"{inbox}/B.CSV", ["date", "id", "name"], [("2026-01-02", 1, "ann")])
    c = run_batch_intake(spark, inbox, enc, schema, p1, flag=flag, as_of=lambda: AS_OF, run_id=1,
                         encryption_key="0123456789abcdef")
    assert (c["received"], c["inserted"]) == (1, 0)
    keyed = TaskSpec(task_id="k", base_table="k", keys=("id",), partition_field="date", encrypt_fields=("id", "date"))
    with pytest.raises(ValueError, match="cannot be encrypted"):
        run_batch_intake(spark, inbox, keyed, schema, _paths(f"{tmpdir_path}/keyed"), flag=flag, as_of=lambda: AS_OF,
                         encryption_key="0123456789abcdef", isolate_errors=False)
    dated = TaskSpec(task_id="d", base_table="d", keys=("id",), partition_field="date", encrypt_fields=("date",))
    p3 = _paths(f"{tmpdir_path}/dated")
    run_batch_intake(spark, inbox, dated, schema, p3, flag=flag, as_of=lambda: AS_OF, encryption_key="0123456789abcdef")
    assert {(r.month, r.date[:4] == "2026") for r in read_target(spark, p3.target).collect()} == {("202601", False)}


def test_clean_source_archive(spark, tmpdir_path):
    import time

    inbox, archive = f"{tmpdir_path}/inbox", f"{tmpdir_path}/archive"
    os.makedirs(inbox)
    _csv(f"{inbox}/a.csv", ["id", "date"], [(1, "2026-01-02")])
    spec = TaskSpec(task_id="k", base_table="k", keys=("id",), partition_field="date")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
    paths = _paths(f"{tmpdir_path}/run")
    for i in range(2):
        if i == 1:
            _csv(f"{inbox}/b.csv", ["id", "date"], [(2, "2026-01-03")])
        q = start_intake(spark, inbox, spec, schema, paths, available_now=True, max_files_per_trigger=1,
                         clean_source="archive", archive_dir=archive, as_of=lambda: AS_OF)
        q.awaitTermination(120)
        assert q.exception() is None
    deadline = time.time() + 30
    while time.time() < deadline and os.path.exists(f"{inbox}/a.csv"):
        time.sleep(0.5)
    # a finished file is moved to the archive on a later batch (K6 is asynchronous)
    assert not os.path.exists(f"{inbox}/a.csv")
    assert any(f.endswith("a.csv") for _, _, fs in os.walk(archive) for f in fs)
    assert read_target(spark, paths.target).count() == 2


def test_intake_target_schema(spark, tmpdir_path):
    from intakeflow.streaming.intake import run_batch_intake

    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    _csv(f"{inbox}/a.csv", ["id", "value", "date"], [(1, "2.5", "2026-01-02"), (2, "oops", "2026-01-03")])
    spec = TaskSpec(task_id="s", base_table="s", keys=("id",), partition_field="date")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "value", "date")])
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("date", T.DateType())])
    paths = _paths(f"{tmpdir_path}/run")
    c = run_batch_intake(spark, inbox, spec, schema, paths, as_of=lambda: AS_OF, target_schema=target)
    assert c["inserted"] == 1
    stored = read_target(spark, paths.target)
    assert dict(stored.dtypes)["value"] == "double" and stored.first().id == 1
    q = spark.read.parquet(paths.quality).first()
    assert (q.total_rows, q.error_rows, q.quality_score) == (2, 1, 70.0)


def test_crash_before_ledger_then_replay(spark, tmpdir_path, monkeypatch):
    import pytest

    from intakeflow.streaming import intake as I

    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    _csv(f"{inbox}/a.csv", ["id", "date"], [(i, f"2026-0{1 + i % 3}-02") for i in range(10)])
    spec = TaskSpec(task_id="crash", base_table="crash", keys=("id",), partition_field="date")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
    paths = _paths(f"{tmpdir_path}/run")

    def boom(*a, **k):
        raise RuntimeError("crash after the data write")

    monkeypatch.setattr(I, "quality_alerts", boom)
    with pytest.raises(RuntimeError):
        I.run_batch_intake(spark, inbox, spec, schema, paths, as_of=lambda: AS_OF, isolate_errors=False)
    assert read_target(spark, paths.target).count() == 10  # data landed, the ledger did not
    monkeypatch.undo()
    held = I.run_batch_intake(spark, inbox, spec, schema, paths, run_id=1, as_of=lambda: AS_OF)
    assert held["received"] == 0  # the crashed run's lease is still live (L1)
    c = I.run_batch_intake(spark, inbox, spec, schema, paths, run_id=2, as_of=lambda: AS_OF + dt.timedelta(hours=1))
    assert (c["received"], c["inserted"]) == (10, 0)  # the replay stores nothing twice (T7)
    assert read_target(spark, paths.target).count() == 10
    cur = fold(spark.read.parquet(paths.ledger)).collect()
    assert [(r.status, r.row_count) for r in cur] == [("SUCCESS", 10)]


def test_older_file_wins_within_a_batch(spark, tmpdir_path):
    import time

    from intakeflow.streaming.intake import run_batch_intake
    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    _csv(f"{inbox}/a_new.csv", ["id", "name", "date"], [(1, "newer", "2026-01-02")])
    _csv(f"{inbox}/z_old.csv", ["id", "name", "date"], [(1, "older", "2026-01-02")])
    old = time.time() - 3600
    os.utime(f"{inbox}/z_old.csv", (old, old))
    spec = TaskSpec(task_id="o", base_table="o", keys=("id",), partition_field="date")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "date")])
    paths = _paths(f"{tmpdir_path}/run")
    run_batch_intake(spark, inbox, spec, schema, paths, as_of=lambda: AS_OF)
    assert [r.name for r in read_target(spark, paths.target).collect()] == ["older"]


def test_run_counters_log(spark, tmpdir_path):
    from intakeflow.streaming.intake import IntakePaths, run_batch_intake
    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    _csv(f"{inbox}/a.csv", ["id", "name", "date"], [(1, "a", "2026-01-02"), (2, "", "2026-01-03"), (1, "b", "2026-01-02")])
    spec = TaskSpec(task_id="r", base_table="r", keys=("id",), partition_field="date")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "date")])
    base = f"{tmpdir_path}/run"
    paths = IntakePaths(*(f"{base}/{n}" for n in ("target", "ledger", "quality", "alerts", "ckpt")), runs=f"{base}/runs")

    def flag(df):
        return df.withColumn("_valid", F.col("name") != "").withColumn("_error", F.lit(None).cast("string"))

    run_batch_intake(spark, inbox, spec, schema, paths, flag=flag, as_of=lambda: AS_OF)
    r = spark.read.parquet(paths.runs).first()
    assert (r.files, r.raw_count, r.valid_count, r.error_count, r.inserted, r.ignored) == (1, 3, 2, 1, 1, 1)


def test_readme_usage_example(spark, tmpdir_path):
    from intakeflow import TaskSpec as Spec
    from intakeflow.operators import cleaners, ledger
    from intakeflow.plans import reports
    from intakeflow.streaming.intake import IntakePaths, run_batch_intake

    drop = f"{tmpdir_path}/drop/orders"
    os.makedirs(drop)
    _csv(f"{drop}/d1.csv", ["id", "name", "value", "date", "status", "score"],
         [(1, "ann", "2.5", "2026-01-02", "OK", 50), (2, "", "x", "2026-02-03", "", 7)])
    spec = Spec(task_id="orders", base_table="order_data", keys=("id",), partition_field="date",
                partition_format="%Y-%m-%d", required_fields=("value",), retention_months=24)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "value", "date", "status", "score")])
    lake = f"{tmpdir_path}/lake"
    paths = IntakePaths(target=f"{lake}/order_data", ledger=f"{lake}/_ledger", quality=f"{lake}/_quality",
                        alerts=f"{lake}/_alerts", checkpoint=f"{lake}/_ckpt/orders")
    flag = lambda df: cleaners.test_clean_flagged(
        df, keep=[c for c in df.columns if c.startswith("_") or c == "task_id"])
    q = start_intake(spark, drop, spec, schema, paths, flag=flag, available_now=True)
    q.awaitTermination(120)
    counts = run_batch_intake(spark, drop, spec, schema, paths, flag=flag)
    assert counts["received"] == 0  # already loaded by the stream
    current = ledger.fold(spark.read.parquet(paths.ledger))
    assert reports.task_stats(current).first().success == 1
    assert reports.quality_trend(spark.read.parquet(paths.quality), dt.datetime.now(), days=30).count() == 1


def test_file_outcomes_and_restart(spark, tmpdir_path):
    from intakeflow.streaming.intake import run_batch_intake

    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    for i in range(5):
        _csv(f"{inbox}/good{i}.csv", ["id", "date"], [(10 * i + k, "2026-01-02") for k in range(4)])
    _csv(f"{inbox}/bad.csv", ["id", "date"], [("boom", "2026-01-02")])
    _csv(f"{inbox}/header only.csv", ["id", "date"], [])
    open(f"{inbox}/empty.csv", "w").close()
    with open(f"{inbox}/old.xls", "wb") as f:
        f.write(b"x")
    spec = TaskSpec(task_id="o", base_table="o", keys=("id",), partition_field="date", max_retries=2,
                    extensions=(".csv", ".xls"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
    paths = _paths(f"{tmpdir_path}/run")
    broken = [True]

    def flag(df):
        df = df.withColumn("_valid", F.lit(True)).withColumn("_error", F.lit(None).cast("string"))
        if broken[0]:
            df = df.withColumn("id", F.when(F.col("id") == "boom", F.raise_error(F.lit("retryable: cannot read"))).otherwise(F.col("id")))
        return df

    def state(status=None):
        return {os.path.basename(r.file_path): (r.status, r.row_count, r.dead_lettered)
                for r in fold(spark.read.parquet(paths.ledger)).collect()}

    c = run_batch_intake(spark, inbox, spec, schema, paths, flag=flag, as_of=lambda: AS_OF)
    assert c["inserted"] == 20  # the bad file stopped no other
    want = {f"good{i}.csv": ("SUCCESS", 4, False) for i in range(5)}
    want |= {"header only.csv": ("SUCCESS", 0, False), "empty.csv": ("SKIPPED", None, False),
             "old.xls": ("SKIPPED", None, False), "bad.csv": ("FAILED", None, False)}
    assert state() == want
    # a second run at once: the back-off holds the failed file, nothing else is touched
    events = spark.read.parquet(paths.ledger).count()
    run_batch_intake(spark, inbox, spec, schema, paths, flag=flag, as_of=lambda: AS_OF, run_id=1)
    assert spark.read.parquet(paths.ledger).count() == events
    # due again and failing again: retries are used up
    run_batch_intake(spark, inbox, spec, schema, paths, flag=flag, as_of=lambda: AS_OF + dt.timedelta(hours=1), run_id=2)
    assert state()["bad.csv"] == ("FAILED", None, True)
    broken[0] = False
    run_batch_intake(spark, inbox, spec, schema, paths, flag=flag, as_of=lambda: AS_OF + dt.timedelta(hours=9), run_id=3)
    assert state()["bad.csv"] == ("FAILED", None, True)  # dead-lettered files wait for a manual retry
    assert spark.read.parquet(paths.ledger + "_dead_letter").count() == 1


def test_user_code_runs_once_per_row(spark, tmpdir_path):
    from intakeflow.operators.cleaners import apply_row_function
    from intakeflow.streaming.intake import run_batch_intake

    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    _csv(f"{inbox}/a.csv", ["id", "date"], [(i, "2026-01-02") for i in range(100)])
    spec = TaskSpec(task_id="u", base_table="u", keys=("id",), partition_field="date")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
    calls = spark.sparkContext.accumulator(0)

    def fn(rows):
        calls.add(len(rows))
        return rows

    def flag(df):
        return apply_row_function(df, fn, schema, id_col="_row", keep=("_file", "_mtime", "_size", "task_id"))

    c = run_batch_intake(spark, inbox, spec, schema, _paths(f"{tmpdir_path}/run"), flag=flag, as_of=lambda: AS_OF)
    assert c["inserted"] == 100 and calls.value == 100


def test_excel_outcomes_stream_and_batch(spark, tmpdir_path):
    from intakeflow.streaming.intake import run_batch_intake
    from tests.xlsx_fixture import make_xlsx

    inbox = f"{tmpdir_path}/inbox"
    os.makedirs(inbox)
    books = {f"good{i}": [["id", "date"], [i, "2026-01-05"], [10 + i, "2026-03-01"]] for i in range(3)}
    books |= {"header [only]": [["id", "date"]], "blank": [], "bad": [["id", "date"], ["boom", "2026-01-02"]]}
    for name, rows in books.items():
        with open(f"{inbox}/{name}.xlsx", "wb") as f:
            f.write(make_xlsx(rows))
    with open(f"{inbox}/broken.xlsx", "wb") as f:
        f.write(b"not a zip")
    spec = TaskSpec(task_id="x", base_table="x", keys=("id",), partition_field="date", max_retries=2, extensions=(".xlsx",))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])

    def flag(df):
        return (df.withColumn("_valid", F.lit(True)).withColumn("_error", F.lit(None).cast("string"))
                .withColumn("id", F.when(F.col("id") == "boom", F.raise_error(F.lit("retryable: cannot read"))).otherwise(F.col("id"))))

    def state(paths):
        return {os.path.basename(r.file_path).split(".")[0]: (r.status, r.row_count, r.dead_lettered)
                for r in fold(spark.read.parquet(paths.ledger)).collect()}

    want = {f"good{i}": ("SUCCESS", 2, False) for i in range(3)} | {
        "header [only]": ("SUCCESS", 0, False), "blank": ("SUCCESS", 0, False), "broken": ("SKIPPED", None, False),
        "bad": ("FAILED", None, False)}
    s, b = _paths(f"{tmpdir_path}/stream"), _paths(f"{tmpdir_path}/batch")
    q = start_intake(spark, inbox, spec, schema, s, flag=flag, fmt="excel", available_now=True, as_of=lambda: AS_OF)
    q.awaitTermination(120)
    assert q.exception() is None
    c = run_batch_intake(spark, inbox, spec, schema, b, flag=flag, fmt="excel", as_of=lambda: AS_OF)
    assert c["inserted"] == 6 and state(s) == want and state(b) == want
    rows = [{(r.month, r.id) for r in read_target(spark, p.target).collect()} for p in (s, b)]
    assert rows[0] == rows[1] == {(m, str(k + i)) for i in range(3) for m, k in (("202601", 0), ("202603", 10))}
    # due again and failing again: retries are used up
    run_batch_intake(spark, inbox, spec, schema, b, flag=flag, fmt="excel", as_of=lambda: AS_OF + dt.timedelta(hours=1), run_id=1)
    assert state(b) == want | {"bad": ("FAILED", None, True)}
