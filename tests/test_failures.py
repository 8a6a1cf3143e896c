"""Errors by class, errors as data, and claims whose cost does not follow the history."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow import TaskSpec, errors
from intakeflow.operators import ledger as L
from intakeflow.operators.cleaners import apply_row_function
from intakeflow.streaming import intake as I

AS_OF = dt.datetime(2026, 1, 10)
SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("date", T.StringType())])
SPEC = TaskSpec(task_id="a/b c", base_table="f", keys=("id",), partition_field="date", max_retries=2)


def paths(base):
    return I.IntakePaths(*(f"{base}/{n}" for n in ("target", "ledger", "quality", "alerts", "ckpt")))


def put(path, ids, day=None):
    with open(path, "w") as f:
        f.write("id,date\n" + "".join(f"{i},2026-01-02\n" for i in ids))
    if day is not None:
        os.utime(path, (day * 86_400 + 60, day * 86_400 + 60))


def row_code(fn, **how):
    def flag(df):
        return apply_row_function(df, fn, SCHEMA, id_col="_row", keep=("_file", "_mtime", "_size", "task_id"), errors="file", **how)
    return flag


def test_kinds_by_class():
    assert errors.error_kind(errors.SkipFileError()) == "skip"
    for e in (errors.RetryableError(), TimeoutError(), ConnectionResetError()):
        assert errors.error_kind(e) == "retryable"
    for e in (ValueError(), errors.FatalError(), KeyError("x"), OSError("gone"), MemoryError()):
        assert errors.error_kind(e) == "fatal"
    trace = 'x\nTraceback (most recent call last):\n  File "u.py", line 3\n    boom\n{}: why\n\n\tat org.apache'
    assert errors.raised_kind(trace.format("mod.RetryableError")) == "retryable"
    assert errors.raised_kind(trace.format("TimeoutError")) == "retryable"
    assert errors.raised_kind(trace.format("ValueError")) == "fatal"
    # the word in a message decides nothing
    assert errors.raised_kind(trace.format("ValueError: RetryableError")) == "fatal"
    assert errors.raised_kind("Job aborted: ExecutorLostFailure (executor 3 exited)") == "infrastructure"
    assert errors.raised_kind("whatever") == "fatal"


def test_time_limit():
    with pytest.raises(errors.RetryableError):
        with errors.time_limit(0.05):
            time.sleep(2)
    with errors.time_limit(5):
        pass
    time.sleep(0.1)


def test_ten_bad_files_among_many_cost_one_pass(spark, tmp_path, monkeypatch):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(60):
        put(inbox / f"f{i:02d}.csv", [100 * i + k for k in range(5)])

    def code(rows):
        n = int(rows[0]["id"]) // 100
        if n % 6 == 1:
            if n % 12 == 1:
                raise errors.RetryableError(f"not now: {n}")
            if n == 7:
                raise errors.SkipFileError("of no use")
            raise ValueError(f"never: {n}")
        return rows

    reads = []
    once = I._file_rows
    monkeypatch.setattr(I, "_file_rows", lambda *a: (reads.append(len(a[1])), once(*a))[1])
    p = paths(tmp_path / "run")
    counts = I.run_batch_intake(spark, str(inbox), SPEC, SCHEMA, p, flag=row_code(code), as_of=lambda: AS_OF)
    assert reads == [60] and counts["inserted"] == 250
    state = {os.path.basename(r.file_path): r for r in L.fold(spark.read.parquet(p.ledger)).collect()}
    kinds = {n: (r.status, r.error_type, r.dead_lettered, r.retry_count) for n, r in state.items() if r.status != "SUCCESS"}
    assert kinds == {f"f{n:02d}.csv": ("SKIPPED", "SkipFile", False, 0) if n == 7 else
                     ("FAILED", "RetryableError", False, 1) if n % 12 == 1 else ("FAILED", "FatalError", True, 1)
                     for n in range(1, 60, 6)}
    assert state["f13.csv"].error_message == "RetryableError: not now: 13"
    # no row of a failed file is stored, and the quality log knows loaded files only
    assert {int(r.id) // 100 % 6 for r in I.read_target(spark, p.target).collect()} == {0, 2, 3, 4, 5}
    assert spark.read.parquet(p.quality).count() == 50
    with pytest.raises(errors.FatalError, match="never"):
        I.run_batch_intake(spark, str(inbox), SPEC, SCHEMA, paths(tmp_path / "strict"), isolate_errors=False,
                           flag=row_code(lambda rows: (_ for _ in ()).throw(ValueError("never"))), as_of=lambda: AS_OF)


def test_abort_and_native_failures_as_data(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, ids in (("good", [1, 2]), ("aborts", [3, "bad"]), ("fails", [5, "no"])):
        put(inbox / f"{name}.csv", ids)

    def flag(df):
        return (df.withColumn("_valid", F.col("id") != "bad").withColumn("_error", F.lit("rejected"))
                .withColumn(errors.FAIL, errors.fail_when(F.col("id") == "no", "locked", "retryable")))

    spec = TaskSpec(task_id="n", base_table="n", keys=("id",), partition_field="date", on_row_error="abort")
    p = paths(tmp_path / "run")
    assert I.run_batch_intake(spark, str(inbox), spec, SCHEMA, p, flag=flag, as_of=lambda: AS_OF)["inserted"] == 2
    got = {os.path.basename(r.file_path): (r.status, r.error_type, r.error_message)
           for r in L.fold(spark.read.parquet(p.ledger)).collect()}
    assert got == {"good.csv": ("SUCCESS", None, None), "fails.csv": ("FAILED", "RetryableError", "locked"),
                   "aborts.csv": ("FAILED", "FatalError", "row error (on_row_error=abort): rejected")}
    assert errors.FAIL not in I.read_target(spark, p.target).columns


def test_infrastructure_errors_fail_the_batch(spark, tmp_path, monkeypatch):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3):
        put(inbox / f"f{i}.csv", [i])
    p = paths(tmp_path / "run")

    def lost(*a, **k):
        raise RuntimeError("Job aborted: ExecutorLostFailure")

    monkeypatch.setattr(I, "process_batch", lost)
    with pytest.raises(RuntimeError):
        I.run_batch_intake(spark, str(inbox), SPEC, SCHEMA, p, as_of=lambda: AS_OF)
    monkeypatch.undo()
    state = L.fold(spark.read.parquet(p.ledger)).collect()
    assert {r.status for r in state} == {"CLAIMED"}  # no file is blamed; the claims run out
    later = AS_OF + dt.timedelta(hours=1)
    assert I.run_batch_intake(spark, str(inbox), SPEC, SCHEMA, p, as_of=lambda: later, run_id=1)["inserted"] == 3


def test_claims_read_the_listed_days_only(spark, tmp_path, monkeypatch):
    """Over fifty days of history, each claim reads its own day's events, and a failed file is found without being listed."""
    p = paths(tmp_path / "run")
    day0 = 20_000
    read = []
    whole = L.file_slice

    def counted(*a):
        df = whole(*a)
        read.append(df.count())
        return df

    monkeypatch.setattr(I, "file_slice", counted)
    old = [(f"/in/d{d}-{k}.csv", (day0 + d) * L.DAY_MS + k, 9) for d in range(50) for k in range(4)]
    events = spark.createDataFrame([(SPEC.task_id, f, m, e, AS_OF, s, 9) for f, m, _ in old for s, e in ((1, "CLAIMED"), (2, "SUCCESS"))],
                                   "task_id string, file_path string, file_mtime long, event string, event_time timestamp_ntz, "
                                   "seq long, file_size long")
    L.append_events(events, p.ledger)
    L.write_open(events.limit(0), p.ledger, SPEC.task_id)
    for d in (50, 51, 52):
        files = [(f"/in/d{d}-{k}.csv", (day0 + d) * L.DAY_MS + k, 9) for k in range(4)]
        assert len(I._claim(spark, files, SPEC, p, AS_OF, d, "me", True)) == 4
        done = spark.createDataFrame([(SPEC.task_id, f, m, "FAILED" if d == 50 and f.endswith("-2.csv") else "SUCCESS", AS_OF, 10 * d + 5,
                                       "RetryableError")
                                      for f, m, _ in files], "task_id string, file_path string, file_mtime long, event string, "
                                     "event_time timestamp_ntz, seq long, error_type string")
        L.append_events(done, p.ledger)
    # nothing of the fifty days before; the days of files left open (four after a run, one that failed)
    assert read == [0, 8, 16]
    # listed again, old files are known
    assert I._claim(spark, old[:3], SPEC, p, AS_OF, 60, "me", False) == []
    assert read[-1] == 8
    # due again: the failed file is taken though it is not listed
    later = AS_OF + dt.timedelta(hours=1)
    assert [f for f, _, _ in I._claim(spark, [], SPEC, p, later, 61, "me", True)] == ["/in/d50-2.csv"]
    # a manual retry of a file that no set of open keys holds any more
    dead = spark.createDataFrame([(SPEC.task_id, *old[5][:2])], "task_id string, file_path string, file_mtime long")
    L.append_events(dead.select("*", F.lit("FAILED").alias("event"), F.lit(AS_OF).alias("event_time"), F.lit(99).alias("seq"),
                                F.lit("FatalError").alias("error_type")), p.ledger)
    state = L.fold(L.file_slice(spark, p.ledger, SPEC.task_id, [day0 + 1])).filter("status = 'FAILED'")
    L.reopen(L.retry_events(state, later), p.ledger, SPEC.task_id)
    keys = L.open_keys(spark, p.ledger, SPEC.task_id)
    assert old[5][0] in {r.file_path for r in keys.collect()}


def test_claim_of_new_files_beside_ended_ones_folds_nothing(spark, tmp_path, monkeypatch):
    """F2: a micro-batch finds its predecessor's files left open; where all have ended, no plan over the ledger is made."""
    p = paths(tmp_path / "run")
    folds = []
    monkeypatch.setattr(I, "fold", lambda *a, **k: (folds.append(1), L.fold(*a, **k))[1])
    claim = lambda files, n: sorted(f for f, _, _ in I._claim(spark, files, SPEC, p, AS_OF, n, f"run-{n}", True))
    a, b, c, d = [(f"/in/{x}.csv", 1000, 9) for x in "abcd"]

    def ended(file, event, n):
        L.append_events(spark.createDataFrame([(SPEC.task_id, file[0], file[1], event, AS_OF, 10 * n + 5, "RetryableError")],
                                              "task_id string, file_path string, file_mtime long, event string, "
                                              "event_time timestamp_ntz, seq long, error_type string"), p.ledger)

    assert claim([a, a], 0) == ["/in/a.csv"]
    ended(a, "SUCCESS", 0)
    assert claim([a, b, ("/in/e.txt", 1000, 9)], 1) == ["/in/b.csv"] and folds == []
    assert {r.event for r in spark.read.parquet(p.ledger).where("file_path = '/in/e.txt'").collect()} == {"SKIPPED"}
    ended(b, "FAILED", 1)  # not due yet, but still open
    assert claim([c], 2) == ["/in/c.csv"] and len(folds) == 1
    assert {r.file_path for r in L.open_keys(spark, p.ledger, SPEC.task_id).collect()} == {"/in/b.csv", "/in/c.csv"}
    assert claim([c, d], 3) == ["/in/d.csv"]  # c is held by its claim


def test_a_claim_that_cannot_be_written_fails_no_file(spark, tmp_path, monkeypatch):
    p = paths(tmp_path / "run")
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.csv", range(3))

    def full(*a):
        time.sleep(1)
        raise OSError("no room")

    monkeypatch.setattr(I, "write_open", full)
    with pytest.raises(OSError, match="no room"):
        I.run_batch_intake(spark, str(tmp_path / "in"), SPEC, SCHEMA, p, as_of=lambda: AS_OF)
    assert not os.path.exists(p.target) and not os.path.exists(p.ledger) and not os.path.exists(p.quality)


def test_open_keys_of_a_ledger_without_them(spark, tmp_path):
    p = paths(tmp_path / "run")
    events = spark.createDataFrame([("t", f, 1000, e, AS_OF, s) for f, s, e in (
        ("a", 1, "CLAIMED"), ("b", 1, "CLAIMED"), ("b", 2, "SUCCESS"), ("c", 1, "CLAIMED"), ("c", 2, "FAILED"))],
        "task_id string, file_path string, file_mtime long, event string, event_time timestamp_ntz, seq long")
    assert L.open_keys(spark, p.ledger, "t").count() == 0
    L.append_events(events, p.ledger)
    assert {r.file_path for r in L.open_keys(spark, p.ledger, "t").collect()} == {"a", "c"}
    for n in range(4):
        L.write_open(events.limit(n), p.ledger, "t")
    assert L.open_keys(spark, p.ledger, "t").count() <= 3
    assert len(L._open_versions(spark, p.ledger, "t")) == 2


def test_files_of_each_failure_grow_with_the_table(spark, tmp_path, monkeypatch):
    """rows on which the user's code fails are delivered in files of bounded size, a kind of failure in each."""
    import datetime as dt

    from intakeflow.plans import q_drift, q_sources
    from intakeflow.streaming import intake

    rows = [(i, dt.datetime(1996, 1, 1), "P" if i % 2 else "O") for i in range(120)] + [(None, None, "P"), (1, None, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(q_sources, "CSV_ROWS_PER_FILE", 8)
    monkeypatch.setattr(q_drift, "_folder", lambda spark, name: str(tmp_path / name))

    def stop(*args, **kwargs):
        raise InterruptedError

    monkeypatch.setattr(intake, "run_batch_intake", stop)
    with pytest.raises(InterruptedError):
        q_drift.intake_outcomes(spark, str(tmp_path))
    for k in range(3):
        keys = [[int(x.split(",")[0]) for x in f.read_text().splitlines()[1:]]
                for f in (tmp_path / "outcomes" / f"bad{k}").glob("part-*")]
        assert sorted(len(x) > 0 for x in keys) == [True] * 3
        assert sorted(x for some in keys for x in some) == [i for i in range(120) if i % 2 and i % 3 == k]
    assert len(list((tmp_path / "outcomes" / "good").glob("part-*"))) == 8
    assert len(list((tmp_path / "outcomes" / "none").glob("part-*"))) == 1
