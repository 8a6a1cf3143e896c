"""Chunked ordered scans vs plain-Python replays, with one key holding most rows."""

import datetime as dt
import random

import pytest

from intakeflow.operators.sequence import (breaker_replay, debounce_sessions, failure_streaks,
                                           stability_runs)
from intakeflow.streaming.stateful import breaker_step

T0 = dt.datetime(2024, 1, 1)


def outcomes(n=1500, seed=3):
    rng = random.Random(seed)
    out, t = [], {}
    for i in range(n):
        task = "hot" if rng.random() < 0.7 else f"t{rng.randint(1, 4)}"
        t[task] = t.get(task, 0) + rng.choice([1, 5, 30, 61, 90, 200])
        out.append((i, task, T0 + dt.timedelta(seconds=t[task]), "FAILED" if rng.random() < 0.75 else "SUCCESS"))
    return out


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_breaker_and_streaks_match_replay(spark, chunks):
    data = outcomes()
    df = spark.createDataFrame(data, "id long, task_id string, ts timestamp_ntz, outcome string")
    got = {r.id: r for r in breaker_replay(df, n_chunks=chunks).collect()}
    streak = {r.id: r.consecutive_failures for r in failure_streaks(df, n_chunks=chunks).collect()}
    state = {}
    for i, task, ts, oc in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        mode, fails, opened = state.get(task, ("CLOSED", 0, 0))
        t_us = int(ts.timestamp() * 1_000_000)
        before, after, f2, opened = breaker_step(mode, fails, opened, oc, t_us, 5, 60)
        assert (got[i].failures_before, got[i].state_before, got[i].state_after) == (fails, before, after), i
        assert streak[i] == (f2 if oc == "FAILED" else 0)
        state[task] = (after, f2, opened)


def test_stability_runs(spark):
    rng = random.Random(5)
    data, t = [], 0
    for i in range(800):
        path = "/in/hot.csv" if rng.random() < 0.8 else f"/in/f{rng.randint(1, 3)}.csv"
        t += 1
        data.append((i, path, T0 + dt.timedelta(seconds=t), rng.choice([10, 10, 10, 20])))
    df = spark.createDataFrame(data, "id long, file_path string, ts timestamp_ntz, file_size long")
    got = {r.id: r for r in stability_runs(df, ["file_size"], checks=3, n_chunks=13).collect()}
    prev, run = {}, {}
    for i, p, ts, size in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        run[p] = run.get(p, 0) + 1 if prev.get(p) == size else 1
        prev[p] = size
        assert got[i].run_length == run[p]
        assert got[i].fire == (((run[p] - 1) % 3 + 1) == 3)


def test_debounce_sessions(spark):
    rng = random.Random(9)
    data, t = [], {}
    for i in range(600):
        p = "/in/hot.csv" if rng.random() < 0.8 else "/in/cold.csv"
        t[p] = t.get(p, 0) + rng.choice([1, 2, 3, 10, 30])
        data.append((i, p, T0 + dt.timedelta(seconds=t[p])))
    df = spark.createDataFrame(data, "id long, file_path string, ts timestamp_ntz")
    got = sorted((r.file_path, r.session_start, r.events) for r in debounce_sessions(df, 3, n_chunks=11).collect())
    want, last, start, cnt = [], {}, {}, {}
    for i, p, ts in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        if p in last and (ts - last[p]).total_seconds() <= 3:
            cnt[p] += 1
        else:
            if p in last:
                want.append((p, start[p], cnt[p]))
            start[p], cnt[p] = ts, 1
        last[p] = ts
    want += [(p, start[p], cnt[p]) for p in last]
    assert got == sorted(want)


def test_breaker_threshold_two():
    # breaker_2 fixture: two failures open it; after the timeout a probe is allowed; success closes it
    s = ("CLOSED", 0, 0)
    b, a, f, o = breaker_step(*s, "FAILED", 0, 2, 60)
    b, a, f, o = breaker_step(a, f, o, "FAILED", 1_000_000, 2, 60)
    assert a == "OPEN"
    b, a, f, o = breaker_step(a, f, o, "SUCCESS", 62_000_000, 2, 60)
    assert b == "HALF_OPEN" and a == "CLOSED" and f == 0


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", "c"]), st.integers(0, 40), st.booleans()),
                     min_size=1, max_size=120),
       chunks=st.integers(1, 17))
def test_scans_property(spark, rows, chunks):
    data = [(i, k, T0 + dt.timedelta(seconds=s), "SUCCESS" if ok else "FAILED") for i, (k, s, ok) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, task_id string, ts timestamp_ntz, outcome string")
    got = {r.id: r.consecutive_failures for r in failure_streaks(df, n_chunks=chunks).collect()}
    sess = sorted((r.file_path, r.session_start, r.events) for r in debounce_sessions(
        df.withColumnRenamed("task_id", "file_path"), 5, n_chunks=chunks).collect())
    run, want_sess, last, start, cnt = {}, [], {}, {}, {}
    for i, k, ts, oc in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        run[k] = run.get(k, 0) + 1 if oc == "FAILED" else 0
        assert got[i] == run[k]
        if k in last and (ts - last[k]).total_seconds() <= 5:
            cnt[k] += 1
        else:
            if k in last:
                want_sess.append((k, start[k], cnt[k]))
            start[k], cnt[k] = ts, 1
        last[k] = ts
    want_sess += [(k, start[k], cnt[k]) for k in last]
    assert sess == sorted(want_sess)


def test_empty_inputs(spark, tmpdir_path):
    from intakeflow.operators.route import route_months
    from intakeflow.operators.writer import write_first_wins
    from intakeflow.spec import TaskSpec

    df = spark.createDataFrame([], "id long, task_id string, ts timestamp_ntz, outcome string")
    assert failure_streaks(df).count() == 0 and breaker_replay(df).count() == 0
    assert debounce_sessions(df.withColumnRenamed("task_id", "file_path"), 5).count() == 0
    rows = route_months(spark.createDataFrame([], "id long, date string, _row long"),
                        TaskSpec(task_id="t", base_table="t", keys=("id",), partition_field="date"),
                        dt.datetime(2026, 1, 1))
    c = write_first_wins(rows, f"{tmpdir_path}/empty", ["id"], ["_row"])
    assert (c["received"], c["inserted"], c["ignored"]) == (0, 0, 0)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["p", "p", "p", "q", "r"]), st.integers(0, 30), st.sampled_from([1, 1, 2])),
                     min_size=1, max_size=100),
       chunks=st.integers(1, 15))
def test_stability_property(spark, rows, chunks):
    data = [(i, k, T0 + dt.timedelta(seconds=s), size) for i, (k, s, size) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, file_path string, ts timestamp_ntz, file_size long")
    got = {r.id: (r.run_length, r.fire) for r in stability_runs(df, ["file_size"], checks=3, n_chunks=chunks).collect()}
    prev, run = {}, {}
    for i, p, ts, size in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        run[p] = run.get(p, 0) + 1 if p in prev and prev[p] == size else 1
        prev[p] = size
        assert got[i] == (run[p], (run[p] - 1) % 3 + 1 == 3)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b"]), st.integers(0, 400), st.booleans()),
                     min_size=1, max_size=120),
       chunks=st.integers(1, 15))
def test_breaker_property(spark, rows, chunks):
    data = [(i, k, T0 + dt.timedelta(seconds=s), "FAILED" if bad else "SUCCESS") for i, (k, s, bad) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, task_id string, ts timestamp_ntz, outcome string")
    got = {r.id: (r.failures_before, r.state_before, r.state_after)
           for r in breaker_replay(df, threshold=3, timeout_s=60, n_chunks=chunks).collect()}
    state = {}
    for i, task, ts, oc in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        mode, fails, opened = state.get(task, ("CLOSED", 0, 0))
        before, after, f2, opened = breaker_step(mode, fails, opened, oc, int(ts.timestamp() * 1_000_000), 3, 60)
        assert got[i] == (fails, before, after), (i, task, ts, oc)
        state[task] = (after, f2, opened)
