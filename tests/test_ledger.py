"""Ledger fold, claim rule, retries, dead-letter."""

import datetime as dt

from pyspark.sql import functions as F

from intakeflow.operators import ledger as L

T0 = dt.datetime(2024, 6, 1, 12, 0, 0)


def ev(spark, rows):
    df = spark.createDataFrame(rows, "task_id string, file_path string, file_mtime long, event string, "
                                     "event_time timestamp_ntz, seq long, owner string, error_type string")
    return L.conform(df)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_fold_and_claims(spark):
    k = ("t", "/in/a.csv", 1)
    e = ev(spark, [
        (*k, "CLAIMED", at(0), 1, "w1", None), (*k, "PROCESSING", at(1), 1, "w1", None),
        (*k, "FAILED", at(2), 1, None, "RetryableError"),
        (*k, "CLAIMED", at(3), 1, "w2", None), (*k, "FAILED", at(4), 1, None, "RetryableError"),
        ("t", "/in/b.csv", 1, "CLAIMED", at(0), 1, "w1", None),
        ("t", "/in/c.csv", 1, "CLAIMED", at(0), 1, "w1", None),
        ("t", "/in/c.csv", 1, "SUCCESS", at(5), 1, None, None),
        ("t", "/in/d.csv", 1, "FAILED", at(1), 1, None, "ValueError"),
        ("t", "/in/d.csv", 1, "DEAD_LETTER", at(2), 1, None, None),
    ])
    cur = {r.file_path: r for r in L.fold(e).collect()}
    assert cur["/in/a.csv"].status == "FAILED" and cur["/in/a.csv"].retry_count == 2
    assert cur["/in/b.csv"].claim_expires_at == at(10)
    assert cur["/in/c.csv"].processed_at == at(5)
    arrivals = spark.createDataFrame(
        [("t", p, 1) for p in ("/in/a.csv", "/in/b.csv", "/in/c.csv", "/in/d.csv", "/in/new.csv")],
        "task_id string, file_path string, file_mtime long")
    cur_df = L.fold(e)
    d = {r.file_path: r.decision for r in L.claim_decisions(arrivals, cur_df, at(5), 3).collect()}
    assert d == {"/in/a.csv": "CLAIM_RETRY", "/in/b.csv": "HOLD", "/in/c.csv": "HOLD",
                 "/in/d.csv": "HOLD", "/in/new.csv": "CLAIM_NEW"}
    # at the limit a retryable failure is no longer claimable
    d2 = {r.file_path: r.decision for r in L.claim_decisions(arrivals, cur_df, at(11), 2).collect()}
    assert d2["/in/a.csv"] == "HOLD" and d2["/in/b.csv"] == "CLAIM_EXPIRED"
    dead = {r.file_path: r.reason for r in L.dead_letter(cur_df, 2).collect()}
    assert dead == {"/in/a.csv": "retries_exhausted", "/in/d.csv": "fatal"}
    # manual retry: PENDING, counters cleared, claimable again
    e2 = e.unionByName(L.retry_events(cur_df.filter(F.col("file_path") == "/in/a.csv"), at(20)))
    cur2 = {r.file_path: r for r in L.fold(e2).collect()}
    assert cur2["/in/a.csv"].status == "PENDING" and cur2["/in/a.csv"].retry_count == 0
    assert cur2["/in/a.csv"].error_type is None
    d3 = {r.file_path: r.decision for r in L.claim_decisions(arrivals, L.fold(e2), at(21), 2).collect()}
    assert d3["/in/a.csv"] == "CLAIM_PENDING"


def test_worklist_order_and_backoff(spark):
    dec = spark.createDataFrame([
        ("t1", "/b", 2, "CLAIM_NEW", 0, None), ("t2", "/a", 1, "CLAIM_NEW", 0, None),
        ("t1", "/a", 1, "CLAIM_RETRY", 3, at(0)), ("t1", "/c", 3, "HOLD", 0, None)],
        "task_id string, file_path string, file_mtime long, decision string, retry_count long, "
        "failed_at timestamp_ntz")
    tasks = L.task_table(spark, {"t1": 1, "t2": 2})
    w = L.worklist(dec, tasks, at(1), last_failure=F.col("failed_at"))
    assert [(r.task_id, r.file_path) for r in w.collect()] == [("t1", "/b"), ("t2", "/a")]
    w2 = L.worklist(dec, tasks, at(3), last_failure=F.col("failed_at"))
    assert [(r.task_id, r.file_path) for r in w2.collect()] == [("t1", "/a"), ("t1", "/b"), ("t2", "/a")]


def test_dead_letter_events_block_claims(spark):
    k = ("t", "/in/z.csv", 1)
    e = ev(spark, [(*k, "CLAIMED", at(0), 1, "w", None), (*k, "FAILED", at(1), 1, None, "ValueError")])
    cur = L.fold(e)
    dead = L.dead_letter(cur, 3)
    assert [r.reason for r in dead.collect()] == ["fatal"]
    cur2 = L.fold(e.unionByName(L.dead_letter_events(dead, at(2))))
    assert cur2.first().dead_lettered
    arr = spark.createDataFrame([k], "task_id string, file_path string, file_mtime long")
    # a fatal failure has retry_count 1 < 3, yet the dead-letter event keeps it from being claimed
    assert L.claim_decisions(arr, cur2, at(3), 3).first().decision == "HOLD"


def test_claim_rule_matches_python_twin(spark):
    import random
    rng = random.Random(11)
    statuses = [None, "PENDING", "CLAIMED", "PROCESSING", "SUCCESS", "FAILED", "SKIPPED"]
    rows = []
    for i in range(400):
        st = rng.choice(statuses)
        rows.append(("t", f"/in/{i}.csv", i, st, rng.randint(0, 4), at(rng.randint(-30, 30)), rng.random() < 0.2))
    cur = spark.createDataFrame([r for r in rows if r[3] is not None],
                                "task_id string, file_path string, file_mtime long, status string, "
                                "retry_count long, claim_expires_at timestamp_ntz, dead_lettered boolean")
    arr = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "task_id string, file_path string, file_mtime long")
    got = {r.file_path: r.decision for r in L.claim_decisions(arr, cur, at(0), 3).collect()}

    def twin(st, rc, exp, dead):
        if st is None:
            return "CLAIM_NEW"
        if st == "FAILED" and rc < 3 and not dead:
            return "CLAIM_RETRY"
        if st == "PENDING":
            return "CLAIM_PENDING"
        if st in ("CLAIMED", "PROCESSING") and exp < at(0):
            return "CLAIM_EXPIRED"
        return "HOLD"

    for r in rows:
        assert got[r[1]] == twin(r[3], r[4], r[5], r[6]), r


def test_listing_minus_done_and_registry(spark):
    import datetime as _dt

    from intakeflow.operators.route import registry_additions
    cur = spark.createDataFrame([("t", "/a", 1, "SUCCESS"), ("t", "/b", 1, "FAILED")],
                                "task_id string, file_path string, file_mtime long, status string")
    listing = spark.createDataFrame([("t", "/a", 1), ("t", "/a", 2), ("t", "/b", 1)],
                                    "task_id string, file_path string, file_mtime long")
    left = {(r.file_path, r.file_mtime) for r in L.listing_minus_done(listing, cur).collect()}
    assert left == {("/a", 2), ("/b", 1)}  # a changed file (new mtime) is a new key
    written = spark.createDataFrame([("202601",), ("202601",), ("202602",)], "month string")
    reg = spark.createDataFrame([("t", "x_202601")], "task_id string, table_name string")
    add = registry_additions(written, reg, "t", "x", _dt.datetime(2026, 3, 1)).collect()
    assert [(r.table_name, r.year_month, r.lifecycle_status) for r in add] == [("x_202602", "2026-02", "ACTIVE")]


def test_cleaner_registry(spark):
    import pytest

    from intakeflow.operators.cleaners import cleaner, list_cleaners, run_cleaners
    assert list_cleaners() == ["deduplicate", "fillna_and_trim", "normalize_dates", "test_clean"]
    with pytest.raises(KeyError):
        cleaner("nope")
    df = spark.createDataFrame([(" a ", None), (" a ", None)], "name string, value string")
    assert run_cleaners(df, ["fillna_and_trim", "deduplicate"]).collect()[0].name == "a"


def test_claim_events_round_trip(spark):
    arrivals = spark.createDataFrame([("t", "/in/n.csv", 5, 10, "h1")],
                                     "task_id string, file_path string, file_mtime long, file_size long, file_hash string")
    empty = L.fold(ev(spark, [("t", "/in/other.csv", 1, "SUCCESS", at(0), 1, None, None)]))
    dec = L.claim_decisions(arrivals, empty, at(0), 3)
    claims = L.claim_events(dec, "w9", at(1))
    cur = L.fold(claims).first()
    assert (cur.status, cur.claimed_by, cur.claim_expires_at, cur.file_hash) == ("CLAIMED", "w9", at(11), "h1")
    proc = ev(spark, [("t", "/in/n.csv", 5, "PROCESSING", at(2), 1, "w9", None),
                      ("t", "/in/n.csv", 5, "SUCCESS", at(3), 1, None, None)])
    done = L.fold(claims.unionByName(proc)).first()
    assert (done.status, done.claimed_by, done.claim_expires_at, done.processed_at) == ("SUCCESS", None, None, at(3))


def test_outcome_classes_and_quarantine(spark, tmpdir_path):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(None,), ("skip",), ("retryable",), ("fatal",)], "kind string")
    got = [r.o for r in df.select(L.classify_outcome(F.col("kind")).alias("o")).collect()]
    assert got == ["SUCCESS", "SKIPPED", "RETRY", "FAILED"]
    k = ("t", "/in/q.csv", 1)
    cur = L.fold(ev(spark, [(*k, "FAILED", at(1), 1, None, "ValueError")]))
    path = f"{tmpdir_path}/quarantine"
    L.write_quarantine(L.dead_letter(cur, 3), path)
    q = spark.read.parquet(path).first()
    assert (q.file_path, q.file_name, q.reason) == ("/in/q.csv", "q.csv", "fatal")
