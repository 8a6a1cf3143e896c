"""Exports, rendering and lifecycle helpers."""

import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from intakeflow.operators.lifecycle import (ageing_candidates, apply_retention, cutoff_month,
                                            delete_month_partitions, drop_archived)
from intakeflow.plans.reports import render_file_rows, write_csv


def test_write_csv_header_and_quotes(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 'a "q"'), (2, "x,y")], "id int, text string")
    out = f"{tmpdir_path}/export"
    write_csv(df, out)
    [part] = glob.glob(f"{out}/part-*.csv")
    assert open(part).read().splitlines() == ["id,text", '1,"a ""q"""', '2,"x,y"']


def test_render_drops_nulls_unless_full(spark):
    df = spark.createDataFrame([(1, "t", "f.csv", "/in/f.csv", "SUCCESS", 3, 3, 0, None, None, 10,
                                 dt.datetime(2024, 1, 1), None, None)],
                               "id long, task_id string, file_name string, file_path string, status string, "
                               "row_count long, valid_row_count long, retry_count long, error_type string, "
                               "claim_expires_at timestamp_ntz, processing_time_ms long, created_at timestamp_ntz, "
                               "processed_at timestamp_ntz, error_message string")
    short = json.loads(render_file_rows(df).first().json)
    assert "file_path" not in short and "error_type" not in short and short["status"] == "SUCCESS"
    assert short["created_at"] == "2024-01-01 00:00:00"
    full = json.loads(render_file_rows(df, full=True).first().json)
    assert full["file_path"] == "/in/f.csv" and full["error_type"] is None and "error_message" in full


def test_retention_drop_and_partitions(spark, tmpdir_path):
    assert cutoff_month(dt.date(2026, 3, 15), 3) == "2025-12"
    reg = spark.createDataFrame([("t", "x_202511", "2025-11", "ACTIVE"), ("t", "x_202512", "2025-12", "ACTIVE"),
                                 ("t", "x_202601", "2026-01", "ACTIVE")],
                                "task_id string, table_name string, year_month string, lifecycle_status string")
    arch = apply_retention(reg, 3, dt.date(2026, 3, 15))
    assert {r.year_month: r.lifecycle_status for r in arch.collect()} == {
        "2025-11": "ARCHIVED", "2025-12": "ARCHIVED", "2026-01": "ACTIVE"}
    assert apply_retention(reg, 0, dt.date(2026, 3, 15)).filter(F.col("lifecycle_status") != "ACTIVE").count() == 0
    dropped = drop_archived(arch, ["2025-11"])
    assert {r.year_month: r.lifecycle_status for r in dropped.collect()}["2025-11"] == "DROPPED"
    target = f"{tmpdir_path}/target"
    spark.createDataFrame([(1, "202511"), (2, "202601")], "id int, month string").write.partitionBy("month").parquet(target)
    assert delete_month_partitions(spark, target, ["202511", "209901"]) == 1
    assert sorted(d for d in os.listdir(target) if d.startswith("month=")) == ["month=202601"]


def test_ageing_candidates(spark):
    now = dt.datetime(2024, 6, 30)
    listing = spark.createDataFrame([("/a/old.csv", now - dt.timedelta(days=100)), ("/a/old.zip", now - dt.timedelta(days=100)),
                                     ("/a/mid.csv", now - dt.timedelta(days=10)), ("/a/new.csv", now)],
                                    "path string, modificationTime timestamp_ntz")
    got = {r.path: (r.compress, r.cleanup) for r in ageing_candidates(listing, now, 7, 90).collect()}
    assert got == {"/a/old.csv": (True, True), "/a/old.zip": (False, True), "/a/mid.csv": (True, False),
                   "/a/new.csv": (False, False)}
    off = {r.path: (r.compress, r.cleanup) for r in ageing_candidates(listing, now, 0, -1).collect()}
    assert set(off.values()) == {(False, False)}


def test_ageing_over_folder_listing(spark, tmpdir_path):
    import time

    from intakeflow.sources.files import list_files
    d = f"{tmpdir_path}/archive"
    os.makedirs(d)
    now = time.time()
    for name, age_days in (("old.csv", 120), ("old.zip", 120), ("week.json", 10), ("new.csv", 0)):
        with open(f"{d}/{name}", "w") as f:
            f.write("x")
        os.utime(f"{d}/{name}", (now - age_days * 86400, now - age_days * 86400))
    listing = list_files(spark, d, (".csv", ".json", ".zip"))
    as_of = dt.datetime.fromtimestamp(now, dt.timezone.utc).replace(tzinfo=None)
    got = {r.file_name: (r.compress, r.cleanup) for r in ageing_candidates(listing, as_of, 7, 90).collect()}
    assert got == {"old.csv": (True, True), "old.zip": (False, True), "week.json": (True, False),
                   "new.csv": (False, False)}


def test_workbench(spark, tmpdir_path):
    from intakeflow.plans.workbench import run_workbench
    src = f"{tmpdir_path}/wb/in.csv"
    os.makedirs(os.path.dirname(src))
    with open(src, "w") as f:
        f.write("id,name,value,date,status,score\n1,ann,2.5,2026-01-02,OK,50\n2,,x,bad,,7\n1,ann,2.5,2026-01-02,OK,50\n")
    r = run_workbench(spark, src, "test_clean", f"{tmpdir_path}/wb/out")
    assert (r["original"], r["cleaned"], r["dropped"]) == (3, 2, 1)
    assert r["columns"] == ["id", "name", "value", "date", "status", "score"]
    assert r["preview"][0]["status"] == "ok"

    def clean_data(pdf):  # a user's pandas cleaner: exact duplicates removed
        return pdf.drop_duplicates()

    r2 = run_workbench(spark, src, clean_data, f"{tmpdir_path}/wb/out2")
    assert (r2["original"], r2["cleaned"]) == (3, 2)


def test_backlog_and_failed_file_alerts(spark):
    from intakeflow.streaming.alerts import backlog_alerts, failed_files_alerts
    wl = spark.createDataFrame([("t1",)] * 5 + [("t2",)] * 2, "task_id string")
    assert [(r.task_id, r.value) for r in backlog_alerts(wl, queue_size_max=3).collect()] == [("t1", 5.0)]
    cur = spark.createDataFrame([("t1", "FAILED")] * 3 + [("t2", "SUCCESS")] * 9, "task_id string, status string")
    assert [(r.kind, r.task_id) for r in failed_files_alerts(cur, threshold=2).collect()] == [("failed_files", "t1")]


def test_daily_rollup_overwrites_only_recomputed_days(spark, tmpdir_path):
    from intakeflow.plans.reports import write_daily_rollup
    path = f"{tmpdir_path}/daily"
    first = spark.createDataFrame([("t", dt.date(2026, 1, 1), 5), ("t", dt.date(2026, 1, 2), 7)],
                                  "task_id string, stat_date date, total_files long")
    write_daily_rollup(first, path)
    again = spark.createDataFrame([("t", dt.date(2026, 1, 2), 9)], "task_id string, stat_date date, total_files long")
    write_daily_rollup(again, path)
    got = {str(r.stat_date): r.total_files for r in spark.read.parquet(path).collect()}
    assert got == {"2026-01-01": 5, "2026-01-02": 9}
