"""Scalar functions vs plain-Python twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from intakeflow.functions.columns import (base_name, blank_name, clamp_int, normalize_date, quality_band,
                                          status_token, text_fill, to_number)
from intakeflow.operators.route import route_months
from intakeflow.spec import TaskSpec, check_table_name, clamp_days, page_args, strptime_to_spark


def py_date(v):
    try:
        if v is None or str(v).strip() == "":
            return None
        return dt.datetime.strptime(str(v)[:10], "%Y-%m-%d").strftime("%Y-%m-%d")
    except ValueError:
        return None


def py_value(v):
    try:
        x = float(v or 0)
    except (TypeError, ValueError):
        return 0.0
    return 0.0 if x != x else x


def py_score(v):
    try:
        x = float(v or 0)
    except (TypeError, ValueError):
        return 0
    if x != x:
        return 0
    return int(max(0.0, min(100.0, x)))


def py_status(v):
    s = str(v).lower().strip()
    return "unknown" if s in ("", "none", "nan") else s


SAMPLES = ["", " ", None, "\x1cx\x1f", "\u3000y\xa0", "None", "nan", "NaN", "abc", "12", " 12 ", "77.9", "-3", "150", "1e2",
           "2026-01-05", "2026-1-5", "2026-02-30", "2026-01-05 10:00:00", "not-a-date", " ACTIVE ", "Done",
           "inf", "-inf"]


def test_cleaner_expressions_match_python(spark):
    rng = random.Random(7)
    vals = SAMPLES + [rng.choice(SAMPLES) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = df.select("v", normalize_date(F.col("v")).alias("d"), to_number(F.col("v")).alias("n"),
                    clamp_int(F.col("v")).alias("s"), status_token(F.col("v")).alias("t"),
                    blank_name(F.col("v")).alias("b"), text_fill(F.col("v")).alias("f")).collect()
    for r in got:
        assert r.d == py_date(r.v), r
        want_n = py_value(r.v)
        assert r.n == want_n or (abs(want_n) == float("inf") and r.n == want_n), r
        assert r.s == py_score(r.v), r
        assert r.t == py_status(r.v), r
        assert r.b == (r.v is None or str(r.v).strip() == "" or r.v == "None"), r
        want_f = str(r.v).strip()
        assert r.f == ("" if want_f in ("nan", "None", "NaN") else want_f), r


def test_route_months_golden(spark):
    # route_months fixture: 2026-01-01, 2026-02-01, 2026-01-31 -> 202601 x2, 202602 x1
    spec = TaskSpec(task_id="t", base_table="order_data", partition_field="business_date")
    df = spark.createDataFrame([("2026-01-01",), ("2026-02-01",), ("2026-01-31",), ("not-a-date",), ("",),
                                (None,)], "business_date string")
    rows = route_months(df, spec, dt.datetime(2026, 7, 15)).groupBy("month", "_route_fallback").count().collect()
    got = {(r.month, r._route_fallback): r["count"] for r in rows}
    assert got == {("202601", False): 2, ("202602", False): 1, ("202607", True): 3}


def test_route_missing_column_uses_as_of(spark):
    spec = TaskSpec(task_id="t", base_table="order_data", partition_field="business_date")
    df = spark.createDataFrame([(1,)], "id int")
    r = route_months(df, spec, dt.date(2025, 3, 9)).first()
    assert r.month == "202503" and r._route_fallback


def test_table_names():
    with pytest.raises(ValueError):
        check_table_name("order; DROP TABLE users--")
    with pytest.raises(ValueError):
        check_table_name("1invalid")
    with pytest.raises(ValueError):
        check_table_name(" order")
    with pytest.raises(ValueError):
        check_table_name("a" * 65)
    assert check_table_name("order_data_202601") == "order_data_202601"


def test_pagination_and_days():
    assert page_args(None, None) == (1, 50)
    assert page_args("x", "y") == (1, 50)
    assert page_args(0, 500) == (1, 200)
    assert page_args(3, 0) == (3, 1)
    assert clamp_days(None, (7, 1, 90)) == 7
    assert clamp_days(500, (7, 1, 90)) == 90
    assert clamp_days(0, (30, 1, 90)) == 1


def test_strptime_translation():
    assert strptime_to_spark("%Y-%m-%d") == "yyyy-M-d"
    assert strptime_to_spark("%Y%m%d %H:%M:%S") == "yyyyMMdd H:m:s"
    assert strptime_to_spark("%d/%m/%Y") == "d/M/yyyy"


def test_band_and_base_name(spark):
    df = spark.createDataFrame([(95.0, "/a/b/c.csv"), (70.0, "x.csv"), (69.99, "/d/")], "s double, p string")
    got = df.select(quality_band(F.col("s")).alias("b"), base_name(F.col("p")).alias("n")).collect()
    assert [(r.b, r.n) for r in got] == [("good", "c.csv"), ("fair", "x.csv"), ("attention", "")]


@pytest.mark.parametrize("fmt", ["%Y-%m-%d", "%Y/%m/%d %H:%M", "%d.%m.%Y", "%Y%m%d"])
def test_month_suffix_matches_strptime(spark, fmt):
    rng = random.Random(hash(fmt) % 1000)
    vals = []
    for _ in range(300):
        y, m, d, hh, mm = rng.randint(1990, 2030), rng.randint(0, 13), rng.randint(0, 32), rng.randint(0, 24), rng.randint(0, 60)
        text = (fmt.replace("%Y", str(y)).replace("%m", rng.choice([str(m), f"{m:02d}"]))
                .replace("%d", rng.choice([str(d), f"{d:02d}"])).replace("%H", f"{hh:02d}").replace("%M", f"{mm:02d}"))
        if fmt == "%Y%m%d":
            text = f"{y}{m:02d}{d:02d}"
        vals.append(rng.choice([text, text, text, text + " ", "x" + text, "", None]))
    spec = TaskSpec(task_id="t", base_table="t", partition_field="v", partition_format=fmt)
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [(r.v, r.month, r._route_fallback) for r in route_months(df, spec, dt.date(2000, 1, 1)).collect()]
    for v, month, fb in got:
        try:
            want = dt.datetime.strptime(str(v), fmt).strftime("%Y%m") if v else None
        except ValueError:
            want = None
        assert (month, fb) == ((want, False) if want else ("200001", True)), (v, month)
