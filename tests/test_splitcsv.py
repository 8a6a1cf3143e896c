import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intakeflow.sources import splitcsv
from intakeflow.sources.readers import csv_headers, read_csv

PART = st.sampled_from(['"', '""', ",", "\n", "a", " ", 'b"', "\r\n", '",', ',"', ""])
TEXT = st.lists(PART, max_size=40).map("".join)


def reference(text):
    """Rows of the standard library's reader over the whole text."""
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.integers(0, 60), max_size=4))
def test_ranges_hold_the_records_of_the_whole(text, cuts):
    """Any cut of the lines into ranges gives the records that a reader of the whole text finds."""
    lines = text.encode().split(b"\n")
    at = sorted({0, *[c for c in cuts if c < len(lines)], len(lines)})
    inside, got, open_ = False, [], b""
    for s, e in zip(at, at[1:]):
        some = lines[s:e]
        state = [False, True]
        for line in some:
            state = [splitcsv.ends_inside(line, x) if b'"' in line else x for x in state]
        r = splitcsv.Range(inside, keep_head=True)
        records = r.feed(some, [b'"' in x for x in some])
        if inside:
            open_ += b"\n" + b"\n".join(r.head)
            if not r.skip:
                got.append(open_)
        got += [x for _, x in records]
        if r.open:
            open_ = b"\n".join(r.open)
        assert r.inside == state[inside]
        inside = state[inside]
    if inside:
        got.append(open_)
    rows = [row for rec in got for row in splitcsv.cells([rec.decode()]) if row]
    assert [[c or "" for c in row] for row in rows] == reference(text)


def test_composition_of_ranges(spark):
    r = random.Random(3)
    rows, want = [], {}
    for f in range(5):
        state = False
        for k in range(30):
            outside, inside = r.choice([(False, True), (True, False), (False, False), (True, True)])
            rows.append((f"f{f}", k * 100, outside, inside))
            want[f"f{f}", k * 100] = state
            state = inside if state else outside
    df = spark.createDataFrame(rows, "file string, at long, outside boolean, inside boolean").repartition(7)
    assert {(x.file, x.at): x.starts_inside for x in splitcsv.starts(df).collect()} == want


@pytest.fixture()
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def put(path, header, rows, encoding="utf-8", **how):
    with open(path, "w", newline="", encoding=encoding) as f:
        w = csv.writer(f, **how)
        w.writerow(header)
        w.writerows(rows)


def test_a_large_file_in_many_ranges(spark, tmp_path, small_ranges):
    r = random.Random(1)
    texts = ["a", "x,y", "one\ntwo", 'q""q', '5" d', '"', "tail\n\n" * 30, "p\r\nq", "é 日本", "z" * 5000]
    rows = [[str(i), r.choice(texts), r.choice(["b", '"q"', ',"'])] for i in range(1500)]
    put(tmp_path / "big.csv", ["first\nname", "b", "c"], rows)
    put(tmp_path / "other.csv", ["c", "first\nname", "c"], [["x", x[0], x[2]] for x in rows[:20]], quoting=csv.QUOTE_ALL)
    (tmp_path / "header only.csv").write_text('"first\nname",b')
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["first\nname", "b", "c", "_file", "_row"]
    assert splitcsv.lines(spark, [str(tmp_path)]).select("file", "at").distinct().count() > 50
    got = df.orderBy("_file", "_row").collect()
    big = [list(x)[:3] for x in got if x["_file"].endswith("big.csv")]
    assert big == rows
    assert [(x[0], x[1], x[2]) for x in got if "other" in x["_file"]] == [(x[0], None, x[2]) for x in rows[:20]]
    assert len(got) == 1520


def test_headers_and_states_are_found_in_one_pass(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(splitcsv, "headers", lambda *a: pytest.fail("a pass for headers alone"))
    rows = [[str(i), "one\ntwo" if i % 7 == 0 else "z" * (i % 50)] for i in range(500)]
    put(tmp_path / "a.csv", ["k", "first\nname"], rows)
    (tmp_path / "b.csv").write_text("\n \n" + (tmp_path / "a.csv").read_text())
    schema = "k string, `first\nname` string"
    got = read_csv(spark, str(tmp_path), schema=spark.createDataFrame([], schema).schema).orderBy("_file", "_row").collect()
    assert [list(x)[:2] for x in got] == [[k, v or None] for k, v in rows] * 2


def test_odd_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbf\n"k","v",w\n1,5" disk,more,cells\n\n2,"a"b,\n3\n4,"",x\xff\r\n5,"open\nend')
    got = [tuple(x)[:3] for x in read_csv(spark, str(tmp_path)).orderBy("_row").collect()]
    assert got == [("1", '5" disk', "more"), ("2", "ab", None), ("3", None, None), ("4", "", "x�"), ("5", "open\nend", None)]
    (tmp_path / "b.csv").write_bytes(b'v,"k\rey"\rp,6\r\r"q\r",7\r')  # carriage returns only: one line for the source
    got = read_csv(spark, str(tmp_path)).where(F.col("_file").endswith("b.csv")).orderBy("_row").collect()
    assert [(x["k\rey"], x.v) for x in got] == [("6", "p"), ("7", "q\r")]


def test_charsets_and_typed_columns(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    put(tmp_path / "g.csv", ["编号", "名"], [["1", "中,文"], ["x", "引\n号"]], "gb18030")
    schema = StructType([StructField("编号", IntegerType()), StructField("名", StringType()), StructField("none", IntegerType())])
    got = read_csv(spark, str(tmp_path), "gb18030", schema).orderBy("_row").collect()
    assert [tuple(x)[:3] for x in got] == [(1, "中,文", None), (None, "引\n号", None)]
    put(tmp_path / "w.csv", ["a", "b"], [["1", "p\nq"]], "utf-16")
    got = read_csv(spark, str(tmp_path / "w.csv"), "utf-16").collect()
    assert [tuple(x)[:2] for x in got] == [("1", "p\nq")]


def test_headers_and_empty_folder(spark, tmp_path):
    put(tmp_path / "a.csv", ["x", "y"], [])
    put(tmp_path / "b.csv", ["y\nz", "x"], [["1", "2"]])
    (tmp_path / "c.csv").write_text("\n\n")
    assert csv_headers(spark, str(tmp_path)) == [("x", "y"), ("y\nz", "x")]
    assert read_csv(spark, str(tmp_path)).columns == ["x", "y", "y\nz", "_file", "_row"]
    put(tmp_path / "b.csv", ["y\nz", "x"], [])
    assert read_csv(spark, str(tmp_path)).count() == 0
