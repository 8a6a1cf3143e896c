"""Readers, manifest, fingerprint and charset (S1-S8) on files made in a temp folder."""

import hashlib
import os

from pyspark.sql import functions as F

from intakeflow.sources.files import detect_charsets, fingerprints, list_files, sniff_charset, with_format
from intakeflow.sources.readers import excel_columns, json_skips, parse_xlsx, read_csv, read_excel_cells, read_json
from tests.xlsx_fixture import make_xlsx


def write(path, data, mode="w", encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if "b" in mode:
        with open(path, mode) as f:
            f.write(data)
    else:
        with open(path, mode, encoding=encoding, newline="") as f:
            f.write(data)


def test_csv_batch_and_quotes(spark, tmpdir_path):
    d = f"{tmpdir_path}/in"
    write(f"{d}/a.csv", "id,val\n" + "".join(f"{i},v{i}\n" for i in range(12)))
    write(f"{d}/b.csv", 'id,val\n100,"a ""q"" b"\n\n101,"line1\nline2"\n102\n')
    df = read_csv(spark, d)
    assert df.columns[:2] == ["id", "val"]
    assert dict(df.dtypes)["id"] == "string"
    got = {r.id: r.val for r in df.collect()}
    assert len(got) == 15
    assert got["100"] == 'a "q" b' and got["101"] == "line1\nline2" and got["102"] is None
    order = [r.id for r in df.filter(F.col("_file").endswith("a.csv")).orderBy("_row").collect()]
    assert order == [str(i) for i in range(12)]


def test_manifest_skips(spark, tmpdir_path):
    d = f"{tmpdir_path}/in"
    write(f"{d}/ok.CSV", "id\n1\n")
    write(f"{d}/empty.csv", "")
    write(f"{d}/notes.txt", "x")
    write(f"{d}/old.xls", b"\xd0\xcf", "wb")
    m = with_format(list_files(spark, d)).collect()
    got = {r.file_name: (r.fmt, r.skip_reason is not None) for r in m}
    # the binaryFile scan never hands out zero-byte files, so they are not listed at all
    assert got == {"ok.CSV": ("csv", False), "old.xls": ("excel", True)}
    listed = spark.createDataFrame([("/in/empty.csv", "empty.csv", ".csv", 0), ("/in/x.txt", "x.txt", ".txt", 5)],
                                   "path string, file_name string, ext string, file_size long")
    reasons = {r.file_name: r.skip_reason for r in with_format(listed).collect()}
    assert reasons["empty.csv"].startswith("Empty file") and reasons["x.txt"].startswith("Unsupported format")


def test_fingerprint_matches_hashlib(spark, tmpdir_path):
    d = f"{tmpdir_path}/fp"
    blobs = {f"f{n}.bin": os.urandom(n) for n in (100, 4096, 8192, 8193, 16384)}
    for name, b in blobs.items():
        write(f"{d}/{name}", b, "wb")
    got = {os.path.basename(r.path): r.file_hash for r in fingerprints(spark, d).collect()}
    for name, b in blobs.items():
        h = hashlib.md5(b[:4096])
        if len(b) > 8192:
            h.update(b[-4096:])
        h.update(str(len(b)).encode())
        assert got[name] == h.hexdigest()[:16], name


def test_gbk_detected_and_read(spark, tmpdir_path):
    d = f"{tmpdir_path}/gbk"
    write(f"{d}/g.csv", "id,name\n1,测试\n".encode("gbk"), "wb")
    cs = detect_charsets(spark, d).first().charset
    assert cs == "gb18030"
    assert sniff_charset("abc".encode(), None) == "utf-8"
    assert sniff_charset(b"\xef\xbb\xbfid", None) == "utf-8-sig"
    row = read_csv(spark, d, encoding="GBK").first()
    assert row.name == "测试"


def test_json_array_nested_and_corrupt(spark, tmpdir_path):
    d = f"{tmpdir_path}/js"
    write(f"{d}/a.json", '[{"id": 1, "v": 2.5}, {"id": 2, "v": null}]')
    write(f"{d}/bad.json", '[{"id": 3}, {"id": ')
    top = read_json(spark, d)
    assert sorted(r.id for r in top.collect()) == ["1", "2"]
    assert [r.skip_reason is not None for r in json_skips(spark, d).collect()] == [True]
    n = f"{tmpdir_path}/nested"
    write(f"{n}/a.json", '{"data": [{"id": 1}, {"id": 2}, {"id": 3}]}')
    assert sorted(r.id for r in read_json(spark, n, "data.item").collect()) == ["1", "2", "3"]


def test_excel_active_sheet(spark, tmpdir_path):
    data = make_xlsx([["id", None, "when"], [1, "a", 45292], [2, True, None]], active=1, sheets=2,
                     date_cells={(1, 2)})
    header, rows = parse_xlsx(data)
    assert header == ["id", "col_1", "when"]
    assert rows == [["1", "a", "2024-01-01 00:00:00"], ["2", "True", None]]
    d = f"{tmpdir_path}/xl"
    write(f"{d}/a.xlsx", data, "wb")
    write(f"{d}/broken.xlsx", b"not a zip", "wb")
    cells = read_excel_cells(spark, d)
    assert cells.filter(F.col("skip_reason").isNotNull()).count() == 1
    got = [tuple(r)[2:] for r in excel_columns(cells, ["id", "col_1", "when"]).orderBy("_row").collect()]
    assert got == [("1", "a", "2024-01-01 00:00:00"), ("2", "True", None)]


def test_workbench_infer_read(spark, tmpdir_path):
    d = f"{tmpdir_path}/wb"
    write(f"{d}/w.csv", "id,price,name\n1,2.5,a\n2,3.0,b\n")
    df = read_csv(spark, d, infer=True)
    assert dict(df.dtypes)["id"] == "int" and dict(df.dtypes)["price"] == "double"


def test_read_csv_detected_mixed_charsets(spark, tmpdir_path):
    from intakeflow.sources.readers import read_csv_detected
    d = f"{tmpdir_path}/mixed"
    write(f"{d}/u.csv", "id,name\n1,中文\n".encode("utf-8"), "wb")
    write(f"{d}/g.csv", "id,name\n2,测试\n".encode("gbk"), "wb")
    got = {r.id: r.name for r in read_csv_detected(spark, d).collect()}
    assert got == {"1": "中文", "2": "测试"}


def test_incremental_listing(spark, tmpdir_path):
    import time
    d = f"{tmpdir_path}/inc"
    write(f"{d}/old.csv", "id\n1\n")
    write(f"{d}/new.csv", "id\n2\n")
    old = time.time() - 3 * 86400
    os.utime(f"{d}/old.csv", (old, old))
    since = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(time.time() - 86400))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    names = [r.file_name for r in list_files(spark, d, (".csv",), modified_after=since).collect()]
    assert names == ["new.csv"]


def test_incremental_fingerprints(spark, tmpdir_path):
    import time
    d = f"{tmpdir_path}/incfp"
    write(f"{d}/old.csv", "id\n1\n")
    write(f"{d}/new.csv", "id\n2\n")
    old = time.time() - 3 * 86400
    os.utime(f"{d}/old.csv", (old, old))
    since = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(time.time() - 86400))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [os.path.basename(r.path) for r in fingerprints(spark, d, modified_after=since).collect()] == ["new.csv"]


def test_csv_columns_go_by_each_files_header(spark, tmpdir_path):
    from pyspark.sql import types as T
    d = f"{tmpdir_path}/drift"
    write(f"{d}/a b.csv", "id,name,date\n1,ann,2024-01-05\n")
    write(f"{d}/c+%20[x].csv", "name,date,id,extra\nbob,2024-02-05,2,zzz\n")
    write(f"{d}/short.csv", "\ufeffid,id\n0,3\n")
    write(f"{d}/header_only.csv", "date,id\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "date")])
    got = sorted((r.id, r.name, r.date, os.path.basename(r._file)) for r in read_csv(spark, d, schema=schema).collect())
    assert got == [("1", "ann", "2024-01-05", "a b.csv"), ("2", "bob", "2024-02-05", "c+%20[x].csv"),
                   ("3", None, None, "short.csv")]
    union = read_csv(spark, d)
    assert set(union.columns) == {"id", "name", "date", "extra", "_file", "_row"}


def test_charsets_with_chinese_headers_and_late_bytes(spark, tmpdir_path):
    from intakeflow.sources.readers import read_csv_detected
    d = f"{tmpdir_path}/late"
    filler = "".join(f"{i},plain\n" for i in range(40_000))
    write(f"{d}/with space.csv", ("编号,名称\n1,中文\n").encode("utf-8"), "wb")
    write(f"{d}/late.csv", ("编号,名称\n" + filler + "99999,测试\n").encode("gbk"), "wb")
    rows = read_csv_detected(spark, d)
    assert set(rows.columns) == {"编号", "名称", "_file", "_row"}
    got = {r["编号"]: r["名称"] for r in rows.where("`名称` <> 'plain'").collect()}
    assert got == {"1": "中文", "99999": "测试"} and rows.count() == 40_002


def test_excel_cells_without_references(spark):
    import io
    import re
    import zipfile
    data = make_xlsx([["id", "name"], [1, "a"], [2, "b"]])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            body = z.read(n)
            if n.startswith("xl/worksheets/"):
                body = re.sub(rb'(<(?:c|row)\b[^>]*?) r="[^"]*"', rb"\1", body)
            w.writestr(n, body)
    assert parse_xlsx(out.getvalue()) == parse_xlsx(data) == (["id", "name"], [["1", "a"], ["2", "b"]])
