import io
import random
import tracemalloc
import zipfile

from pyspark.sql import functions as F

from intakeflow.sources import readers
from intakeflow.sources.readers import Sheet, excel_columns, parse_xlsx, read_excel_cells
from tests.xlsx_fixture import make_xlsx


def with_sheet(body, strings="<si><t>a</t></si>"):
    """A workbook around the rows of a sheet, given piece by piece."""
    base = zipfile.ZipFile(io.BytesIO(make_xlsx([["x"]])))
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for n in base.namelist():
            if n == "xl/sharedStrings.xml":
                w.writestr(n, f"<sst {ns}>{strings}</sst>")
            elif not n.startswith("xl/worksheets/"):
                w.writestr(n, base.read(n))
        with w.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {ns}><sheetData>".encode())
            for piece in body:
                f.write(piece.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def test_read_once_and_twice_as_a_dense_grid(monkeypatch):
    """Random sparse sheets, with gaps, repeated and missing names: both ways as a grid filled by hand."""
    r = random.Random(2)
    for _ in range(40):
        width = r.randrange(1, 9)
        rows = [[r.choice([None, None, "a", "b", 3, 2.5, True]) for _ in range(width)] for _ in range(r.randrange(12))]
        data = make_xlsx(rows)
        text = [[None if v is None else str(v) for v in row] for row in rows]
        text = text[next((i for i, x in enumerate(text) if any(x)), len(text)):]
        while text and not any(text[-1]):
            text.pop()
        wide = max((max(i for i, v in enumerate(x) if v) + 1 for x in text if any(x)), default=0)
        header = [text[0][i] or f"col_{i}" for i in range(wide)] if text else []
        grid = [x[:wide] for x in text[1:]]
        assert parse_xlsx(data) == (header, grid)
        want = [(i, {n: v for n, v in dict(zip(header, x)).items() if v}) for i, x in enumerate(grid)]
        for size in (64 << 20, 0):
            monkeypatch.setattr(readers, "SHEET_BUFFER", size)
            names, got = Sheet(data).named()
            assert (names, list(got)) == (header, want)


def test_a_large_sparse_sheet_in_bounded_memory(monkeypatch):
    """Few cells in the first and last possible columns: memory does not grow with rows or width."""
    monkeypatch.setattr(readers, "SHEET_BUFFER", 1 << 10)
    monkeypatch.setattr(readers, "SHEET_CELLS", 3000)

    def body(n):
        yield '<row r="1"><c r="A1" t="s"><v>0</v></c></row>'
        for i in range(2, n):
            yield f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="XFD{i}" t="inlineStr"><is><t>z</t></is></c></row>'

    peaks = []
    for n in (10_000, 40_000):
        data = with_sheet(body(n))
        tracemalloc.start()
        names, rows = Sheet(data).named()
        count = total = 0
        for some in readers.sheet_batches(rows):
            count += len(some)
            total += sum(int(c["a"]) for _, c in some)
            assert some[-1][1]["col_16383"] == "z"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (count, total, len(names)) == (n - 2, sum(range(2, n)), 16384)
    assert peaks[1] < 10 << 20 and peaks[1] < 1.2 * peaks[0]


def test_damaged_workbooks_are_skipped_whole(spark, tmp_path, monkeypatch):
    good = [f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(2, 400)]
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c></row>'
    whole = with_sheet([head, *good])
    docs = {"good": whole, "string": with_sheet([head, *good, '<row r="500"><c r="A500" t="s"><v>9</v></c></row>']),
            "falling": with_sheet([head, *good, '<row r="7"><c r="A7"><v>1</v></c></row>']),
            "xml": with_sheet([head, *good, "<row>"]), "cut": whole[:-40], "none": with_sheet([])}
    for name, data in docs.items():
        (tmp_path / f"{name} 100%.xlsx").write_bytes(data)
    cells = read_excel_cells(spark, str(tmp_path))
    per = {r.f: (r.n, r.bad) for r in cells.groupBy(F.regexp_extract("_file", r"(\w+) 100%\.xlsx", 1).alias("f")).agg(
        F.count("cells").alias("n"), F.count("skip_reason").alias("bad")).collect()}
    assert per == {"good": (398, 0), "string": (0, 1), "falling": (0, 1), "xml": (0, 1), "cut": (0, 1)}
    assert excel_columns(cells, ["a"]).agg(F.sum(F.col("a").cast("int"))).first()[0] == sum(range(2, 400))


def test_odd_elements_of_a_sheet():
    """Text beside values, phonetic runs, references, sections and elements that are no cells."""
    data = with_sheet([
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><r><t>x</t></r><t>1 &lt; 2</t><rPh><t>no</t></rPh>'
        '<r><t>y</t></r></is></c></row><note>a &amp; b<row/></note>',
        '<row><c t="str"><f>A1&amp;"&#65;"</f><v>p<!-- no --><![CDATA[&q]]></v><v>no</v></c>no<c><v/></c><other><v>no</v></other>'
        '<c r="C2" t="b"><v>1</v></c><c><v>7.50</v></c><c r="AA2" t="e"><v>#N/A</v></c></row>'])
    header, rows = Sheet(data).named()
    assert header[:4] == ["a", "col_1", "1 < 2xy", "col_3"] and len(header) == 27
    assert list(rows) == [(0, {}), (1, {"a": "p&q", "1 < 2xy": "True", "col_3": "7.50", "col_26": "#N/A"})]


def test_workbooks_are_dealt_one_by_one(spark, tmp_path):
    """as many partitions as workbooks (up to a multiple of the cores), however few bytes the rows have."""
    from intakeflow.sources.fixtures import table_as_workbooks

    spark.range(60).select("id", F.lit("a & b").alias("text")).write.parquet(str(tmp_path / "few.parquet"))
    books = table_as_workbooks(spark, str(tmp_path), "few", rows_per_book=5)
    assert books.rdd.getNumPartitions() == 12
    rows = excel_columns(readers.parse_workbooks(books), ["id", "text"])
    assert sorted((int(r.id), r.text) for r in rows.collect()) == [(i, "a & b") for i in range(60)]
