"""CSV, JSON and Excel readers.

Every reader returns string-typed columns (the reference does no type
inference on CSV; Excel cells are cast by the cleaner), plus ``_file`` (the
source path) and ``_row``, which increases with the order of a file's rows, so
first-wins ordering by ``(delivery, _file, _row)`` is deterministic.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from itertools import accumulate
from xml.etree import ElementTree as ET
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.sources import splitcsv, splitjson
from intakeflow.sources.files import as_glob, can_read_ranges, file_system, plain_path

FILE = "_file"
ROW = "_row"
CORRUPT = "_corrupt_record"


def _with_identity(df: DataFrame) -> DataFrame:
    return df.withColumn(FILE, plain_path(F.col("_metadata.file_path"))) \
        .withColumn(ROW, F.monotonically_increasing_id())


def _as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def csv_encoding(spark: SparkSession, encoding: str | None) -> str:
    """The decoder's name; charsets beyond the JVM's standard set need a session switch."""
    if encoding and encoding.lower().replace("-", "") not in ("utf8", "utf8sig"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return "utf-8" if encoding in (None, "utf-8-sig") else encoding


# Charsets that do not write quotes, commas and line ends as ASCII does.
_WIDE = ("utf-16", "utf-32", "utf16", "utf32")


def csv_headers(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8",
                recursive: bool = False, glob: str | None = None) -> list[tuple[str, ...]]:
    """The distinct header records of files, in the order of the first file that has each."""
    found = splitcsv.headers(splitcsv.lines(spark, _as_list(paths), recursive, glob), csv_encoding(spark, encoding))
    first = found.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()
    return [tuple(r["header"]) for r in first]


def read_csv(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8",
             schema: T.StructType | None = None, infer: bool = False, recursive: bool = False,
             glob: str | None = None) -> DataFrame:
    """S1 (and S10 with ``infer=True``): header record, RFC-4180 quotes (``""`` escape),
    newlines inside quotes (also in the header), blank lines skipped, undecodable bytes -> U+FFFD.

    Columns go by name: every file's own header maps its cells (the last of two columns
    with one name counts).  With ``schema`` its columns come out - NULL where a file has none,
    further columns of a file left out; without one, the union of all headers (P3), as strings, in the
    order of the headers.  All files are one scan, and one file is read by many tasks (``splitcsv``); files in
    UTF-16 or UTF-32 are read whole, as are those of ``infer=True``, which reads one kind of file.
    """
    enc = csv_encoding(spark, encoding)
    wide = enc.lower().startswith(_WIDE)
    if infer or wide:
        r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
             .option("encoding", enc).option("mode", "PERMISSIVE")
             .option("recursiveFileLookup", str(recursive).lower()))
        r = r.option("pathGlobFilter", glob) if glob else r
        if infer:
            return _with_identity(r.option("inferSchema", True).csv(_as_list(paths)))
        parts = [_with_identity(r.csv(as_glob(f.removeprefix("file:")))) for f in sorted(
            spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
            .load(_as_list(paths)).select("path").toPandas()["path"])]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        if schema is None:
            return rows.select(*[c for c in rows.columns if c not in (FILE, ROW)], FILE, ROW)
        have = set(rows.columns)
        return rows.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have
                              else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields], FILE, ROW)
    if schema is not None:
        fields = list(schema.fields)
    else:
        names = dict.fromkeys(n for h in csv_headers(spark, paths, encoding, recursive, glob) for n in h if n != "")
        fields = [T.StructField(n, T.StringType()) for n in names]
    rows = splitcsv.read_split_csv(spark, _as_list(paths), [f.name for f in fields], enc, recursive, glob)
    if all(f.dataType == T.StringType() for f in fields):
        return rows
    return rows.select(*[F.col(f"`{f.name}`") if f.dataType == T.StringType() else
                         F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields], FILE, ROW)


def _json_items(spark: SparkSession, paths, json_path: str | None, recursive: bool,
                items_too: bool = True) -> tuple[DataFrame, list[str]]:
    """Items ``(file, row, item, fault)`` of all documents, and the large documents that do not parse.  Without
    ``items_too`` the faults only; the plan has those of large documents, which are not read again."""
    parts = [p for p in (json_path or "").split(".") if p and p != "item"]
    found = splitjson.pieces(spark, _as_list(paths), recursive)
    known = splitjson.plan(found, parts)
    items = splitjson.cut(found, parts, known) if items_too else splitjson.cut(found.where("whole"), parts, known, False)
    if known.single:
        text = spark.read.option("wholetext", True).text([as_glob(f) for f in sorted(known.single)]).select(
            plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").cast("binary").alias("line"))
        items = items.unionByName(splitjson.cut_single(text, parts))
    return items, sorted(known.bad)


def json_items(spark: SparkSession, paths: str | Sequence[str], json_path: str | None = None) -> DataFrame:
    """``(file, row, item, fault)``: the items of all documents as texts, and one row at least with a fault for a
    document that does not parse, which has no items then."""
    items, bad = _json_items(spark, paths, json_path, False)
    faults = spark.createDataFrame([(f, None, None, "parse") for f in bad], splitjson.ITEMS)
    return items.unionByName(faults) if bad else items


def read_json(spark: SparkSession, paths: str | Sequence[str], json_path: str | None = None,
              recursive: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Items of a top-level array, or of the array at ``json_path`` (e.g. ``data.item``
    or ``data``; a trailing ``.item`` means "the items of").  Primitive values are read as strings.

    One document is read by many tasks (``splitjson``); a document that does not parse as a whole is
    skipped whole (its rows never appear; ``json_skips`` reports it), and one without an array at the path has no rows.
    ``_row`` rises with a document's items.  Without ``schema`` the columns are found by a further pass over the items.
    """
    items, _ = _json_items(spark, paths, json_path, recursive)
    items = items.where("fault is null")
    if schema is None:
        schema = splitjson.item_schema(items)
    return items.select(F.col("file").alias(FILE), F.col("row").alias(ROW),
                        F.from_json("item", schema, {"mode": "PERMISSIVE"}).alias("_item")).select(FILE, ROW, "_item.*")


def json_skips(spark: SparkSession, paths: str | Sequence[str], json_path: str | None = None,
               recursive: bool = False) -> DataFrame:
    """Files that fail to parse, with a skip reason."""
    items, bad = _json_items(spark, paths, json_path, recursive, items_too=False)
    files = items.where("fault is not null").select(F.col("file").alias(FILE)).unionByName(
        spark.createDataFrame([(f,) for f in bad], f"{FILE} string"))
    return files.distinct().withColumn("skip_reason", F.concat(F.lit("JSON parse error in "), F.col(FILE)))


# ---------------------------------------------------------------------------
# Excel (.xlsx) - one workbook per input row, parsed with the standard library
# ---------------------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
# Built-in number formats that display dates / times (ECMA-376 part 1, 18.8.30).
_DATE_FMT_IDS = set(range(14, 23)) | {45, 46, 47}
_CELL = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _excel_serial(v: float, date1904: bool) -> str:
    import datetime as dt
    base = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)
    t = base + dt.timedelta(days=v)
    t = t.replace(microsecond=round(t.microsecond / 1000) * 1000 % 1_000_000)
    return t.isoformat(sep=" ")


def _number(text: str) -> str:
    if len(text) < 16 and text.isascii() and text.isdigit() and text[0] != "0":
        return text
    try:
        f = float(text)
    except ValueError:
        return text
    return str(int(f)) if f.is_integer() and "e" not in text.lower() and "." not in text else text


def _plain_text(node) -> str:
    """Text of a string item without its phonetic runs."""
    return "".join(t.text or "" for t in [*node.findall("m:t", _NS), *node.findall("m:r/m:t", _NS)])


# Bytes of a sheet's XML up to which its rows are held while it is read; larger sheets are read twice.
SHEET_BUFFER = 64 << 20
# Bytes of a sheet's XML parsed at once.
SHEET_READ = 1 << 16
# Cells of an Arrow batch of sheet rows at most.
SHEET_CELLS = 50_000


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ET.Element]:
    """The elements of one name in a part of a workbook, one at a time; each is forgotten after its turn."""
    wanted, around = f"{{{_NS['m']}}}{tag}", []
    with z.open(name) as f:
        for event, node in ET.iterparse(f, ("start", "end")):
            if event == "start":
                around.append(node)
                continue
            around.pop()
            if node.tag == wanted:
                yield node
                if around:
                    around[-1].remove(node)
                node.clear()


class _Rows:
    """The rows of a sheet's XML as it is fed: (row's number as written, cells), a cell being its reference, type,
    style, value's text and inline text.  Elements that are no part of that are passed over."""

    ROW, C, V, IS, T, R = (f"{_NS['m']} {tag}" for tag in ("row", "c", "v", "is", "t", "r"))

    def __init__(self):
        self.ready: list[tuple[str | None, list[tuple]]] = []
        parser = self.parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True
        ROW, C, V, IS, T, R, ready = self.ROW, self.C, self.V, self.IS, self.T, self.R, self.ready
        depth = -1  # below a row; -1 outside
        number, cells, cell, value, plain, runs, text = None, [], None, None, None, None, None
        in_is = in_run = False

        def no_text(data):  # without a handler references would pass for undefined entities
            pass

        def start(name, attrs):
            nonlocal depth, number, cells, cell, value, plain, runs, text, in_is, in_run
            if depth < 0:
                if name == ROW:
                    depth, number, cells = 0, attrs.get("r"), []
                return
            depth += 1
            if text is not None:  # an element's text ends at its first child
                keep()
            if depth == 1:
                cell, value, plain = (attrs if name == C else None), None, None
            elif cell is None:
                return
            elif depth == 2:
                if name == V and value is None:
                    value = text = []
                    parser.CharacterDataHandler = text.append
                in_is = name == IS and plain is None
                if in_is:
                    plain, runs = [], []
            elif in_is and depth == 3:
                in_run = name == R
                if name == T:
                    text = plain
                    parser.CharacterDataHandler = text.append
            elif in_is and in_run and depth == 4 and name == T:
                text = runs
                parser.CharacterDataHandler = text.append

        def keep():
            nonlocal text
            text, parser.CharacterDataHandler = None, no_text

        def end(name):
            nonlocal depth, cell, in_is, in_run
            if depth < 0:
                return
            if text is not None:
                keep()
            if depth == 0:
                ready.append((number, cells))
            elif depth == 1 and cell is not None:
                cells.append((cell.get("r", ""), cell.get("t", "n"), cell.get("s", "0"), "".join(value) if value else None,
                              None if plain is None else "".join(plain + runs)))
                cell = None
            elif depth == 2:
                in_is = False
            elif depth == 3:
                in_run = False
            depth -= 1

        def other(data):
            if data.startswith("&"):
                raise ET.ParseError(f"undefined entity {data}: line {parser.CurrentLineNumber}, "
                                    f"column {parser.CurrentColumnNumber}")

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler, parser.DefaultHandlerExpand = no_text, other

    def of(self, f) -> Iterator[tuple[str | None, list[tuple]]]:
        """The rows of an open part."""
        while True:
            data = f.read(SHEET_READ)
            self.parser.Parse(data, not data)
            yield from self.ready
            self.ready.clear()
            if not data:
                return


class Sheet:
    """The active sheet of a workbook (a file or its bytes), with cached cell values as text.

    Memory is bounded by the workbook's shared strings and one row.  Rows must rise, as the format asks."""

    def __init__(self, source):
        z = self.z = zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source)
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        pr = wb.find("m:workbookPr", _NS)
        self.date1904 = pr is not None and pr.get("date1904") in ("1", "true")
        view = wb.find("m:bookViews/m:workbookView", _NS)
        active = int(view.get("activeTab", "0")) if view is not None else 0
        sheets = wb.findall("m:sheets/m:sheet", _NS)
        rid = sheets[min(active, len(sheets) - 1)].get(f"{{{_NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("pr:Relationship", _NS) if r.get("Id") == rid)
        target = target.lstrip("/")
        self.path = target if target.startswith("xl/") else "xl/" + target
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            self.shared = [_plain_text(si) for si in _elements(z, "xl/sharedStrings.xml", "si")]
        self.date_styles: set[int] = set()
        if "xl/styles.xml" in z.namelist():
            st = ET.fromstring(z.read("xl/styles.xml"))
            custom = {int(n.get("numFmtId")): n.get("formatCode", "")
                      for n in st.findall("m:numFmts/m:numFmt", _NS)}
            for i, xf in enumerate(st.findall("m:cellXfs/m:xf", _NS)):
                fid = int(xf.get("numFmtId", "0"))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(fid, "")).lower()
                if fid in _DATE_FMT_IDS or (fid in custom and re.search(r"[dmyhs]", code)):
                    self.date_styles.add(i)

    def _value(self, t: str, style: str, text: str | None, inline: str | None) -> str | None:
        if t == "inlineStr":
            return inline
        if text is None:
            return None
        if t == "s":
            return self.shared[int(text)]
        if t == "b":
            return "True" if text == "1" else "False"
        if t in ("str", "e"):
            return text
        if int(style) in self.date_styles:
            return _excel_serial(float(text), self.date1904)
        return _number(text)

    def rows(self) -> Iterator[tuple[int, dict[int, str]]]:
        """(number, cells by column) of every row that has a value."""
        ri = last = 0
        known: dict[str, int] = {}  # column letters
        with self.z.open(self.path) as f:
            for number, found in _Rows().of(f):
                ri = ri + 1 if number is None else int(number)  # the references are optional: positions count then
                ci, cells = -1, {}
                for ref, t, style, text, inline in found:
                    letters = ref.rstrip("0123456789")
                    if letters in known and len(letters) < len(ref):
                        ci = known[letters]
                    else:
                        m = _CELL.fullmatch(ref)
                        ci = _col_index(m.group(1)) if m else ci + 1
                        if m and m.group(1) == letters:
                            known[letters] = ci
                    value = self._value(t, style, text, inline)
                    if value is not None:
                        cells[ci] = value
                if cells:
                    if ri <= last:
                        raise ValueError(f"row {ri} after row {last}")
                    last = ri
                    yield ri, cells

    def named(self) -> tuple[list[str], Iterator[tuple[int, dict[str, str]]]]:
        """The header - the first row with a value, a missing name as ``col_{i}`` - and the rows behind it: number
        from 0 and values by name, without those that are missing.  Rows without a value between others are
        empty.  A sheet is known to be readable as a whole before its first row comes out."""
        small = self.z.getinfo(self.path).file_size <= SHEET_BUFFER
        held, width = [], 0
        for row in self.rows():
            width = max(width, max(row[1]) + 1)
            if small or not held:
                held.append(row)
        if not held:
            return [], iter(())
        start, names = held[0]
        header = [names.get(i, f"col_{i}") for i in range(width)]
        place = {n: i for i, n in enumerate(header)}  # the last of two columns with one name counts
        mine = [place[n] == i for i, n in enumerate(header)]

        def behind():
            at = start + 1
            for ri, cells in held if small else self.rows():
                if ri == start:
                    continue
                while at < ri:
                    yield at - start - 1, {}
                    at += 1
                yield at - start - 1, {header[c]: v for c, v in cells.items() if mine[c]}
                at += 1

        return header, behind()


def parse_xlsx(data: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Active sheet of a small workbook: (header, rows) with cached cell values as text.

    A missing header cell becomes ``col_{i}``; date-formatted numbers become
    ISO date-times; booleans ``True``/``False``.
    """
    sheet = Sheet(data)
    rows = dict(sheet.rows())
    if not rows:
        return [], []
    header, _ = sheet.named()
    return header, [[rows.get(r, {}).get(c) for c in range(len(header))] for r in range(min(rows) + 1, max(rows) + 1)]


EXCEL_SCHEMA = T.StructType([
    T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType()),
    T.StructField("header", T.ArrayType(T.StringType())),
    T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
    T.StructField("skip_reason", T.StringType()),
])


def sheet_batches(rows: Iterator[tuple[int, dict[str, str]]]) -> Iterator[list[tuple[int, dict[str, str]]]]:
    """Rows in lists of at most ``SHEET_CELLS`` cells (and as many rows)."""
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += len(row[1]) + 1
        if n >= SHEET_CELLS:
            yield some
            some, n = [], 0
    if some:
        yield some


def parse_workbooks(files: DataFrame) -> DataFrame:
    """S4 core: ``files`` holds one workbook per row (``path``, and ``content`` or else the file is opened where
    it lies); every row of each workbook's active sheet comes out as a ``cells`` map (header -> text, cells
    without a value left out), the first one with the whole header.  A workbook that cannot be read as a whole yields one row with ``skip_reason``.
    Sheets are read row by row, in bounded memory, and a workbook is one task's work (the format ends at 1,048,576 rows)."""
    ranged = "content" not in files.columns

    def run(batches: Iterator):
        import pyarrow as pa

        cell_type = pa.map_(pa.string(), pa.string())

        def batch(path, rows, header, cells, reason):
            n = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.array([path] * n, pa.string()), pa.array(rows, pa.int64()), pa.array(header, pa.list_(pa.string())), cells,
                pa.array([reason] * n, pa.string())], names=EXCEL_SCHEMA.fieldNames())

        for b in batches:
            for k in range(b.num_rows):
                path = b.column(0)[k].as_py()
                try:
                    with ExitStack() as stack:
                        if ranged:
                            system, name = file_system(path)
                            sheet = Sheet(stack.enter_context(system.open_input_file(name)))
                        else:
                            sheet = Sheet(b.column(1)[k].as_py())
                        header, rows = sheet.named()
                        for some in sheet_batches(rows):
                            places = list(accumulate((len(cells) for _, cells in some), initial=0))
                            yield batch(path, [i for i, _ in some], [None if i else header for i, _ in some],
                                        pa.MapArray.from_arrays(
                                            pa.array(places, pa.int32()),
                                            pa.array([n for _, cells in some for n in cells], pa.string()),
                                            pa.array([v for _, cells in some for v in cells.values()], pa.string())), None)
                except GeneratorExit:
                    raise
                except Exception as exc:  # noqa: BLE001 - unreadable workbook -> skip the file
                    yield batch(path, [-1], [None], pa.array([None], cell_type), f"Failed to open Excel file {path}: {exc}")

    return files.select("path", *([] if ranged else ["content"])).mapInArrow(run, EXCEL_SCHEMA)


def read_excel_cells(spark: SparkSession, folder_or_glob: str, recursive: bool = False) -> DataFrame:
    """The ``.xlsx`` workbooks of a folder through ``parse_workbooks``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .option("pathGlobFilter", "*.xlsx").load(folder_or_glob))
    content = [] if can_read_ranges(folder_or_glob) else ["content"]
    return parse_workbooks(files.select(F.regexp_replace("path", "^file:", "").alias("path"), *content))


def excel_columns(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project the ``cells`` map onto named string columns (absent -> NULL)."""
    ok = cells.filter(F.col("skip_reason").isNull())
    return ok.select(FILE, ROW, *[F.col("cells").getItem(c).alias(c) for c in columns])


def read_csv_detected(spark: SparkSession, folder: str, hint: str | None = None,
                      schema: T.StructType | None = None, recursive: bool = False) -> DataFrame:
    """S1 + S6: detect each file's charset, then read each charset's files with its decoder.

    Columns are aligned by name across files (P3).  File names pass through the driver, as they
    do in Spark's own file index.
    """
    from intakeflow.sources.files import detect_charsets

    found: dict[str, list[str]] = {}
    for r in detect_charsets(spark, folder, hint, recursive).orderBy("path").collect():
        found.setdefault(r["charset"], []).append(r["path"])
    parts = [read_csv(spark, [as_glob(f) for f in files], encoding=name, schema=schema)
             for name, files in sorted(found.items())]
    if not parts:
        return read_csv(spark, folder, schema=schema, recursive=recursive)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
