"""CSV files read by many tasks each (S1): a parallel scan of the quotes.

Spark's text source deals a file out in byte ranges and hands every range its physical lines.  At a line's
start a CSV reader is in one of two states: at a record's start, or inside a quoted cell.  So a range is
a function from two states to two states, and functions combine associatively: the state at each range's
start follows from those before it, without a task reading the file from its start.  Every range
then parses the records that start in it; a record that runs over a border is put together from its parts.

Ranges' functions are needed for files of more than one range only.  What the driver holds is a header
and the ranges of such files, as Spark's own file index and scheduler do.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, ROW = "_file", "_row"
BATCH = 10_000  # records of an Arrow batch at most
BATCH_BYTES = 8 << 20
# a quoted cell starts at a line's start or after a comma (a carriage return ends a record, too)
_QUOTED = re.compile(rb'[,\r]"')
_CELL_END = re.compile(rb"[,\r]")


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that starts inside quotes, or at a record's start, ends inside quotes.

    A quote opens a cell only as its first character, two quotes inside are one, and what follows
    the closing quote belongs to the cell."""
    at = 0
    if not inside and line[:1] != b'"':
        m = _QUOTED.search(line)
        if m is None:
            return False
        at = m.end()
    elif not inside:
        at = 1
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1:at + 2] == b'"':
            at += 2
            continue
        m = _CELL_END.search(line, at + 1)
        if m is None:
            return False
        if line[m.end():m.end() + 1] == b'"':
            at = m.end() + 1
            continue
        m = _QUOTED.search(line, m.end())
        if m is None:
            return False
        at = m.end()


class Range:
    """The records that start in a byte range, line by line."""

    def __init__(self, inside: bool, keep_head: bool = False):
        self.inside = self.skip = inside
        self.keep_head, self.head = keep_head, []
        self.open: list[bytes] = []
        self.at = self.start = 0

    def feed(self, lines: list[bytes], quotes: list[bool] | None) -> list[tuple[int, bytes]]:
        """(place in the range, record) of the records that end in these lines; ``quotes``: None if none has one."""
        if quotes is None:
            if not self.inside:
                places = list(accumulate(map(len, lines), lambda a, n: a + n + 1, initial=self.at))
                self.at = places.pop()
                return list(zip(places, lines))
            quotes = [False] * len(lines)
        out = []
        for line, quote in zip(lines, quotes):
            if self.inside:
                self.inside = not quote or ends_inside(line, True)
                if self.skip:
                    if self.keep_head:
                        self.head.append(line)
                    self.skip = self.inside
                else:
                    self.open.append(line)
                    if not self.inside:
                        out.append((self.start, b"\n".join(self.open)))
                        self.open = []
            elif quote and ends_inside(line, False):
                self.inside, self.open, self.start = True, [line], self.at
            else:
                out.append((self.at, line))
            self.at += len(line) + 1
        return out

    def last(self) -> list[tuple[int, bytes]]:
        """What is left open, as a record: at a file's end."""
        return [(self.start, b"\n".join(self.open))] if self.open else []


def lines(spark: SparkSession, paths: Sequence[str], recursive: bool = False, glob: str | None = None,
          sep: str = "\n") -> DataFrame:
    """(line, file, at, ends, whole, n, size): physical lines with their file's path and range, whether the range is
    the file's last and whether it is its only one, and the file's size.

    Ranges must be the same in every pass: the number of cores at the first is kept as the setting that Spark deals
    ranges by, and ``n`` keeps filters from reaching the source, which would deal out fewer files."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    r = spark.read.option("lineSep", sep).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    m = F.col("_metadata")
    return r.text(list(paths)).select(
        F.col("value").cast("binary").alias("line"), m["file_path"].alias("file"),
        m["file_block_start"].alias("at"),
        (m["file_block_start"] + m["file_block_length"] >= m["file_size"]).alias("ends"),
        ((m["file_block_start"] == 0) & (m["file_block_length"] >= m["file_size"])).alias("whole"),
        F.monotonically_increasing_id().alias("n"), m["file_size"].alias("size"))


def _path(uri: str) -> str:
    """A file's path as listings show it, from its percent-encoded URI."""
    return unquote(re.sub(r"^file:(//(?=/))?", "", uri))


def _runs(batches) -> Iterator[tuple]:
    """(file, at, ends, whole, lines, whether each has a quote or None) of the lines of one range in one batch."""
    import numpy as np
    import pyarrow.compute as pc

    known: dict[str, str] = {}
    for b in batches:
        if not b.num_rows:
            continue
        ends = pc.run_end_encode(b.column(1)).run_ends.to_numpy()
        turns = np.flatnonzero(np.diff(b.column(2).to_numpy())) + 1
        cut = [0, *sorted({*ends.tolist(), *turns.tolist()})]
        quote = pc.match_substring(b.column(0), '"')
        body = b.column(0).to_pylist()
        for s, e in zip(cut, cut[1:]):
            uri = b.column(1)[s].as_py()
            if uri not in known:
                known[uri] = _path(uri)
            own = quote.slice(s, e - s)
            yield (known[uri], b.column(2)[s].as_py(), b.column(3)[s].as_py(), b.column(4)[s].as_py(), body[s:e],
                   own.to_pylist() if own.true_count else None)


def decode(record: bytes, encoding: str) -> str:
    return record.decode(encoding, "replace")


def cells(records: list[str]) -> list[list[str | None]]:
    """The cells of records, an empty cell without quotes as None."""
    csv.field_size_limit(2**31 - 1)
    try:
        rows = list(csv.reader(records, quoting=csv.QUOTE_NOTNULL))
        if len(rows) == len(records):
            return rows
    except csv.Error:
        pass
    # records parted by lone carriage returns, or a quote that never closes
    return [row for r in records for row in csv.reader(io.StringIO(r, newline=""), quoting=csv.QUOTE_NOTNULL) if row]


def first_row(record: bytes) -> tuple[bytes, bytes]:
    """A record up to a carriage return outside quotes, and what follows: rows of a file without line feeds."""
    parts = record.split(b"\r")
    n = 1
    while n < len(parts) and ends_inside(b"\r".join(parts[:n]), False):
        n += 1
    return b"\r".join(parts[:n]), b"\r".join(parts[n:])


def header_of(record: bytes, encoding: str) -> list[str]:
    """The names in a header record."""
    rows = cells([decode(first_row(record)[0], encoding).lstrip("\ufeff")])
    return ["" if c is None else c for c in rows[0]] if rows else []


def headers(found: DataFrame, encoding: str) -> DataFrame:
    """(file, header): the first record that is not blank of every file's first range."""
    def run(batches):
        import pyarrow as pa

        key, part, done = None, None, True
        for file, at, _, _, body, quote in _runs(batches):
            if (file, at) != key:
                if not done and part is not None and part.open:
                    yield _header_batch(pa, key[0], part.last()[0][1], encoding)
                key, part, done = (file, at), Range(False), at != 0
            if not done:
                for _, record in part.feed(body, quote):
                    if record.strip():
                        yield _header_batch(pa, file, record, encoding)
                        done = True
                        break
        if not done and part is not None and part.open:
            yield _header_batch(pa, key[0], part.last()[0][1], encoding)

    return found.mapInArrow(run, "file string, header array<string>")


def _header_batch(pa, file: str, record: bytes, encoding: str):
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([header_of(record, encoding)], pa.list_(pa.string()))],
                                      names=["file", "header"])


def transitions(found: DataFrame, encoding: str) -> DataFrame:
    """(file, at, outside, inside, header): whether a range ends inside quotes if it starts outside, or inside, quotes,
    and of a file's first range its first record that is not blank."""
    def run(batches):
        import pyarrow as pa

        key, state, part, header = None, [False, True], None, None

        def row():
            some = header_of(part.last()[0][1], encoding) if part is not None and part.open else header
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([state[0]]),
                                               pa.array([state[1]]), pa.array([some], pa.list_(pa.string()))],
                                              names=["file", "at", "outside", "inside", "header"])

        for file, at, _, _, body, quote in _runs(batches):
            if (file, at) != key:
                if key is not None:
                    yield row()
                key, state, part, header = (file, at), [False, True], None if at else Range(False), None
            if part is not None:
                record = next((r for _, r in part.feed(body, quote) if r.strip()), None)
                if record is not None:
                    part, header = None, header_of(record, encoding)
            for line, q in zip(body, quote or ()):
                if q:  # a line without quotes changes neither state
                    first = ends_inside(line, state[0])
                    state = [first, first if state[0] == state[1] else ends_inside(line, state[1])]
        if key is not None:
            yield row()

    return found.mapInArrow(run, "file string, at long, outside boolean, inside boolean, header array<string>")


def starts(functions: DataFrame) -> DataFrame:
    """(file, at, starts_inside) and further columns: the composition of all ranges' functions before each range.

    A range either fixes the state it ends in, or keeps it, or turns it: the state is that after the last
    range that fixes it (at first: outside), turned as often as ranges after that one turn it."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.col("outside") & ~F.col("inside")).cast("int")
    f = functions.withColumn("turns", F.sum(turn).over(Window.partitionBy("file").orderBy("at")))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "turns"))
    last = F.last(fixed, ignorenulls=True).over(before)
    so_far = F.coalesce(F.max("turns").over(before), F.lit(0))
    turned = F.pmod(so_far - F.coalesce(last["turns"], F.lit(0)), F.lit(2)) == 1
    more = [c for c in functions.columns if c not in ("file", "at", "outside", "inside")]
    return f.select("file", "at", (F.coalesce(last["outside"], F.lit(False)) != turned).alias("starts_inside"), *more)


def _columns(pa, names: list[str], header: list[str], rows: list[list]) -> list:
    """Arrays of the wanted columns of rows; the last of two columns with one name counts."""
    place = {n: i for i, n in enumerate(header)}
    width = max((place[n] + 1 for n in names if n in place), default=0)
    if rows and min(map(len, rows)) >= width:
        columns = list(zip(*rows))
    else:
        columns = [[r[i] if i < len(r) else None for r in rows] for i in range(width)]
    return [pa.nulls(len(rows), pa.string()) if n not in place else pa.array(columns[place[n]], pa.string()) for n in names]


def _texts(records: list[bytes], encoding: str) -> list[str]:
    """Decoded records; together, where none holds a line end."""
    together = b"\n".join(records)
    if together.count(b"\n") == len(records) - 1:
        out = decode(together, encoding).split("\n")
        if len(out) == len(records):
            return out
    return [decode(r, encoding) for r in records]


def _parse(pa, names: list[str], header: list[str], file: str, at: int, found: list[tuple[int, bytes]], encoding: str):
    """A record batch of parsed records (place in the range, bytes)."""
    found = [(place, r) for place, r in found if r and r != b"\r"]
    texts = _texts([r for _, r in found], encoding) if found else []
    rows = cells(texts)
    if len(rows) == len(texts):
        places = [at + place for place, _ in found]
    else:  # a record held several rows, or none
        rows, places = [], []
        for (place, _), text in zip(found, texts):
            some = cells([text])
            rows += some
            places += [at + place + i for i in range(len(some))]
    return pa.RecordBatch.from_arrays(
        [*_columns(pa, names, header, rows), pa.DictionaryArray.from_arrays(
            pa.array([0] * len(rows), pa.int32()), pa.array([file], pa.string())).cast(pa.string()), pa.array(places, pa.int64())],
        names=[*names, FILE, ROW])


def read_split_csv(spark: SparkSession, paths: Sequence[str], names: Sequence[str], encoding: str = "utf-8",
                   recursive: bool = False, glob: str | None = None) -> DataFrame:
    """The columns ``names`` as strings, ``_file`` and ``_row``, of all CSV files.

    ``_row`` rises with the records of a file.  Files of one range are read once; of larger ones the ranges' states
    are found first.  A column that a file's header lacks is NULL; short records are filled with NULL, further
    cells left out, blank lines skipped; an unquoted empty cell is NULL, undecodable bytes become U+FFFD.
    The charset must write quotes, commas and line ends as ASCII does.
    """
    names = list(names)
    found = lines(spark, paths, recursive, glob)
    large = found.where("not whole")
    known: dict[str, list[str]] = {}
    ranges: dict[tuple[str, int], bool] = {}  # whether a range starts inside quotes
    # file names and ranges pass through the driver, as they do in Spark's file index
    for r in starts(transitions(large, encoding)).collect():
        ranges[r["file"], r["at"]] = r["starts_inside"]
        if r["header"] is not None:
            known[r["file"]] = r["header"]
    if not known:
        ranges.clear()
    shared = spark.sparkContext.broadcast((known, ranges))
    fields = [T.StructField(n, T.StringType()) for n in names]
    schema = T.StructType([*fields, T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())])

    def run(batches):
        import pyarrow as pa

        headers_, ranges_ = shared.value
        key, part, header, ready, size, last = None, None, None, [], 0, False

        def flush():
            nonlocal ready, size
            batch = _parse(pa, names, header, key[0], key[1], ready, encoding)
            ready, size = [], 0
            return batch

        def close():
            nonlocal ready
            if last:
                ready += part.last()
            if header is None:  # the file's only record is its header, or none is
                ready = []
            if ready:
                yield flush()

        for file, at, ends, whole, body, quote in _runs(batches):
            if (file, at) != key:
                if part is not None:
                    yield from close()
                if not whole and (file, at) not in ranges_:
                    raise RuntimeError(f"{file} was dealt out in other ranges than before")
                key, part, ready, size, last = (file, at), Range(ranges_.get((file, at), False)), [], 0, ends
                header = headers_.get(file) if at else None
            some = part.feed(body, quote)
            if header is None:
                k = next((k for k, (_, r) in enumerate(some) if r.strip()), None)
                if k is None:
                    continue
                header, more = header_of(some[k][1], encoding), first_row(some[k][1])[1]
                some = [(some[k][0], more)] * bool(more) + some[k + 1:]
            ready += some
            size += sum(len(r) for _, r in some)
            if len(ready) >= BATCH or size >= BATCH_BYTES:
                yield flush()
        if part is not None:
            yield from close()

    out = found.drop("n", "size").mapInArrow(run, schema)
    if any(ranges.values()):
        out = out.unionByName(_over_borders(found, names, schema, shared, encoding))
    return out


def _over_borders(found: DataFrame, names: list[str], schema: T.StructType, shared, encoding: str) -> DataFrame:
    """The records that start in one range and end in another, put together from their parts."""
    files = frozenset({file for (file, _), inside in shared.value[1].items() if inside})

    def parts(batches):
        import pyarrow as pa

        ranges_ = shared.value[1]
        key, part = None, None

        def rows():
            out = []
            if part.head:
                out.append((key[0], key[1], None, b"\n".join(part.head)))
            if part.open:
                out.append((key[0], key[1], key[1] + part.start, b"\n".join(part.open)))
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())],
                names=["file", "at", "start", "part"])

        for file, at, _, _, body, quote in _runs(batches):
            if file not in files:
                continue
            if (file, at) != key:
                if part is not None:
                    yield rows()
                key, part = (file, at), Range(ranges_[file, at], keep_head=True)
            part.feed(body, quote)
        if part is not None:
            yield rows()

    # a head belongs to the last record that was left open before it
    some = found.mapInArrow(parts, "file string, at long, start long, part binary")
    before = Window.partitionBy("file").orderBy("at", F.col("start").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    whole = some.withColumn("record", F.last("start", ignorenulls=True).over(before)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("file", "record"))).where("n > 1")

    def put_together(pdf):
        import pyarrow as pa

        pdf = pdf.sort_values("at")
        file = pdf["file"].iloc[0]
        record = b"\n".join(bytes(p) for p in pdf["part"])
        return _parse(pa, names, shared.value[0][file], file, int(pdf["record"].iloc[0]), [(0, record)], encoding).to_pandas()

    return whole.groupBy("file", "record").applyInPandas(put_together, schema)
