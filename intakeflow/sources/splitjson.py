"""JSON documents read by many tasks each (S2, S3): a parallel scan of strings and brackets.

Documents are dealt out in byte ranges that end at a closing brace: tasks read them where the files lie, in
stretches of a megabyte; on file systems that only Spark reads, and of compressed files, Spark's text source hands
out the pieces between closing braces.  What a range does to a reader is a function of whether it starts inside a string: whether it ends inside one, how many
containers it closes that it did not open, and which it leaves open (their kind, and their key in the object
around them).  Such functions combine associatively, so the open containers at each range's start follow
from those before it.  A range is then parsed alone: containers down to the array at the path are
walked, everything below them goes to the standard library's parser, runs of the array's items in one call, and
the items come out as texts.
An item that runs over a border is put together from its parts.

What the driver holds is the open containers at the ranges of large documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.sources import splitcsv
from intakeflow.sources.files import can_read_ranges, file_system

BATCH = 10_000  # items of an Arrow batch at most
BATCH_BYTES = 8 << 20
STRETCH = 1 << 20  # bytes read at once
RUN = 300  # items parsed in one call at most
DEEPEST = 900  # containers inside each other; deeper documents do not parse
UNKNOWN = 0  # the key of a container whose key's start is not in the bytes at hand
_CLOSER = {"{": "}", "[": "]"}
_SPACE = b" \t\r\n"

_BLANK = re.compile(r"[ \t\n\r]*")
_NEXT_OBJECT = {"first": re.compile(rb"[ \t\n\r]*(?={)"), "after": re.compile(rb"[ \t\n\r]*,[ \t\n\r]*(?={)")}
_NEXT_OBJECT["next"] = _NEXT_OBJECT["first"]
# names that Spark's text source unpacks
_PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$"
_CODE = np.zeros(256, np.int8)
_CODE[[ord("{"), ord("[")]] = 1
_CODE[[ord("}"), ord("]")]] = -1

Open = tuple[str, str | int | None]      # kind and key of an open container
Effect = tuple[bool, int, list[Open]]    # ends inside a string, containers closed, containers left open


def _constant(name: str):
    raise ValueError(f"{name} is no JSON value")


_DECODER = json.JSONDecoder(parse_constant=_constant, parse_float=str, parse_int=str)


def key_before(data: bytes, at: int) -> str | int | None:
    """The key of the container that opens at a place; UNKNOWN if its start is not in the data."""
    def back(end):
        while end and data[end - 1] in _SPACE:
            end -= 1
        return end

    end = back(at)
    if data[end - 1:end] != b":":
        return None
    end = back(end - 1)
    if data[end - 1:end] != b'"':
        return None
    start = end - 1
    while True:
        start = data.rfind(b'"', 0, start)
        if start < 0:
            return UNKNOWN
        slash = start
        while slash and data[slash - 1] == 92:
            slash -= 1
        if (start - slash) % 2 == 0:
            break
    try:
        return json.loads(data[start:end])
    except ValueError:
        return None


def _escaped(b: np.ndarray, quotes: np.ndarray) -> np.ndarray:
    """Which quotes stand behind an odd number of backslashes."""
    odd = np.zeros(len(quotes), bool)
    some = np.flatnonzero((quotes > 0) & (b[quotes - 1] == 92))
    step = 1
    while len(some):  # those with so many backslashes before them, at least
        odd[some] = step % 2 == 1
        step += 1
        at = quotes[some]
        some = some[(at >= step) & (b[at - step] == 92)]
    return odd


class Scan:
    """Strings and brackets of a stretch of a document that does not start behind a backslash."""

    def __init__(self, data: bytes):
        self.data = data
        b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == 34)
        if b"\\" in data:
            quotes = quotes[~_escaped(b, quotes)]
        code = _CODE[b]
        self.at = np.flatnonzero(code)
        self.sign = code[self.at].astype(np.int64)
        self.odd = np.searchsorted(quotes, self.at) % 2 == 1
        self.quotes = len(quotes)

    def outside(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the brackets outside strings, and the containers open after each, less those before."""
        some = self.odd == inside
        return self.at[some], np.cumsum(self.sign[some])

    def effect(self, inside: bool) -> Effect | None:
        """What the stretch does, from either state at its start; None if it nests too deep."""
        at, depth = self.outside(inside)
        ends = (self.quotes + inside) % 2 == 1
        if not len(at):
            return ends, 0, []
        later = np.minimum.accumulate(depth[::-1])[::-1]
        opens = (np.diff(depth, prepend=0) > 0) & (later >= depth)
        left = at[opens].tolist()
        if len(left) > DEEPEST:
            return None
        return ends, max(0, -int(depth.min())), [(self.data[p:p + 1].decode(), key_before(self.data, p)) for p in left]


def combine(a: Effect | None, b: Effect | None) -> Effect | None:
    """The effect of one stretch after another (associative)."""
    if a is None or b is None or len(a[2]) + len(b[2]) > 2 * DEEPEST:
        return None
    keep = a[2][:max(0, len(a[2]) - b[1])]
    return b[0], a[1] + max(0, b[1] - len(a[2])), [*keep, *b[2]]


class Cutter:
    """The items of the array at a path, cut out of a range whose start's state is known.

    The range is cut behind every closing brace after which no container below the array is open; the pieces
    between are parsed one by one, with the containers open before them."""

    def __init__(self, parts: Sequence[str], inside: bool = False, stack: Sequence[Open] = (), first: bool = True,
                 texts: bool = True):
        self.parts, self.level = list(parts), len(parts) + 1
        self.texts = texts  # without them items are parsed and not handed out
        self.inside, self.depth = inside, len(stack)
        self.stack: list[Open] = list(stack)
        self.phase = "root" if first else "after" if stack else "done"
        self.skip = inside or self.depth > self.level  # up to the end of what an earlier range began
        self.start = (inside, list(stack))
        self.head: list[bytes] = []
        self.rest: list[bytes] = []
        self.at = self.rest_at = 0

    def is_target(self) -> bool:
        return (len(self.stack) == self.level and self.stack[-1][0] == "["
                and all(kind == "{" for kind, _ in self.stack[:-1])
                and [key for _, key in self.stack[1:]] == self.parts)

    def feed(self, data: bytes) -> list[tuple[int, str]]:
        """(place in the range, text) of the items that are complete with these bytes."""
        scan = Scan(data)
        at, depth = scan.outside(self.inside)
        depth = depth + self.depth
        if len(depth) and (depth.max() > DEEPEST or depth.min() < 0):
            raise ValueError("brackets do not match")
        closing = np.frombuffer(data, np.uint8)[at] == 125
        closing &= depth <= self.level
        cuts = (at[closing] + 1).tolist()
        lower = [*np.flatnonzero(depth[closing] < self.level).tolist(), len(cuts)]  # these pieces close the array
        self.inside = (scan.quotes + self.inside) % 2 == 1
        self.depth = int(depth[-1]) if len(depth) else self.depth
        out, lo, k, below = [], 0, 0, 0
        while k < len(cuts):
            while lower[below] < k:
                below += 1
            upto = min(lower[below], k + RUN)
            if not self.skip and not self.rest and upto - k > 1:
                some = self.parse_objects(data, lo, cuts[k:upto])
                if some is not None:
                    out += some
                    k = upto
                    lo = cuts[k - 1]
                    self.rest_at = self.at + lo
                    continue
            hi, k = cuts[k], k + 1
            piece = data[lo:hi]
            if self.skip:
                self.head.append(piece)
                self.behind_head()
            else:
                if self.rest:
                    piece = b"".join([*self.rest, piece])
                    self.rest = []
                out += self.parse(piece, self.rest_at)
            lo = hi
            self.rest_at = self.at + hi
        if lo < len(data):
            (self.head if self.skip else self.rest).append(data[lo:])
        self.at += len(data)
        return out

    def parse_objects(self, data: bytes, lo: int, ends: list[int]) -> list[tuple[int, str]] | None:
        """The items of a run of pieces that are one object of the array each, parsed in one call; None if they are
        anything else or do not parse."""
        gap = _NEXT_OBJECT.get(self.phase)
        gap = gap.match(data, lo) if gap and self.is_target() else None
        if gap is None:
            return None
        body = data[gap.end():ends[-1]]
        try:
            text = body.decode("utf-8")
            values = _DECODER.decode(f"[{text}]")
        except FAULTS:
            return None
        if len(values) != len(ends) or set(map(type, values)) != {dict}:
            return None
        self.phase = "after"
        if not self.texts:
            return []
        if len(text) == len(body):
            base = gap.end()
            cut = [text[a - base:b - base] for a, b in zip([base, *ends], ends)]
        else:
            cut = [data[a:b].decode("utf-8") for a, b in zip([gap.end(), *ends], ends)]
        places = [self.rest_at, *[self.at + e for e in ends[:-1]]]
        return [(p, x.lstrip(", \t\r\n")) for p, x in zip(places, cut)]

    def behind_head(self) -> None:
        inside, stack = self.start
        effect = combine((inside, 0, stack), Scan(b"".join(self.head)).effect(inside))
        if effect is None or effect[1]:
            raise ValueError("brackets do not match")
        self.stack = effect[2]
        if any(key == UNKNOWN for _, key in self.stack[:self.level]):
            raise LookupError("key over a border")
        self.phase, self.skip = "after" if self.stack else "done", False

    def last(self) -> list[tuple[int, str]]:
        """Items of what is left at the document's end, which must end here."""
        out = []
        if not self.skip:
            out = self.parse(b"".join(self.rest), self.rest_at)
            if self.phase != "done":
                raise ValueError("the document is not complete")
        return out

    def parse(self, piece: bytes, place: int) -> list[tuple[int, str]]:
        text = piece.decode("utf-8")
        if place == 0 and self.phase == "root":
            text = text.removeprefix("﻿")
        out, n, stack, target = [], len(text), self.stack, self.is_target()
        blank, decode = _BLANK.match, _DECODER.raw_decode
        i = blank(text, 0).end()
        while i < n:
            c, phase, key = text[i], self.phase, None
            if phase == "after":
                if c == ",":
                    self.phase = "next"
                    i = blank(text, i + 1).end()
                    continue
                if c != _CLOSER[stack[-1][0]]:
                    raise ValueError(f"unexpected {c!r}")
            if phase == "after" or (phase == "first" and c == _CLOSER[stack[-1][0]]):
                stack.pop()
                target = self.is_target()
                self.phase = "after" if stack else "done"
                i = blank(text, i + 1).end()
                continue
            if phase == "done":
                raise ValueError("text behind the document")
            if stack and stack[-1][0] == "{":
                if c != '"':
                    raise ValueError("a key is missing")
                key, i = decode(text, i)
                i = blank(text, i).end()
                if text[i:i + 1] != ":":
                    raise ValueError("a colon is missing")
                i = blank(text, i + 1).end()
                c = text[i:i + 1]
            if c in ("{", "[") and len(stack) < self.level:
                stack.append((c, key))
                target = self.is_target()
                self.phase = "first"
                i = blank(text, i + 1).end()
                continue
            _, end = decode(text, i)
            if target and self.texts:
                out.append((place + len(out), text[i:end]))
            self.phase = "after" if stack else "done"
            i = blank(text, end).end()
        return out


# ValueError also covers what does not decode; LookupError: the document is read in one piece
FAULTS = (ValueError, RecursionError)


def _ranges(batches) -> Iterator[tuple]:
    """(file, at, ends, whole, size, bytes, is the last of the range) stretch by stretch.

    The last piece of a range comes without its brace, since a document's last piece may have none."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    batches = chain([first], batches)
    if "stop" in first.schema.names:
        for b in batches:
            for file, at, stop, whole, size in zip(*(b[c].to_pylist() for c in ("file", "at", "stop", "whole", "size"))):
                yield from _read_range(file, at, stop, whole, size)
        return
    key, held = None, None
    for file, at, ends, whole, body, _, size in _sized(batches):
        if (file, at) != key:
            if key is not None:
                yield *key, *held[1:], held[0], True
            key, held = (file, at), None
        if held is not None:
            body = [held[0], *body]
        if len(body) > 1:
            yield file, at, ends, whole, size, b"}".join(body[:-1]) + b"}", False
        held = (body[-1], ends, whole, size)
    if key is not None:
        yield *key, *held[1:], held[0], True


def _read_range(file: str, at: int, stop: int, whole: bool, size: int) -> Iterator[tuple]:
    """A range's stretches, read where the file lies.  A range goes from behind the first closing brace at its start
    or later (a document's first range: from the document's start) to the first one at its end or later."""
    system, name = file_system(file)
    with system.open_input_file(name) as f:
        pos, rest, begun = at, [], at == 0
        while pos < size:
            data = f.read_at(min(STRETCH, size - pos), pos)
            if not data:
                raise EOFError(f"{file} is shorter than when it was listed")
            here, pos = pos, pos + len(data)
            if not begun:
                k = data.find(b"}", 0, None if pos <= stop else max(0, stop - here))
                if k < 0:
                    if pos >= stop:
                        return  # no range's piece starts here
                    continue
                data, here, begun = data[k + 1:], here + k + 1, True
                if here == size:
                    return
            end = data.find(b"}", max(0, stop - here)) + 1 if pos > stop else 0
            if end and here + end < size:
                yield file, at, False, whole, size, b"".join([*rest, data[:end - 1]]), True
                return
            if pos < size:
                k = data.rfind(b"}") + 1
                if k:
                    yield file, at, False, whole, size, b"".join([*rest, data[:k]]), False
                    rest = []
                rest.append(data[k:])
            else:
                yield file, at, True, whole, size, b"".join([*rest, data]).removesuffix(b"}"), True


def _sized(batches) -> Iterator[tuple]:
    for b in batches:
        seen = 0
        for run in splitcsv._runs([b]):
            yield *run, b.column(6)[seen].as_py()
            seen += len(run[4])


def pieces(spark: SparkSession, paths: Sequence[str], recursive: bool) -> DataFrame:
    """(file, at, stop, whole, size): the ranges of all documents; or else (line, file, at, ends, whole, n, size),
    pieces that end at a closing brace, which is left out.

    Ranges are as large as Spark's own."""
    path = F.col("path")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
             .select(F.regexp_replace(path, "^file:", "").alias("file"), F.col("length").alias("size")))
    total = files.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"), F.max("file").alias("file"),
                      F.count_if(F.col("file").rlike(_PACKED)).alias("packed")).first()
    if not total["files"] or total["packed"] or not can_read_ranges(total["file"]):
        return splitcsv.lines(spark, paths, recursive, sep="}")
    cores = spark.sparkContext.defaultParallelism
    most, least = (_bytes(spark, f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes"))
    n = max(1, min(most, max(least, total["bytes"] // cores)))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(n).cast("long"))).alias("at")
    stop = F.least(F.col("at") + n, "size")
    ranges = files.where("size > 0").select("file", at, "size").select(
        "file", "at", stop.alias("stop"), (F.col("size") <= n).alias("whole"), "size")
    tasks = min(total["files"] + total["bytes"] // n, max(4 * cores, -(-total["bytes"] // n)))
    return ranges.repartition(int(max(1, tasks)))


def _bytes(spark: SparkSession, key: str) -> int:
    """A setting's bytes, as Spark writes them ("134217728b", "16m")."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)


def _has_last_brace(read: int, size: int) -> bool:
    """Whether a document's last piece ends at a brace; a byte order mark of three bytes is not handed out."""
    return read in (size, size - 3)


def effects(found: DataFrame) -> DataFrame:
    """(file, at, ends, size, bytes, outside, inside): every range's effect as JSON, from either state at its start."""
    def run(batches):
        import pyarrow as pa

        both, read = None, 0
        for file, at, ends, _, size, data, last in _ranges(batches):
            if both is None:
                both, read = [(False, 0, []), (True, 0, [])], 0
            if last:
                read += len(data) + 1
                data = data if ends else data + b"}"
            else:
                read += len(data)
            scan = Scan(data)
            both = [x and combine(x, scan.effect(x[0])) for x in both]
            if last:
                yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "ends": ends, "size": size, "bytes": read,
                                                   "outside": json.dumps(both[0]), "inside": json.dumps(both[1])}],
                                                 schema=schema)
                both = None

    import pyarrow as pa
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("ends", pa.bool_()), ("size", pa.int64()),
                        ("bytes", pa.int64()), ("outside", pa.string()), ("inside", pa.string())])
    return found.mapInArrow(run, "file string, at long, ends boolean, size long, bytes long, outside string, inside string")


class Plan:
    """What is known of documents of more than one range: the state at each range's start, whether the
    last piece ends at a brace, documents that do not parse and those to be read in one piece."""

    def __init__(self):
        self.state: dict[tuple[str, int], tuple[bool, list[Open]]] = {}
        self.brace: dict[str, bool] = {}
        self.bad: set[str] = set()
        self.single: set[str] = set()

    def add(self, file: str, rows: list, level: int) -> None:
        """The ranges of one document, in order."""
        now: Effect = (False, 0, [])
        self.brace[file] = _has_last_brace(sum(r["bytes"] for r in rows), rows[0]["size"])
        for r in rows:
            self.state[file, r["at"]] = (now[0], now[2])
            if any(key == UNKNOWN for _, key in now[2][:level]):
                self.single.add(file)
            effect = json.loads(r["inside" if now[0] else "outside"])
            if effect is None:
                self.bad.add(file)
                return
            now = combine(now, (effect[0], effect[1], [tuple(x) for x in effect[2]]))
            if now is None:
                self.bad.add(file)
                return
        if self.brace[file] and not now[0]:
            now = combine(now, (False, 1, []))
        if now != (False, 0, []):
            self.bad.add(file)


def plan(found: DataFrame, parts: Sequence[str]) -> Plan:
    """The plan of all documents of more than one range; those that do not parse are found here."""
    p, level = Plan(), len(parts) + 1
    by: dict[str, list] = {}
    for r in effects(found.where("not whole")).collect():
        by.setdefault(r["file"], []).append(r)
    for file, rows in by.items():
        p.add(file, sorted(rows, key=lambda r: r["at"]), level)
    if len(p.bad) < len(by):
        faults = cut(found.where("not whole"), parts, p, False).where("fault is not null")
        for r in faults.select("file", "fault").distinct().collect():
            (p.single if r["fault"] == "piece" else p.bad).add(r["file"])
    p.bad -= p.single
    return p


ITEMS = "file string, row long, item string, fault string"


def _batch(pa, file: str, at: int, items: list[tuple[int, str]], fault: str | None = None):
    """Rows of a range rise and are its own: a range's first piece starts behind its first byte."""
    n = 1 if fault else len(items)
    base = at + (at > 0)
    return pa.RecordBatch.from_arrays([
        pa.array([file] * n, pa.string()), pa.array([None] if fault else [base + p for p, _ in items], pa.int64()),
        pa.array([None] if fault else [x for _, x in items], pa.string()), pa.array([fault] * n, pa.string())],
        names=["file", "row", "item", "fault"])


def cut(found: DataFrame, parts: Sequence[str], known: Plan, items: bool = True) -> DataFrame:
    """(file, row, item, fault): the items of all documents; one row with a fault instead for a document of one
    range that does not parse, or for a range of a larger one.  Without ``items`` the faults only."""
    parts = list(parts)
    shared = found.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        known_ = shared.value
        cutter, ready, size_, fault, read = None, [], 0, None, 0
        for file, at, ends, whole, size, data, last in _ranges(batches):
            if file in known_.bad or file in known_.single:
                continue
            if cutter is None:
                inside, stack = (False, []) if whole else _state(known_, file, at)
                cutter, ready, size_, fault, read = Cutter(parts, inside, stack, at == 0, items), [], 0, None, 0
            read += len(data) + last
            if last and (not ends or (_has_last_brace(read, size) if whole else known_.brace[file])):
                data += b"}"
            if fault is None:
                try:
                    some = cutter.feed(data)
                    if last and ends:
                        some += cutter.last()
                    if items:
                        ready += some
                        size_ += sum(len(x) for _, x in some)
                except FAULTS:
                    fault = "parse"
                except LookupError:
                    fault = "piece"
            # a document of one range is held back until all of it has parsed
            if fault is None and ready and (last or (not whole and (len(ready) >= BATCH or size_ >= BATCH_BYTES))):
                for s in range(0, len(ready), BATCH):
                    yield _batch(pa, file, at, ready[s:s + BATCH])
                ready, size_ = [], 0
            if last:
                if fault is not None:
                    yield _batch(pa, file, at, [], fault)
                cutter = None

    out = found.mapInArrow(run, ITEMS)
    if known.state:
        out = out.unionByName(_over_borders(found.where("not whole"), parts, shared))
    return out if items else out.where("fault is not null")


def _state(known: Plan, file: str, at: int) -> tuple[bool, list[Open]]:
    if (file, at) not in known.state:
        raise RuntimeError(f"{file} was dealt out in other ranges than before")
    return known.state[file, at]


def _over_borders(found: DataFrame, parts: list[str], shared) -> DataFrame:
    """The items of pieces that start in one range and end in another, put together from their parts."""
    def run(batches):
        import pyarrow as pa

        known_, cutter = shared.value, None
        for file, at, ends, _, _, data, last in _ranges(batches):
            if file in known_.bad or file in known_.single:
                continue
            if cutter is None:
                cutter = Cutter(parts, *_state(known_, file, at), at == 0, False)
                ok = True
            if last and (not ends or known_.brace[file]):
                data += b"}"
            try:
                if ok:
                    cutter.feed(data)
            except (*FAULTS, LookupError):  # told by the other pass
                ok = False
            if last:
                rows = []
                if cutter.head:
                    rows.append((None, None, None, b"".join(cutter.head), ends and cutter.skip))
                if not cutter.skip and not ends and ok and cutter.rest:
                    rows.append((at + (at > 0) + cutter.rest_at, json.dumps(cutter.stack), cutter.phase,
                                 b"".join(cutter.rest), False))
                if rows and ok:
                    start, stack, phase, part, closes = zip(*rows)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([file] * len(rows), pa.string()), pa.array([at] * len(rows), pa.int64()),
                        pa.array(start, pa.int64()), pa.array(stack, pa.string()), pa.array(phase, pa.string()),
                        pa.array(part, pa.binary()), pa.array(closes, pa.bool_())],
                        names=["file", "at", "start", "stack", "phase", "part", "closes"])
                cutter = None

    some = found.mapInArrow(
        run, "file string, at long, start long, stack string, phase string, part binary, closes boolean")
    before = Window.partitionBy("file").orderBy("at", F.col("start").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # behind a range with a fault a part may have no record
    whole = some.withColumn("record", F.last("start", ignorenulls=True).over(before)).where("record is not null")

    def put_together(pdf):
        import pyarrow as pa

        pdf = pdf.sort_values(["at", "start"], na_position="first")
        file, place = pdf["file"].iloc[0], int(pdf["record"].iloc[0])
        cutter = Cutter(parts, False, [tuple(x) for x in json.loads(pdf["stack"].iloc[0])], False)
        cutter.phase = pdf["phase"].iloc[0]
        try:
            got = cutter.parse(b"".join(bytes(p) for p in pdf["part"]), 0)
            if pdf["closes"].iloc[-1] and cutter.phase != "done":
                raise ValueError("the document is not complete")
        except FAULTS:
            return _batch(pa, file, 0, [], "parse").to_pandas()
        return _batch(pa, file, 0, [(place + k, x) for k, x in got]).to_pandas()

    return whole.groupBy("file", "record").applyInPandas(put_together, ITEMS)


def cut_single(texts: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(file, row, item, fault) of documents ``(file, line)`` that are handed out in one piece each."""
    parts = list(parts)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cutter = Cutter(parts)
                try:
                    got = cutter.feed(data) + cutter.last()
                except FAULTS:
                    yield _batch(pa, file, 0, [], "parse")
                    continue
                for s in range(0, len(got), BATCH):
                    yield _batch(pa, file, 0, got[s:s + BATCH])

    return texts.mapInArrow(run, ITEMS)


# -- the columns of items -----------------------------------------------------------------------------------------

def shape(value, known=None):
    """The shape of a JSON value joined with a known one: a dict of fields, a list of one shape, "string" or None.
    Values of different shapes are read as strings."""
    if value is None:
        return known
    if known == "string":
        return known
    if isinstance(value, dict):
        if known is None:
            known = {}
        if not isinstance(known, dict):
            return "string"
        for k, v in value.items():
            if known.get(k, "") != "string":
                known[k] = shape(v, known.get(k))
        return known
    if isinstance(value, list):
        if known is None:
            known = [None]
        if not isinstance(known, list):
            return "string"
        for v in value:
            known[0] = shape(v, known[0])
        return known
    return "string"


def shape_of(texts: Sequence[str]) -> dict:
    """The joined shape of all items that are objects."""
    known: dict = {}
    for text in texts:
        value = _DECODER.decode(text)
        if isinstance(value, dict):
            known = shape(value, known)
    return known


def join_shapes(a, b):
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: join_shapes(a.get(k), b.get(k)) for k in {**a, **b}}
    if isinstance(a, list) and isinstance(b, list):
        return [join_shapes(a[0], b[0])]
    return "string"


def as_type(s) -> T.DataType | None:
    """The Spark type of a shape: fields by name, what is always null a string, objects without fields left out."""
    if isinstance(s, dict):
        fields = [T.StructField(k, t) for k, t in ((k, as_type(s[k])) for k in sorted(s)) if t is not None]
        return T.StructType(fields) if fields else None
    if isinstance(s, list):
        inner = as_type(s[0])
        return None if inner is None else T.ArrayType(inner)
    return T.StringType()


def item_schema(items: DataFrame) -> T.StructType:
    """The columns of all items that are objects, primitive values as strings."""
    def run(batches):
        import pyarrow as pa

        known = {}
        for b in batches:
            known = join_shapes(known, shape_of(b.column(0).to_pylist()))
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(known, sort_keys=True)])], names=["shape"])

    found = None
    for r in items.where("item is not null").select("item").mapInArrow(run, "shape string").distinct().collect():
        found = join_shapes(found, json.loads(r["shape"]))
    return as_type(found or {}) or T.StructType([])
