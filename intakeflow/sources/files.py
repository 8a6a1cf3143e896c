"""File manifest, fingerprints and charset detection (S5, S6, S7, S8, L8 listing, J2).

Listing uses the ``binaryFile`` source; when the ``content`` column is not
selected no file bytes are read.  Fingerprints and charset detection read ranges of
files inside the tasks, a few kilobytes of files of any size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.sources import charset
from intakeflow.spec import EXTENSIONS, FINGERPRINT_SAMPLE, FORMATS


def plain_path(uri: Column) -> Column:
    """The file path of a ``_metadata.file_path`` (percent-encoded URI), as listings show it."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:(//(?=/))?", ""), F.lit("+"), F.lit("%2B")))


def as_glob(path: str) -> str:
    """A path that readers must not take for a pattern."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _ext(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("."), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise(F.lit(""))


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS,
               recursive: bool = False, modified_after: str | None = None) -> DataFrame:
    """Directory listing (path, file_name, ext, file_size, file_mtime ms, modified_at).

    Extensions are matched lower-cased (G12); ``modified_after`` is the
    incremental-poll bound (``YYYY-MM-DDTHH:MM:SS``).  Spark's file scan does
    not hand out zero-byte files, so they never appear here (nothing to load).
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    df = r.load(folder).select("path", "modificationTime", "length")
    exts = [e.lower() for e in extensions]
    out = df.select(
        F.regexp_replace("path", "^file:", "").alias("path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        _ext(F.col("path")).alias("ext"),
        F.col("length").alias("file_size"),
        (F.unix_micros(F.col("modificationTime")) / 1000).cast("long").alias("file_mtime"),
        F.col("modificationTime").alias("modified_at"))
    return out.filter(F.col("ext").isin(*exts))


def list_paths(spark: SparkSession, folder: str, recursive: bool = False) -> list[tuple[str, int, int]]:
    """``(path, mtime in ms, size)`` of a folder's files, zero-byte ones included, from the Hadoop
    FileSystem on the driver (file names pass through it, as they do in Spark's own file index)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(path, recursive)
    while it.hasNext():
        st = it.next()
        name = st.getPath().toString()
        base = name.rsplit("/", 1)[-1]
        if not base.startswith(("_", ".")):  # hidden files, as in Spark's listing
            found.append((name.removeprefix("file:"), st.getModificationTime(), st.getLen()))
    return sorted(found)


def with_format(manifest: DataFrame) -> DataFrame:
    """``fmt`` by extension and ``skip_reason`` for empty / unsupported files."""
    fmt = F.coalesce(*[F.when(F.col("ext") == e, F.lit(f)) for e, f in FORMATS.items()])
    reason = (F.when(F.col("file_size") == 0, F.concat(F.lit("Empty file: "), F.col("path")))
              .when(fmt.isNull(), F.concat(F.lit("Unsupported format: "), F.col("ext")))
              .when(F.col("ext") == ".xls", F.lit("Legacy .xls workbooks are not readable")))
    return manifest.withColumn("fmt", fmt).withColumn("skip_reason", reason)


def _binary(spark: SparkSession, folder: str, recursive: bool, modified_after: str | None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if modified_after:  # incremental poll: bytes of older files are never read
        r = r.option("modifiedAfter", modified_after)
    return r.load(folder)


# ---------------------------------------------------------------------------
# Ranged reads: a few kilobytes of files of any size
# ---------------------------------------------------------------------------
def file_system(path: str):
    """The file system of a path as listings show it, and the file's name there."""
    from pyarrow import fs

    if re.match(r"[a-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.LocalFileSystem(), path


def can_read_ranges(folder: str) -> bool:
    """Whether Arrow knows the folder's file system; where it does not, whole files pass through Spark's source."""
    import pyarrow as pa

    try:
        file_system(folder.removeprefix("file:"))
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _per_file(files: DataFrame, value: Callable[[Callable[[int, int], bytes], int], object], out: str, ranged: bool) -> DataFrame:
    """``(path, length)`` and the columns ``out`` that ``value(read, size)`` gives for every file, where
    ``read(offset, bytes)`` reads a range of it."""
    schema = T.StructType.fromDDL(f"path string, length long, {out}")
    names = schema.fieldNames()[2:]
    some = files.select(F.regexp_replace("path", "^file:", "").alias("path"), "length",
                        *([] if ranged else ["content"]))

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, size, *content in pdf.itertuples(index=False):
                if ranged:
                    system, name = file_system(path)
                    with system.open_input_file(name) as f:
                        rows.append(value(lambda at, n: f.read_at(min(n, max(0, size - at)), at), size))  # noqa: B023
                else:
                    rows.append(value(lambda at, n: bytes(content[0])[at:at + n], size))  # noqa: B023
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"],
                                **{n: [r[i] for r in rows] for i, n in enumerate(names)}})

    return some.mapInPandas(run, schema)


def _ends(read: Callable[[int, int], bytes], size: int) -> tuple[bytes, bytes]:
    n = FINGERPRINT_SAMPLE
    return read(0, n), read(size - n, n) if size > 2 * n else b""


def fingerprints(spark: SparkSession, folder: str, recursive: bool = False,
                 modified_after: str | None = None) -> DataFrame:
    """S8 for the files of a folder (modified after ``modified_after`` when given):
    ``(path, file_size, file_hash)``: first 16 hex of md5(first 4 KiB + last 4 KiB when size > 8 KiB + decimal
    size).  Only these bytes are read, in the tasks.
    """
    files = _binary(spark, folder, recursive, modified_after)
    ends = _per_file(files, _ends, "head binary, tail binary", can_read_ranges(folder))
    size = F.col("length").cast("string").cast("binary")
    return ends.select("path", F.col("length").alias("file_size"),
                       F.substring(F.md5(F.concat("head", "tail", size)), 1, 16).alias("file_hash"))


# ---------------------------------------------------------------------------
# Charset detection
# ---------------------------------------------------------------------------
def sniff_charset(data: bytes, rest: bytes | None = None) -> str:
    """Charset of a file's content (``charset.charset_of``)."""
    data = data + (rest or b"")
    return charset.charset_of(lambda at, n: data[at:at + n], len(data))


def detect_charsets(spark: SparkSession, folder: str, hint: str | None = None,
                    recursive: bool = False, modified_after: str | None = None) -> DataFrame:
    """``(path, charset)`` per file.  An explicit hint wins.  Samples of the head and the middle are read, and
    more only of files that are plain ASCII there."""
    files = _binary(spark, folder, recursive, modified_after)
    if hint and hint != "auto":
        return files.select(F.regexp_replace("path", "^file:", "").alias("path"), F.lit(hint).alias("charset"))
    return _per_file(files, lambda read, size: (charset.charset_of(read, size),), "charset string",
                     can_read_ranges(folder)).select("path", "charset")
