"""Continuous file intake (T1-T3, T6-T8, K6, K2 in foreachBatch).

``readStream`` over the task folder is the watcher: the file source records
every file it has handed out in its checkpoint, so each file is processed
once across restarts (T6), ``maxFilesPerTrigger`` bounds a micro-batch (T3),
``trigger(processingTime=...)`` is the poll interval and
``trigger(availableNow=True)`` the manual "scan now" (T2), and ``cleanSource``
keeps / deletes / archives finished files (K6).

The stream is a listing: a micro-batch is a set of files, not rows.
It runs, in order: the claim decision on the ledger (L1: loaded, skipped and leased files
are left alone, failed ones wait for their back-off), SKIPPED events for files that are
not read (S5), CLAIMED events, one read of the claimed files, cleaning with a validity
flag (user code runs once per row: its result is kept), month routing, the first-wins
write, quality rows and alerts per file, and last the ledger SUCCESS events (the commit
point), also for files without rows.  When a set of files fails, its halves are tried
alone, so that a bad file ends as FAILED (and in time as DEAD_LETTER, K7) and never stops
the others (T8).  Replaying a batch after a crash re-inserts nothing (T7) and re-appends
quality rows, of which the latest per file is read (K3).
"""

from __future__ import annotations

import datetime as _dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from intakeflow.operators.cleaners import REASON, VALID
from intakeflow.errors import FAIL, error_kind, of_kind, raised_kind
from intakeflow.operators.ledger import (DAY_MS, KEY, OPEN_STATES, STATUS_EVENTS, append_events, backoff_delay, claim_decisions, claim_events,
                                         classify_outcome, conform, dead_letter, dead_letter_events, file_slice, fold,
                                         open_keys, write_open, write_quarantine)
from intakeflow.operators.quality import quality_report
from intakeflow.operators.conform import conform_to_target
from intakeflow.operators.route import FALLBACK, MONTH, route_months
from intakeflow.functions.columns import file_id, ts_lit
from intakeflow.functions.crypto import encrypt_fields
from intakeflow.operators.split import mark_row_errors, pass_through
from intakeflow.operators.writer import write_first_wins
from intakeflow.session import Beside, ensure_checkpoint_dir, path_exists
from intakeflow.sources.files import _ext, as_glob, list_paths, plain_path, with_format
from intakeflow.sources.readers import CORRUPT, FILE, ROW, Sheet, json_items, read_csv, sheet_batches
from intakeflow.spec import FORMATS, QUALITY_ALERT_MIN_SCORE, TaskSpec
from intakeflow.streaming.alerts import quality_alerts


# First-wins order inside a micro-batch: earlier-modified files first, then path, then row.
ARRIVAL_ORDER = ("_mtime", FILE, ROW)


@dataclass(frozen=True)
class IntakePaths:
    target: str
    ledger: str
    quality: str
    alerts: str
    checkpoint: str
    runs: str | None = None  # optional log of per-batch counters (A14)
    registry: str | None = None  # optional month registry (K8); its archived months are not written (L7)


def ext_glob(extensions, fmt: str) -> str:
    """Case-insensitive glob for the task's extensions that the reader ``fmt`` handles."""
    wanted = [e.lower() for e in extensions if FORMATS.get(e.lower()) == fmt and e.lower() != ".xls"]
    if not wanted:
        raise ValueError(f"task extensions {tuple(extensions)} include none read as {fmt}")
    pats = ["*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted]
    return pats[0] if len(pats) == 1 else "{" + ",".join(pats) + "}"


def _read_stream(spark: SparkSession, folder: str, fmt: str,
                 max_files: int | None, clean_source: str, archive_dir: str | None,
                 recursive: bool, glob: str) -> DataFrame:
    """The watcher: a stream of files (``path``, ``_mtime``, ``_size``)."""
    if fmt not in ("csv", "json", "excel"):
        raise ValueError(f"unsupported stream format {fmt}")
    binary = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                           T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    r = (spark.readStream.format("binaryFile").schema(binary).option("pathGlobFilter", glob)
         .option("recursiveFileLookup", str(recursive).lower()))
    if max_files:
        r = r.option("maxFilesPerTrigger", int(max_files))
    if clean_source != "off":
        r = r.option("cleanSource", clean_source)
        if clean_source == "archive":
            r = r.option("sourceArchiveDir", archive_dir)
    return r.load(folder).select(
        F.regexp_replace("path", "^file:", "").alias("path"),
        (F.unix_micros("modificationTime") / 1000).cast("long").alias("_mtime"), F.col("length").alias("_size"))


def _workbook_rows(files: DataFrame, schema: T.StructType) -> DataFrame:
    """S4 in the intake: one workbook per row, parsed in ``mapInPandas``; workbook by workbook."""
    names = schema.fieldNames()
    out = T.StructType(list(schema.fields) + [T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType()),
                                              T.StructField("_mtime", T.LongType()), T.StructField("_size", T.LongType()),
                                              T.StructField(CORRUPT, T.StringType())])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            for path, content, mt, size in zip(pdf["path"], pdf["content"], pdf["_mtime"], pdf["_size"]):
                try:
                    for some in sheet_batches(Sheet(bytes(content)).named()[1]):
                        yield pd.DataFrame([[cells.get(n) for n in names] + [path, i, mt, size, None]
                                            for i, cells in some], columns=out.fieldNames())
                except GeneratorExit:
                    raise
                except Exception as exc:  # noqa: BLE001 - unreadable workbook: the file is skipped
                    yield pd.DataFrame([[None] * len(names) + [path, -1, mt, size, f"Failed to open Excel file: {exc}"]],
                                       columns=out.fieldNames())

    return files.mapInPandas(run, out)


def _read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    if not path_exists(spark, path):  # no file has been recorded yet
        return None
    try:
        return spark.read.parquet(path).withColumn("task_id", F.col("task_id").cast("string"))
    except Exception as exc:  # noqa: BLE001 - a folder without data files yet
        if "UNABLE_TO_INFER" in str(exc):
            return None
        raise


def _drop_loaded_files(spark: SparkSession, batch: DataFrame, spec: TaskSpec, ledger_path: str) -> DataFrame:
    """Rows of files the ledger already holds as SUCCESS are dropped.

    A write to a path re-caches every cached plan that reads it, so the done-file keys
    are cut loose from the ledger path (reliable checkpoint) before the batch is cached
    and the ledger appended.  The ledger is partitioned by task: only this task's
    partition is read.
    """
    ledger = _read_ledger(spark, ledger_path)
    if ledger is None:
        return batch
    files = batch.select("task_id", FILE, "_mtime").distinct()
    done = ledger.filter((F.col("task_id") == spec.task_id) & (F.col("event") == "SUCCESS")).select(
        "task_id", F.col("file_path").alias(FILE), F.col("file_mtime").alias("_mtime"))
    ensure_checkpoint_dir(spark)
    done_here = files.join(done, ["task_id", FILE, "_mtime"], "left_semi").checkpoint(eager=True)
    return batch.join(done_here, ["task_id", FILE, "_mtime"], "left_anti")


def _split_unparsable(batch: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A file with a parse error is skipped whole; returns (rows, skipped files)."""
    if CORRUPT not in batch.columns:
        return batch, None
    bad = batch.filter(F.col(CORRUPT).isNotNull()).select(
        "task_id", FILE, "_mtime", "_size",
        F.when(F.col(CORRUPT).startswith("Failed to open"), F.substring(CORRUPT, 1, 300))
        .otherwise(F.concat(F.lit("parse error in "), F.element_at(F.split(FILE, "/"), -1)))
        .alias("error_message")).dropDuplicates(["task_id", FILE, "_mtime"])
    rows = batch.join(bad.select("task_id", FILE, "_mtime"), ["task_id", FILE, "_mtime"], "left_anti")
    return rows.drop(CORRUPT), bad


# Order of a batch's events in the ledger (their times may be equal).
CLAIM, OUTCOME, DEAD = 1, 5, 6


def _seq(batch_id: int, step: int):
    return F.lit(10 * int(batch_id) + step).cast("long")


def _ledger_events(per_file: DataFrame, bad: DataFrame | None, batch_id: int, now: _dt.datetime,
                   elapsed_ms: int) -> DataFrame:
    """SUCCESS events with counts for loaded files, SKIPPED events for unparsable ones."""
    events = conform(per_file.select(
        "task_id", F.col(FILE).alias("file_path"), F.col("_mtime").alias("file_mtime"),
        F.lit("SUCCESS").alias("event"), ts_lit(now).alias("event_time"),
        _seq(batch_id, OUTCOME).alias("seq"), F.lit(f"batch-{batch_id}").alias("owner"),
        F.col("_size").alias("file_size"), F.col("total_rows").alias("row_count"),
        F.col("valid_rows").alias("valid_row_count"), ts_lit(now).alias("processed_at"),
        # files of one micro-batch are processed together: each gets the batch's elapsed time
        F.lit(elapsed_ms).cast("long").alias("processing_time_ms")))
    if bad is None:
        return events
    return events.unionByName(conform(bad.select(
        "task_id", F.col(FILE).alias("file_path"), F.col("_mtime").alias("file_mtime"),
        F.col("_size").alias("file_size"), "error_message",
        F.lit("SKIPPED").alias("event"), ts_lit(now).alias("event_time"),
        _seq(batch_id, OUTCOME).alias("seq"), F.lit("ParseError").alias("error_type"))))


def _failed_files(rows: DataFrame) -> DataFrame:
    """(_file, _mtime, _size, kind, message) of the files with a row that fails them: the first fatal one, or the first."""
    kind = F.substring_index(FAIL, ":", 1)
    first = F.min(F.struct(kind != "fatal", F.col(ROW), F.col(FAIL))).getField(FAIL)
    return rows.where(F.col(FAIL).isNotNull()).groupBy(FILE, "_mtime", "_size").agg(first.alias(FAIL)).select(
        FILE, "_mtime", "_size", F.substring_index(FAIL, ":", 1).alias("kind"),
        F.expr(f"substring({FAIL}, locate(':', {FAIL}) + 2)").alias("message"))


def _failure_events(failed: DataFrame, batch_id: int, now: _dt.datetime) -> DataFrame:
    """SKIPPED, or FAILED as retryable (due again after its back-off) or fatal (dead-lettered at once)."""
    outcome = classify_outcome(F.col("kind"))
    return conform(failed.select(
        "task_id", F.col(FILE).alias("file_path"), F.col("_mtime").alias("file_mtime"), F.col("_size").alias("file_size"),
        F.when(outcome == "SKIPPED", outcome).otherwise(F.lit("FAILED")).alias("event"),
        F.when(outcome == "SKIPPED", F.lit("SkipFile")).when(outcome == "RETRY", F.lit("RetryableError"))
        .otherwise(F.lit("FatalError")).alias("error_type"),
        F.col("message").alias("error_message"), ts_lit(now).alias("event_time"), _seq(batch_id, OUTCOME).alias("seq")))


def _quality_rows(per_file: DataFrame, batch_id: int, now: _dt.datetime) -> DataFrame:
    return per_file.select(
        file_id("task_id", FILE, "_mtime").alias("file_id"),
        "task_id", F.col(FILE).alias("file_path"), ts_lit(now).alias("batch_time"),
        "total_rows", "valid_rows", "error_rows", "null_rate", "error_rate", "quality_score",
        "error_details", F.lit(int(batch_id)).alias("batch_id"))


def _write_run(spark: SparkSession, path: str, spec: TaskSpec, batch_id: int, now: _dt.datetime,
               per_file: DataFrame, counts: dict, elapsed_ms: int) -> None:
    """Raw / valid / error rows, writer counts and elapsed time of one batch."""
    totals = per_file.agg(F.count(F.lit(1)).alias("files"), F.sum("total_rows").alias("raw"),
                          F.sum("error_rows").alias("err")).first()
    raw, err = int(totals["raw"] or 0), int(totals["err"] or 0)
    run = spark.createDataFrame(
        [(spec.task_id, int(batch_id), now, int(totals["files"]), raw, raw - err, err,
          counts["inserted"], counts["ignored"], counts["fallback_routed"], counts["rejected_archived"],
          elapsed_ms)],
        "task_id string, batch_id long, run_at timestamp_ntz, files long, raw_count long, "
        "valid_count long, error_count long, inserted long, ignored long, fallback_routed long, "
        "rejected_archived long, elapsed_ms long")
    run.write.mode("append").parquet(path)


def process_batch(batch: DataFrame, batch_id: int, spec: TaskSpec, paths: IntakePaths,
                  flag: Callable[[DataFrame], DataFrame], as_of: Callable[[], _dt.datetime],
                  order_cols: tuple[str, ...],
                  prepare: Callable[[DataFrame], DataFrame] | None = None,
                  encryption_key: str | bytes | None = None,
                  target_schema: T.StructType | None = None,
                  files: DataFrame | None = None, failures: list | None = None,
                  claimed: Beside | None = None) -> dict:
    """One set of files' rows (``batch``: the parsed columns, ``_file``, ``_mtime``, ``_size``).

    ``prepare`` reshapes parsed rows first (e.g. ``explode_json_path`` for nested JSON);
    ``target_schema`` conforms valid rows to the month table's columns and types.  ``files``
    (``_file``, ``_mtime``, ``_size``) lists the claimed files, so that those without rows get
    their outcome too; without it the ledger decides which files' rows are dropped.  Files with a row whose
    ``_fail`` is set end as FAILED (or SKIPPED), none of their rows is written, and ``failures`` gets their number;
    the others are loaded in the same pass.  Without ``failures``, such a file's error is raised.  ``claimed`` is
    waited for before anything is written.
    """
    spark = batch.sparkSession
    started = time.monotonic()
    now = as_of()
    encrypted = list(spec.encrypt_fields or ())
    if encrypted and not encryption_key:
        raise ValueError("the task encrypts fields but no encryption key was given")
    if set(encrypted) & set(spec.keys):
        raise ValueError(f"key columns cannot be encrypted: {sorted(set(encrypted) & set(spec.keys))}")
    batch = batch.withColumn("task_id", F.lit(spec.task_id))
    if ROW not in batch.columns:  # each file is read by one task in order (multiLine)
        batch = batch.withColumn(ROW, F.monotonically_increasing_id())
    base = batch if files is not None else _drop_loaded_files(spark, batch, spec, paths.ledger)
    if CORRUPT in base.columns:
        base = base.persist()  # parse errors are looked for before the rows are used
    rows, bad = _split_unparsable(base)
    if prepare is not None:
        rows = prepare(rows)
    flagged = flag(rows)  # a NULL flag from user code means "not valid"
    flagged = flagged.withColumn(VALID, F.coalesce(F.col(VALID).cast("boolean"), F.lit(False)))
    routed = route_months(flagged, spec, now)
    if target_schema is not None:  # K1/G9: cast to the month table's schema; failures are row errors
        extra = tuple(c for c in (POS, FAIL) if c in routed.columns)
        routed = conform_to_target(routed, target_schema,
                                   keep=("task_id", FILE, ROW, "_mtime", "_size", MONTH, FALLBACK, *extra))
    # everything below reads this: files are read and user code runs once
    every = mark_row_errors(routed, spec.on_row_error).persist()
    failed = None
    beside: list[Beside] = []
    try:
        checked = every
        if FAIL in every.columns:
            failed = _failed_files(every).persist()
            n = failed.count()
            if n and failures is None:
                raise of_kind(*failed.select("kind", "message").orderBy(FILE).first())
            if n:
                failures.append(n)
            checked = every.drop(FAIL)
            if n:
                checked = checked.join(failed, [FILE, "_mtime"], "left_anti")
        # _file, _mtime and _row stay with the stored rows as provenance (and arrival order)
        valid = checked.filter(F.col(VALID)).drop(VALID, REASON, "task_id", "_size")
        order = [*order_cols, POS] if POS in checked.columns and POS not in order_cols else list(order_cols)
        finish = None
        if encrypted:  # P12: after routing and the choice of first rows, which read the plain text
            finish = lambda df: encrypt_fields(df, encrypted, encryption_key)
        report = quality_report(checked, ["task_id", FILE, "_mtime", "_size"], spec.required_fields).withColumn(
            "error_details", F.to_json("error_details"))

        def once_cached() -> None:
            if claimed is not None:
                claimed.result()
            beside.append(Beside(report.toArrow))

        counts = write_first_wins(valid, paths.target, list(spec.keys), order, finish=finish,
                                  archived_months=_archived(spark, paths, spec), cached=True, once_cached=once_cached)
        # one row a file, as the listing has; what is written of them needs no further plans over the rows
        per_file = spark.createDataFrame(beside[0].result()).coalesce(1)
        quality = _quality_rows(per_file, batch_id, now)

        def log() -> None:
            quality.write.mode("append").partitionBy("task_id").parquet(paths.quality)
            alerts = quality_alerts(quality, QUALITY_ALERT_MIN_SCORE)
            alerts.write.mode("append").partitionBy("task_id").parquet(paths.alerts)

        beside.append(Beside(log))
        done = per_file.select("task_id", FILE, "_mtime", "_size", "total_rows", "valid_rows")
        if files is not None:  # files without rows are loaded too, with none
            key = [FILE, "_mtime"]
            loaded = files
            for left_out in (bad, failed):
                loaded = loaded if left_out is None else loaded.join(left_out, key, "left_anti")
            zero = F.lit(0).cast("long")
            done = loaded.join(_side(per_file.select(*key, "total_rows", "valid_rows"), 0), key, "left").select(
                F.lit(spec.task_id).alias("task_id"), *key, "_size", F.coalesce("total_rows", zero).alias("total_rows"),
                F.coalesce("valid_rows", zero).alias("valid_rows"))
        elapsed_ms = int((time.monotonic() - started) * 1000)
        # the files' commit point; partitioned by task so per-task reads prune
        events = _ledger_events(done, bad, batch_id, now, elapsed_ms)
        if failed is not None:
            events = events.unionByName(_failure_events(failed.withColumn("task_id", F.lit(spec.task_id)), batch_id, now))
        beside[1].result()
        append_events(events, paths.ledger)
        if paths.runs:
            _write_run(spark, paths.runs, spec, batch_id, now, per_file, counts, elapsed_ms)
    finally:
        for work in beside:
            work.wait()
        for df in (base, every, failed):
            if df is not None and df.is_cached:
                df.unpersist()
    return counts


def _archived(spark: SparkSession, paths: IntakePaths, spec: TaskSpec) -> list[str]:
    """The task's archived months, from the registry where the intake has one (months are calendar-bounded)."""
    if not paths.registry or not path_exists(spark, paths.registry):
        return []
    reg = spark.read.parquet(paths.registry).filter(
        (F.col("task_id") == spec.task_id) & (F.col("lifecycle_status") == "ARCHIVED"))
    return sorted(r[0].replace("-", "") for r in reg.select("year_month").distinct().collect())


NO_ROWS = {"received": 0, "inserted": 0, "ignored": 0, "fallback_routed": 0, "rejected_archived": 0}


# A side of a join that is listed on the driver is broadcast up to so many files (some 20 MB), and shuffled beyond.
BROADCAST_FILES = 100_000
# Files that a batch run takes at once; more are taken in several rounds, in the order of arrival.
FILES_AT_ONCE = 50_000
# Files, and files left open, up to which a claim looks through their events on the driver.
FEW_FILES = 10_000


def _side(df: DataFrame, files: int) -> DataFrame:
    return F.broadcast(df) if files <= BROADCAST_FILES else df


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation (``createDataFrame`` of a list is a job's work each time it is read)."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [pa.field(n, kinds[k]) for n, k in (f.split() for f in schema.split(","))]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)],
                                                      schema=pa.schema(fields)))


def _days(files: list[tuple]) -> set[int]:
    return {-1 if m is None else m // DAY_MS for _, m, _ in files}


def _settled(events: list) -> set[tuple] | None:
    """The files whose last status is an end, as ``fold`` would find it; None if there are others, which it must decide."""
    last: dict[tuple, tuple] = {}
    for r in events:
        key, at = tuple(r[c] for c in KEY), (r.event_time, r.seq)
        if None in at:
            return None
        if r.event not in STATUS_EVENTS:
            last.setdefault(key, ((_dt.datetime.min, 0), set()))
            continue
        before = last.get(key)
        if before is None or at > before[0]:
            last[key] = (at, {r.event})
        elif at == before[0]:
            before[1].add(r.event)
    ended = all(states and states <= {"SUCCESS", "SKIPPED"} for _, states in last.values())
    return set(last) if ended else None


def _claim(spark: SparkSession, files: list[tuple], spec: TaskSpec, paths: IntakePaths, now: _dt.datetime,
           batch_id: int, owner: str, retry_due: bool) -> list[tuple]:
    """The files this run takes, written to the ledger as CLAIMED; SKIPPED for those not read."""
    todo, record = _decide(spark, files, spec, paths, now, batch_id, owner, retry_due)
    record()
    return todo


def _decide(spark: SparkSession, files: list[tuple], spec: TaskSpec, paths: IntakePaths, now: _dt.datetime,
            batch_id: int, owner: str, retry_due: bool) -> tuple[list[tuple], Callable[[], None]]:
    """The files this run takes, and what writes so to the ledger.

    With ``retry_due`` the ledger's failed files that are due and its expired claims are taken too.
    """
    name = "task_id string, file_path string, file_mtime long"
    key = f"{name}, file_size long, ext string"
    listed = _local(spark, [(spec.task_id, f, m, n, _suffix(f)) for f, m, n in files], key)
    # only the days of the listed files are read, and those of files that another run left open
    keys, days = _side(listed.select(*KEY), len(files)), _days(files)
    left_open = open_keys(spark, paths.ledger, spec.task_id)
    few = len(files) <= FEW_FILES
    if few:
        opened = [tuple(r) for r in left_open.limit(FEW_FILES + 1).collect()]
        few = len(opened) <= FEW_FILES
    if few:
        left_open = _local(spark, opened, name)
    if retry_due:
        if few:
            days |= _days([o[1:] + (None,) for o in opened])
            keys = F.broadcast(_local(spark, [(spec.task_id, f, m) for f, m, _ in files] + opened, name))
        else:
            left_open = left_open.persist()
            days |= {r[0] for r in left_open.select(F.coalesce(F.floor(F.col("file_mtime") / DAY_MS), F.lit(-1))).distinct().collect()}
            keys = listed.select(*KEY).unionByName(left_open)
    own = file_slice(spark, paths.ledger, spec.task_id, days).join(keys, list(KEY), "left_semi")
    settled = _settled(own.select(*KEY, "event", "event_time", "seq").collect()) if few else None
    if settled is not None:  # each of these files has ended or is new: no plan over the ledger is needed
        new = {(f, m): (spec.task_id, f, m, n, _suffix(f)) for f, m, n in reversed(files)
               if (spec.task_id, f, m) not in settled}
        listed = _local(spark, list(reversed(new.values())), key).withColumn("decision", F.lit("CLAIM_NEW"))
        still = None if retry_due else left_open
        return _take(spark, listed, still, True, spec, paths, now, batch_id, owner)
    current = fold(own, failed_at=True)
    if not few and own.isEmpty():  # nothing is known of these files
        current = current.limit(0)
    elif retry_due:
        current = current.persist()  # read for the files that are due, the decision and what stays open
    if retry_due:
        again = current.filter(F.col("status").isin("FAILED", "CLAIMED", "PROCESSING")).select(
            *KEY, "file_size", _ext(F.col("file_path")).alias("ext"))
        listed = listed.unionByName(again).dropDuplicates(list(KEY))
    mine = (F.col("prior_status") == "CLAIMED") & (F.col("claimed_by") == owner)  # this batch, replayed
    decided = claim_decisions(listed, current, now, spec.max_retries, ("claimed_by", "failed_at")).withColumn(
        "decision", F.when(mine, F.lit("CLAIM_RESUMED")).otherwise(F.col("decision")))
    due = F.col("failed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_delay(
        F.col("retry_count"), spec.retry_backoff))
    taken = (decided.filter(F.col("decision").startswith("CLAIM"))
             .filter((F.col("decision") != "CLAIM_RETRY") | F.col("failed_at").isNull() | (due <= ts_lit(now))))
    still = current.filter(F.col("status").isin(*OPEN_STATES) & ~F.col("dead_lettered")) if retry_due else left_open
    return _take(spark, taken, still, few, spec, paths, now, batch_id, owner, (current, left_open))


def _take(spark: SparkSession, taken: DataFrame, still: DataFrame | None, few: bool, spec: TaskSpec, paths: IntakePaths,
          now: _dt.datetime, batch_id: int, owner: str, kept: tuple = ()) -> tuple[list[tuple], Callable[[], None]]:
    """The files taken, and what records them: SKIPPED, or first as open (beside those that are ``still`` open) and then
    as CLAIMED; ``kept`` is given back then."""
    rows = with_format(taken.withColumnRenamed("file_path", "path")).withColumnRenamed("path", "file_path").select(
        *KEY, "file_size", "skip_reason", "decision").collect()  # the batch's own files
    skip = [r for r in rows if r.skip_reason is not None]
    todo = [r for r in rows if r.skip_reason is None]
    frame = lambda some, *more: _local(
        spark, [(r.task_id, r.file_path, r.file_mtime, r.file_size, *(r[c] for c in more)) for r in some],
        "task_id string, file_path string, file_mtime long, file_size long" + "".join(f", {c} string" for c in more))

    def record() -> None:
        if todo:  # before the claims, so that no claimed file is missing from it
            left = frame(todo).select(*KEY) if still is None else still.select(*KEY).unionByName(frame(todo).select(*KEY))
            write_open(left.coalesce(1) if few else left, paths.ledger, spec.task_id)
        for df in kept:
            df.unpersist()
        if skip:
            append_events(conform(frame(skip, "skip_reason").withColumnRenamed("skip_reason", "error_message").select(
                "*", F.lit("SKIPPED").alias("event"), ts_lit(now).alias("event_time"),
                _seq(batch_id, OUTCOME).alias("seq"), F.lit("SkipFile").alias("error_type"))), paths.ledger)
        if todo:
            claims = claim_events(frame(todo, "decision"), owner, now).withColumn("seq", _seq(batch_id, CLAIM))
            append_events(claims.coalesce(1) if few else claims, paths.ledger)

    return [(r.file_path, r.file_mtime, r.file_size) for r in todo], record


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def _of_document(schema: T.StructType, spec: TaskSpec) -> bool:
    """Whether a schema is that of whole JSON documents, which ``prepare`` takes apart, and not of their items."""
    parts = [p for p in (spec.json_path or "").split(".") if p and p != "item"]
    return bool(parts) and parts[0] in schema.fieldNames()


def _file_rows(spark: SparkSession, files: list[tuple], spec: TaskSpec, schema: T.StructType,
               fmt: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the files with their identity, and the files as a table."""
    listed = _local(spark, files, f"{FILE} string, _mtime long, _size long")
    names = [as_glob(f) for f, _, _ in files]
    if fmt == "csv":
        rows = read_csv(spark, names, spec.encoding or "utf-8", schema)
    elif fmt == "excel":
        books = spark.read.format("binaryFile").load(names).select(
            F.regexp_replace("path", "^file:", "").alias("path"), "content")
        return _workbook_rows(books.join(_side(listed.withColumnRenamed(FILE, "path"), len(files)), "path"), schema), listed
    elif not _of_document(schema, spec):
        fields = [f for f in schema.fields if f.name != CORRUPT]
        item = F.from_json("item", T.StructType(fields), {"mode": "PERMISSIVE"}).alias("_item")
        rows = json_items(spark, names, spec.json_path).select(
            F.col("file").alias(FILE), F.col("row").alias(ROW),
            F.when(F.col("fault").isNotNull(), F.lit("parse error")).alias(CORRUPT), item).select(
            FILE, ROW, CORRUPT, *[F.col(f"_item.`{f.name}`") for f in fields])
    else:
        if CORRUPT not in schema.fieldNames():
            schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        rows = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).json(names)
                .withColumn(FILE, plain_path(F.col("_metadata.file_path"))))
        rows = rows.withColumn(ROW, F.monotonically_increasing_id())
    return rows.join(_side(listed, len(files)), FILE), listed


def process_files(spark: SparkSession, files: list[tuple], batch_id: int, spec: TaskSpec, paths: IntakePaths,
                  flag: Callable[[DataFrame], DataFrame], as_of: Callable[[], _dt.datetime],
                  schema: T.StructType, fmt: str, order_cols: tuple[str, ...] = ARRIVAL_ORDER,
                  owner: str | None = None, isolate_errors: bool = True, retry_due: bool = False, **options) -> dict:
    """Claim, read and load a set of files ``(path, mtime, size)``; returns the summed counts of the writer.

    Files that fail as data (``_fail``) cost no second pass.  An error that ends the job of a set of files leads to
    its halves, down to the file that causes it, which is recorded as FAILED, or SKIPPED, by the error's class;
    ``isolate_errors=False`` raises instead, and so does an error that is no file's fault (a lost
    executor, a full disk): the claims run out and the files are taken again.
    """
    owner = owner or f"run-{batch_id}"
    todo, record = _decide(spark, files, spec, paths, as_of(), batch_id, owner, retry_due)
    claimed = Beside(record)  # the files are read meanwhile; nothing of them is written before
    try:
        return _load(spark, todo, claimed, batch_id, spec, paths, flag, as_of, schema, fmt, order_cols, isolate_errors,
                     options)
    finally:
        claimed.wait()


def _load(spark: SparkSession, todo: list[tuple], claimed: Beside, batch_id: int, spec: TaskSpec, paths: IntakePaths,
          flag: Callable[[DataFrame], DataFrame], as_of: Callable[[], _dt.datetime], schema: T.StructType, fmt: str,
          order_cols: tuple[str, ...], isolate_errors: bool, options: dict) -> dict:
    """Load the claimed files; the summed counts of the writer."""
    total = dict(NO_ROWS)
    stack = [todo] if todo else []
    failures: list[int] = []
    while stack:
        some = stack.pop()
        try:
            rows, listed = _file_rows(spark, some, spec, schema, fmt)
            counts = process_batch(rows, batch_id, spec, paths, flag, as_of, order_cols, files=listed, claimed=claimed,
                                   failures=failures if isolate_errors else None, **options)
            total = {k: total[k] + counts[k] for k in total}
        except Exception as exc:  # noqa: BLE001 - user code, unreadable files
            claimed.result()  # a claim that cannot be written is no file's fault
            text = str(exc)
            kind = raised_kind(text) if isinstance(exc, PySparkException) or not str(type(exc).__module__).startswith(
                "intakeflow") else error_kind(exc)
            if not isolate_errors or kind == "infrastructure":
                raise
            if len(some) > 1:
                stack += [some[len(some) // 2:], some[:len(some) // 2]]
                continue
            failures.append(1)
            (path, mtime, size), now = some[0], as_of()
            append_events(_failure_events(spark.createDataFrame(
                [(spec.task_id, path, mtime, size, kind, _error_line(text))],
                f"task_id string, {FILE} string, _mtime long, _size long, kind string, message string"), batch_id, now),
                paths.ledger)
    claimed.result()
    if failures:  # K7: what no further attempt can mend
        now = as_of()
        mine = spark.createDataFrame([(spec.task_id, f, m) for f, m, _ in todo], "task_id string, file_path string, file_mtime long")
        own = file_slice(spark, paths.ledger, spec.task_id, _days(todo))
        state = fold(own.join(_side(mine, len(todo)), list(KEY), "left_semi")).filter("not dead_lettered")
        ensure_checkpoint_dir(spark)
        dead = dead_letter(state, spec.max_retries).checkpoint(eager=True)  # read before the ledger is appended to
        append_events(dead_letter_events(dead, now).withColumn("seq", _seq(batch_id, DEAD)), paths.ledger)
        write_quarantine(dead, paths.ledger.rstrip("/") + "_dead_letter")
    return total


def _error_line(text: str) -> str:
    """The message of an error without stack traces, at most 300 characters."""
    for mark in ("[USER_RAISED_EXCEPTION] ", "Exception: ", "Error: "):
        if mark in text:
            text = text[text.rindex(mark) + len(mark):] if mark != "[USER_RAISED_EXCEPTION] " else \
                text[text.index(mark) + len(mark):]
            break
    return text.strip().splitlines()[0][:300] if text.strip() else ""


def start_intake(spark: SparkSession, folder: str, spec: TaskSpec, schema: T.StructType, paths: IntakePaths,
                 flag: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "csv",
                 max_files_per_trigger: int | None = None, clean_source: str = "off",
                 archive_dir: str | None = None, recursive: bool = False,
                 available_now: bool = False, poll_seconds: int | None = None,
                 as_of: Callable[[], _dt.datetime] | None = None,
                 order_cols: tuple[str, ...] = ARRIVAL_ORDER,
                 prepare: Callable[[DataFrame], DataFrame] | None = None,
                 encryption_key: str | bytes | None = None,
                 target_schema: T.StructType | None = None, isolate_errors: bool = True) -> StreamingQuery:
    """Start the intake stream for one task; returns the running query.

    ``fmt`` is ``csv`` (``spec.encoding`` applies), ``json`` or ``excel``; for JSON with a
    nested ``spec.json_path`` ``schema`` is that of the items, and a document is read by many tasks; with the
    schema of whole documents pass ``prepare=lambda df: explode_json_path(df, spec.json_path)``.
    Every micro-batch also takes the ledger's failed files that are due again.
    """
    stream = _read_stream(spark, folder, fmt, max_files_per_trigger, clean_source,
                          archive_dir, recursive, ext_glob(spec.extensions, fmt))
    flag = flag or pass_through
    clock = as_of or (lambda: _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    options = {"prepare": prepare, "encryption_key": encryption_key, "target_schema": target_schema}

    def run(df: DataFrame, batch_id: int) -> None:
        files = [tuple(r) for r in df.select("path", "_mtime", "_size").collect()]  # at most one trigger's files
        process_files(df.sparkSession, files, batch_id, spec, paths, flag, clock, schema, fmt, order_cols,
                      owner=f"{paths.checkpoint}#{batch_id}", isolate_errors=isolate_errors, retry_due=True, **options)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", paths.checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif poll_seconds:
        w = w.trigger(processingTime=f"{int(poll_seconds)} seconds")
    return w.start()


def run_batch_intake(spark: SparkSession, folder: str, spec: TaskSpec, schema: T.StructType, paths: IntakePaths,
                     flag: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "csv",
                     recursive: bool = False, run_id: int = 0,
                     as_of: Callable[[], _dt.datetime] | None = None,
                     order_cols: tuple[str, ...] = ARRIVAL_ORDER,
                     prepare: Callable[[DataFrame], DataFrame] | None = None,
                     encryption_key: str | bytes | None = None,
                     target_schema: T.StructType | None = None, isolate_errors: bool = True) -> dict:
    """The batch twin of ``start_intake``: every file of the folder in one run (the ledger
    decides which are taken).  Files with one of the task's extensions that are empty or not
    readable are recorded as SKIPPED.  Returns the writer's counts."""
    if fmt not in ("csv", "json", "excel"):
        raise ValueError(f"unsupported format {fmt}")
    wanted = {e.lower() for e in spec.extensions if FORMATS.get(e.lower()) in (fmt, None) or e.lower() == ".xls"}
    files = [f for f in list_paths(spark, folder, recursive) if _suffix(f[0]) in wanted]
    files.sort(key=lambda f: (f[1], f[0]))
    clock = as_of or (lambda: _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    total = dict(NO_ROWS)
    for k in range(0, max(1, len(files)), FILES_AT_ONCE):
        counts = process_files(spark, files[k:k + FILES_AT_ONCE], run_id, spec, paths, flag or pass_through, clock, schema,
                               fmt, order_cols, isolate_errors=isolate_errors, prepare=prepare,
                               encryption_key=encryption_key, target_schema=target_schema)
        total = {c: total[c] + counts[c] for c in total}
    return total


# Place of an item in its document; orders rows after ``_row``.
POS = "_pos"


def explode_json_path(df: DataFrame, json_path: str) -> DataFrame:
    """S3 inside a micro-batch: rows of the array at ``json_path`` (``data.item`` style), in the
    order (``_row``, ``_pos``)."""
    parts = [p for p in json_path.split(".") if p and p != "item"]
    if not parts:
        return df
    arr = F.col(parts[0])
    for p in parts[1:]:
        arr = arr.getField(p)
    keep = [c for c in df.columns if c.startswith("_") or c == "task_id"]
    return df.select(*keep, F.posexplode(arr).alias(POS, "_item")).select(*keep, POS, "_item.*")


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """The month-partitioned target as one table; files written from drifting deliveries
    (no fixed target schema) are merged by column name (P3)."""
    return (spark.read.option("basePath", path).option("mergeSchema", True).parquet(path)
            .withColumn(MONTH, F.col(MONTH).cast("string")))


__all__ = ["IntakePaths", "KEY", "process_batch", "process_files", "read_target", "run_batch_intake", "start_intake"]
