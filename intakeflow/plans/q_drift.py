"""Driver queries over awkward deliveries: drifting headers, bad files, archived months, odd numbers and dates.

The deliveries are written from the test tables into the shared scratch folder and read as real
ones (S1, S5, S6, P3, P12, K7, L5, L7, T8, U1, F1, F5, A10).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.errors import RetryableError, SkipFileError
from intakeflow.functions.columns import avg_half_up_sql, month_suffix, to_number
from intakeflow.plans import reports as R
from intakeflow.plans.catalog import AS_OF_ORDERS, register
from intakeflow.plans.q_sources import CSV_ROWS_PER_FILE, delivery_count
from intakeflow.session import scratch_path
from intakeflow.sources.files import fingerprints
from intakeflow.sources.fixtures import DQ_SQL, PF_SQL, ledger_rows, quality_log_rows, table, with_cte
from intakeflow.sources.readers import read_csv, read_csv_detected
from intakeflow.spec import TaskSpec


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"deliveries-{name}-{uuid.uuid4().hex[:8]}")


def _csv(df: DataFrame, path: str, files: int | None = None, encoding: str = "UTF-8") -> None:
    df = df.repartition(files) if files and files > 1 else df.coalesce(1) if files else df
    (df.write.option("header", True).option("escape", '"').option("encoding", encoding)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


@register("csv_header_drift", oracle="""
SELECT l_returnflag, count(*) AS row_count, CAST(sum(l_orderkey) AS BIGINT) AS order_sum,
       CAST(sum(l_linenumber) AS BIGINT) AS line_sum,
       count(l_linestatus) FILTER (WHERE l_orderkey % 4 <> 2) AS statuses,
       CAST(sum(CASE WHEN l_orderkey % 4 = 3 THEN 40 * (length(CAST(l_suppkey AS VARCHAR)) + 4) END) AS BIGINT) AS note_chars
FROM lineitem GROUP BY 1
""")
def csv_header_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem delivered with its columns in order, permuted, with one missing and one more, and in large
    files whose header and cells hold quotes, commas and line ends, each read in several ranges."""
    li = table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    out = _folder(spark, "drift")
    part = F.col("l_orderkey") % 4
    _csv(li.where(part == 0).select(*cols), f"{out}/in order")
    _csv(li.where(part == 1).select(*reversed(cols)), f"{out}/permuted+100%")
    _csv(li.where(part == 2).select("l_returnflag", F.lit("more").alias("other"), "l_linenumber", "l_orderkey"),
         f"{out}/fewer")
    note = F.repeat(F.concat(F.lit('"'), F.col("l_suppkey").cast("string"), F.lit(',\n"')), 40)
    rest = li.where(part == 3)
    _csv(rest.select(note.alias("note,\nlong"), *cols), f"{out}/large", delivery_count(rest.count(), 1))
    names = [*cols, "note,\nlong"]
    rows = read_csv(spark, out, schema=T.StructType([T.StructField(c, T.StringType()) for c in names]), recursive=True)
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("l_orderkey").cast("bigint")).alias("order_sum"),
        F.sum(F.col("l_linenumber").cast("bigint")).alias("line_sum"), F.count("l_linestatus").alias("statuses"),
        F.sum(F.length("note,\nlong")).alias("note_chars"))


@register("charset_headers", oracle="""
SELECT o_orderstatus AS status, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1
""")
def charset_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with Chinese column names, as UTF-8 and (columns swapped) as GBK, in folders with blanks."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("编号"), F.col("o_orderstatus").alias("状态"))
    out = _folder(spark, "cn")
    _csv(df.where(F.col("编号") % 2 == 0), f"{out}/utf 8", 3)
    _csv(df.where(F.col("编号") % 2 == 1).select("状态", "编号"), f"{out}/g b k", 2, "GBK")
    rows = read_csv_detected(spark, out, recursive=True)
    return rows.groupBy(F.col("状态").alias("status")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("编号").cast("bigint")).alias("key_sum"))


# Status texts of deliveries in five charsets, by order key modulo 5.
SCRIPTS = [("GBK", "订单已经完成，等待客户确认"), ("Big5", "訂單已經完成，等待客戶確認"),
           ("Shift_JIS", "注文はまだ届いていません"), ("windows-1251", "заказ выполнен и отправлен"),
           ("ISO-8859-1", "commande livrée à François, très bientôt")]


@register("charset_scripts", oracle=f"""
SELECT CASE o_orderkey % 5 {" ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(SCRIPTS))} END AS status,
       count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       CAST(greatest(1, ceil(count(*) / 50000.0)) AS BIGINT) AS files
FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1
UNION ALL SELECT '', count(*), CAST(sum(o_orderkey) AS BIGINT), 0 FROM orders WHERE o_orderkey % 3 = 0
""")
def charset_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status texts in five charsets (a third of the rows without a text), each file's charset
    found from ranges of its bytes; with the number of files of different fingerprints."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = table(spark, sf_dir, "orders")
    sizes = {r["part"]: r["n"] for r in df.where("o_orderkey % 3 <> 0").groupBy((F.col("o_orderkey") % 5).alias("part"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    out = _folder(spark, "scripts")
    for i, (name, text) in enumerate(SCRIPTS):
        _csv(df.where(F.col("o_orderkey") % 5 == i).select(
            "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.lit(text)).alias("status"), "o_orderdate"),
            f"{out}/{name}", max(1, -(-sizes.get(i, 0) // 50_000)), name)
    rows = read_csv_detected(spark, out, recursive=True)
    hashes = fingerprints(spark, out, recursive=True).select(F.col("path").alias("_file"), "file_hash")
    per = rows.groupBy("status", "_file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("bigint")).alias("k"))
    named = per.join(hashes, "_file", "left")
    return named.groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(
        F.sum("n").alias("row_count"), F.sum("k").alias("key_sum"),
        F.count_distinct(F.when(F.col("status").isNotNull(), F.col("file_hash"))).alias("files"))


def _outcome_code(rows: list[dict]) -> list[dict]:
    """User code that fails on status P: for good, for the moment, or to have the file left out."""
    for r in rows:
        if r["o_orderstatus"] == "P":
            raise (ValueError, RetryableError, SkipFileError)[int(r["o_orderkey"]) % 3]("unknown status")
    return rows


OUTCOMES = TaskSpec(task_id="outcomes", base_table="orders_out", keys=("o_orderkey",), partition_field="o_orderdate",
                    partition_format="%Y-%m-%d %H:%M:%S", max_retries=2, extensions=(".csv", ".xls"))


@register("intake_outcomes", oracle="""
SELECT 'SUCCESS' AS status, FALSE AS dead_lettered, NULL AS error_type, 0 AS retry_count, NULL AS reason,
       count(*) AS row_count FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'FAILED', TRUE, 'FatalError', 1, 'fatal', 0
UNION ALL SELECT 'FAILED', TRUE, 'RetryableError', 2, 'retries_exhausted', 0
UNION ALL SELECT 'SKIPPED', FALSE, 'SkipFile', 0, NULL, 0
""")
def intake_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadable files, one without rows, an empty one, an unreadable workbook, and files on
    which the user's code fails: for good, for the moment, or to have the file left out.  All are taken in
    three times, the failing ones in one pass with the others (the retryable one again when it is due)."""
    from intakeflow.operators.cleaners import ROW_ID, apply_row_function
    from intakeflow.operators.ledger import KEY, fold
    from intakeflow.streaming.intake import IntakePaths, run_batch_intake

    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    out = _folder(spark, "outcomes")
    kind = F.when(F.col("o_orderstatus") != "P", -1).when(F.col("o_orderstatus") == "P", F.pmod("o_orderkey", F.lit(3)))
    rows = {r["kind"]: r["n"] for r in df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    _csv(df.where(kind == -1), f"{out}/good", delivery_count(rows.get(-1, 0), 4))
    for k in range(3):  # a file is what fails, so each kind has its own
        bad = df.where(kind == k)
        # the table is read by many tasks also where one file is written
        _csv(bad.repartition(1) if 0 < rows.get(k, 0) <= CSV_ROWS_PER_FILE else bad, f"{out}/bad{k}",
             delivery_count(rows.get(k, 0), 1))
    _csv(df.limit(0), f"{out}/none", 1)
    jvm = spark.sparkContext._jvm
    for name, data in (("empty.csv", b""), ("old.xls", b"x")):
        p = jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        with_stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        with_stream.write(bytearray(data))
        with_stream.close()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in df.columns])

    def flag(rows: DataFrame) -> DataFrame:
        return apply_row_function(rows.withColumn(ROW_ID, F.monotonically_increasing_id()), _outcome_code, schema,
                                  keep=("_file", "_row", "_mtime", "_size", "task_id"), errors="file", seconds=60)

    base = scratch_path(spark, f"outcomes-{uuid.uuid4().hex[:8]}")
    paths = IntakePaths(*(f"{base}/{n}" for n in ("target", "ledger", "quality", "alerts", "ckpt")))
    for run, minutes in enumerate((0, 0, 60)):  # at once again: held by the back-off; an hour later: due
        clock = lambda m=minutes: _dt.datetime(2001, 12, 1) + _dt.timedelta(minutes=m)
        run_batch_intake(spark, out, OUTCOMES, schema, paths, flag=flag, recursive=True, run_id=run, as_of=clock)
    dead = spark.read.parquet(paths.ledger + "_dead_letter").select(*KEY, "reason")
    return fold(spark.read.parquet(paths.ledger)).join(dead, list(KEY), "left").groupBy(
        "status", "dead_lettered", "error_type", F.col("retry_count").cast("int").alias("retry_count"), "reason").agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))


@register("archived_months", oracle="""
SELECT strftime(o_orderdate, '%Y%m') AS month,
       CASE WHEN year(o_orderdate) <= 1997 THEN 'quarantined' ELSE 'stored' END AS place, count(*) AS row_count
FROM orders GROUP BY ALL
""")
def archived_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of archived months (up to 1997) end in the quarantine dataset, the others in the target."""
    from intakeflow.operators.writer import write_first_wins

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month"))
    target = f"{_folder(spark, 'archived')}/target"
    months = [f"{y}{m:02d}" for y in range(1990, 1998) for m in range(1, 13)]
    write_first_wins(rows, target, ["o_orderkey"], ["o_orderkey"], archived_months=months)
    read = lambda p, place: spark.read.parquet(p).select(
        F.col("month").cast("string").alias("month"), F.lit(place).alias("place"))
    return read(target, "stored").unionByName(read(target + "_quarantine", "quarantined")).groupBy(
        "month", "place").agg(F.count(F.lit(1)).alias("row_count"))


@register("number_texts", oracle="""
SELECT p_partkey % 5 AS kind, CAST(sum(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5
       WHEN 4 THEN p_size * 1000 ELSE 0 END) AS DOUBLE) AS total
FROM part GROUP BY 1
""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sizes written as ' 7 ', '7.5', '7D', '7f' and '7e3'; only the suffixed ones are no numbers."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = (F.when(kind == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(kind == 1, F.concat(size, F.lit(".5")))
            .when(kind == 2, F.concat(size, F.lit("D"))).when(kind == 3, F.concat(size, F.lit("f")))
            .otherwise(F.concat(size, F.lit("e3"))))
    return table(spark, sf_dir, "part").select(kind.alias("kind"), to_number(text).alias("x")).groupBy("kind").agg(
        F.sum("x").alias("total"))


@register("offset_months", oracle="""
SELECT strftime(o_orderdate, '%Y%m') AS month, 'offset' AS layout, count(*) AS row_count FROM orders GROUP BY 1
UNION ALL
SELECT strftime(o_orderdate - INTERVAL 25 YEAR, '%Y%m'), 'two digits', count(*) FROM orders GROUP BY 1
""")
def offset_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """months of texts with a zone offset (the text's own clock counts) and with two-digit years of
    the seventies (69-99 are 19xx)."""
    orders = table(spark, sf_dir, "orders")
    clock = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.element_at(F.array(*map(F.lit, ("+0800", "-11:30", "Z"))), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    old = F.date_format(F.col("o_orderdate") - F.make_ym_interval(F.lit(25)), "dd/MM/yy")
    parts = []
    for layout, text, fmt in (("offset", F.concat(clock, zone), "%Y-%m-%dT%H:%M:%S%z"), ("two digits", old, "%d/%m/%y")):
        month, _ = month_suffix(text, T.StringType(), fmt, AS_OF_ORDERS)
        parts.append(orders.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("row_count")).select(
            "month", F.lit(layout).alias("layout"), "row_count"))
    return parts[0].unionByName(parts[1])


def _omit_and_split(rows: list[dict]) -> list[dict]:
    """User code that returns new rows without an id: none for every fourth order, two for every third."""
    out = []
    for r in rows:
        if r["key"] % 4:
            out += [{"mark": f"{r['key']}-{i}"} for i in range(2 if r["key"] % 3 == 0 else 1)]
    return out


@register("row_udf_omit_split", oracle="""
SELECT 'file' || (o_orderkey % 7) AS _file, o_orderkey AS key,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey || '-' || n END AS mark, o_orderkey % 4 <> 0 AS _valid
FROM orders, (VALUES (0), (1)) v(n) WHERE n = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0)
""")
def row_udf_omit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row function that leaves rows out and splits others, over seven files at once; every
    output keeps its input's file and key, every input without output is reported."""
    from intakeflow.operators.cleaners import apply_row_function

    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("file"), F.pmod("o_orderkey", F.lit(7))).alias("_file"), F.col("o_orderkey").alias("key")).withColumn(
        "_row_id", F.monotonically_increasing_id())
    out = apply_row_function(rows, _omit_and_split, T.StructType([T.StructField("mark", T.StringType())]),
                             keep=("_file", "key"))
    return out.select("_file", "key", "mark", "_valid")


@register("daily_rollup_reruns", oracle=with_cte(f"""
SELECT pf.task_id, CAST(pf.created_at AS DATE) AS stat_date, count(*) AS total_files,
       CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows,
       {avg_half_up_sql("CASE WHEN dq.file_id % 2 = 0 THEN dq.quality_score / 2 ELSE dq.quality_score END", 2, 2)}
           AS avg_quality_score
FROM pf LEFT JOIN dq ON dq.file_id = pf.id GROUP BY ALL
""", pf=PF_SQL, dq=DQ_SQL))
def daily_rollup_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files have a second, later quality report; each file counts once, by its latest."""
    dq = quality_log_rows(spark, sf_dir)
    again = dq.where("file_id % 2 = 0").withColumn("quality_score", (F.col("quality_score") / 2).cast(
        dq.schema["quality_score"].dataType)).withColumn("batch_time", F.col("batch_time") + F.expr("INTERVAL 1 HOUR"))
    return R.daily_rollup(ledger_rows(spark, sf_dir), dq.unionByName(again)).select(
        "task_id", "stat_date", "total_files", "total_rows", "avg_quality_score")
