"""Driver queries over files written from the test tables.

The test tables are parquet; these queries first write them out as delivery
files (CSV / nested JSON) into the shared scratch folder, then run the
library's readers on those files exactly as on real deliveries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeflow.operators.route import month_counts, route_months
from intakeflow.plans.catalog import AS_OF_ORDERS, register
from intakeflow.session import scratch_path
from intakeflow.sources.files import fingerprints, list_files, with_format
from intakeflow.sources.fixtures import table
from intakeflow.sources.readers import json_skips, read_csv, read_json
from intakeflow.spec import TaskSpec

TS_TEXT = "yyyy-MM-dd HH:mm:ss"
# Rows per written JSON document; the number of files grows with the table.
JSON_ROWS_PER_FILE = 5000


# Rows per written CSV delivery: a multi-line CSV file is read by one task, so the
# number of files grows with the table.
CSV_ROWS_PER_FILE = 200_000


def delivery_count(rows: int, minimum: int) -> int:
    return max(minimum, -(-rows // CSV_ROWS_PER_FILE))


def write_csv_deliveries(spark: SparkSession, sf_dir: str, name: str = "lineitem", files: int = 8,
                         even: bool = True) -> str:
    """Write a test table as CSV deliveries (header, quoted; at least ``files`` files, at most
    ``CSV_ROWS_PER_FILE`` rows each) and return the folder.  Without ``even`` a table of more rows than that is
    written by the tasks that read it, without a shuffle, in a few files more."""
    out = scratch_path(spark, f"deliveries-{name}-{uuid.uuid4().hex[:8]}")
    df = table(spark, sf_dir, name)
    n = delivery_count(df.count(), files)
    if even or n == files:
        df = df.repartition(n)
    (df.write.option("header", True).option("escape", '"').option("timestampNTZFormat", TS_TEXT)
     .option("maxRecordsPerFile", CSV_ROWS_PER_FILE if not even else 0).csv(out))
    return out


def write_json_deliveries(spark: SparkSession, sf_dir: str, name: str = "orders") -> str:
    """Write a test table as nested JSON documents ``{"data": [row, ...]}``."""
    out = scratch_path(spark, f"deliveries-{name}-json-{uuid.uuid4().hex[:8]}")
    df = table(spark, sf_dir, name)
    n_files = max(1, -(-df.count() // JSON_ROWS_PER_FILE))
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*df.columns), F.lit(n_files)))
    docs = keyed.groupBy("_b").agg(F.to_json(
        F.struct(F.collect_list(F.struct(*df.columns)).alias("data")),
        {"timestampNTZFormat": TS_TEXT}).alias("value"))
    # one document per file: each bucket gets its own folder
    docs.write.partitionBy("_b").text(out)
    return out


LINEITEM_CSV = TaskSpec(task_id="task_csv", base_table="lineitem_csv", keys=("l_orderkey", "l_linenumber"),
                        partition_field="l_shipdate", partition_format="%Y-%m-%d %H:%M:%S")
ORDERS_JSON = TaskSpec(task_id="task_json", base_table="orders_json", keys=("o_orderkey",),
                       partition_field="o_orderdate", partition_format="%Y-%m-%d %H:%M:%S",
                       json_path="data.item", extensions=(".json",))


@register("csv_intake_months", oracle="""
SELECT month,
       CASE WHEN month IS NOT NULL THEN substr(month, 1, 4) || '-' || substr(month, 5, 2) END AS year_month,
       CASE WHEN month IS NOT NULL THEN 'lineitem_csv_' || month END AS table_name,
       count(*) AS row_count
FROM (SELECT strftime(l_shipdate, '%Y%m') AS month FROM lineitem) t
GROUP BY ROLLUP (month)
""")
def csv_intake_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem delivered as CSV files, read as text, routed by its date text."""
    folder = write_csv_deliveries(spark, sf_dir, "lineitem")
    rows = read_csv(spark, folder)
    return month_counts(route_months(rows, LINEITEM_CSV, AS_OF_ORDERS), LINEITEM_CSV.base_table)


@register("json_intake_months", oracle="""
SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS row_count,
       count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY 1
""")
def json_intake_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders delivered as nested JSON (``data.item``), routed by order date text."""
    folder = write_json_deliveries(spark, sf_dir, "orders")
    rows = read_json(spark, folder, ORDERS_JSON.json_path, recursive=True)
    routed = route_months(rows, ORDERS_JSON, AS_OF_ORDERS)
    return routed.groupBy("month").agg(F.count(F.lit(1)).alias("row_count"),
                                      F.count_distinct("o_custkey").alias("customers"))


# Rows per written JSON document that is read in ranges: some 15 MB, several ranges each.
JSON_ROWS_PER_LARGE_FILE = 100_000


def write_large_json(df: DataFrame, folder: str, files: int, end: str) -> None:
    """Write rows as JSON documents ``{"before": [...], "data": [row, ...] ...`` with ``end`` behind the last row:
    one document per task, streamed."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        yield pa.RecordBatch.from_arrays([pa.array(['{"before": [{"data": [{"l_orderkey": 0}]}, "}]"], "data": ['])], ["value"])
        first = True
        for b in batches:
            if first and b.num_rows:
                yield b.slice(0, 1)
                b, first = b.slice(1), False
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(",", b.column(0), "")], ["value"])
        if end:
            yield pa.RecordBatch.from_arrays([pa.array([end])], ["value"])

    rows = df.select(F.to_json(F.struct(*df.columns), {"timestampNTZFormat": TS_TEXT}).alias("value"))
    rows.repartition(files).mapInArrow(run, "value string").write.text(folder)


@register("json_split_documents", oracle="""
SELECT strftime(l_shipdate, '%Y%m') AS month, count(*) AS row_count, CAST(sum(l_orderkey) AS BIGINT) AS key_sum,
       CAST(sum(length('{"[' || CAST(l_orderkey AS STRING) || chr(10) || chr(92) || '}')) AS BIGINT) AS note_chars
FROM lineitem WHERE l_orderkey % 7 <> 3 GROUP BY 1
UNION ALL
SELECT 'skipped documents', greatest(1, CAST(ceil(count(*) / 100000.0) AS BIGINT) // 6), 0, 0 FROM lineitem
""")
def json_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem delivered as large JSON documents (texts with braces, quotes, line ends and backslashes, a
    second array called like the wanted one), each read by several tasks.  Rows with an order key of 3 modulo 7 come in
    documents whose end is missing, which are skipped whole."""
    note = F.concat(F.lit('{"['), F.col("l_orderkey").cast("string"), F.lit("\n\\}"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", note.alias("note"),
                                                 F.array(F.struct("l_quantity")).alias("parts"))
    out = scratch_path(spark, f"deliveries-large-json-{uuid.uuid4().hex[:8]}")
    files = max(1, -(-df.count() // JSON_ROWS_PER_LARGE_FILE))
    write_large_json(df.where("l_orderkey % 7 <> 3"), f"{out}/whole", files, '], "after": {"data": [{"l_orderkey": 0}]}}')
    write_large_json(df.where("l_orderkey % 7 = 3"), f"{out}/damaged", max(1, files // 6), "")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("l_orderkey", "l_shipdate", "note")])
    rows = read_json(spark, out, "data.item", recursive=True, schema=schema)
    skips = json_skips(spark, out, "data.item", recursive=True).agg(
        F.lit("skipped documents").alias("month"), F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("_file").contains("/whole/")).alias("key_sum"), F.lit(0).cast("bigint").alias("note_chars"))
    routed = route_months(rows, LINEITEM_CSV, AS_OF_ORDERS)
    return routed.groupBy("month").agg(F.count(F.lit(1)).alias("row_count"),
                                      F.sum(F.col("l_orderkey").cast("bigint")).alias("key_sum"),
                                      F.sum(F.length("note")).cast("bigint").alias("note_chars")).unionByName(skips)


@register("file_manifest", oracle="""
SELECT 'csv' AS fmt, CAST(greatest(4, ceil(count(*) / 200000.0)) AS INTEGER) AS files,
       CAST(greatest(4, ceil(count(*) / 200000.0)) AS INTEGER) AS distinct_hashes, 0 AS skipped,
       count(*) AS rows_read
FROM orders
""")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of the CSV deliveries (four or more) with format, skip reason and
    fingerprint, joined with the rows each file yields; totals per format."""
    folder = write_csv_deliveries(spark, sf_dir, "orders", files=4)
    manifest = with_format(list_files(spark, folder, (".csv",)))
    hashed = manifest.join(fingerprints(spark, folder).drop("file_size"), "path", "left")
    per_file = read_csv(spark, folder).groupBy(F.col("_file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    j = hashed.join(per_file, "path", "left")
    return j.groupBy("fmt").agg(
        F.count(F.lit(1)).cast("int").alias("files"),
        F.count_distinct("file_hash").cast("int").alias("distinct_hashes"),
        F.count_if(F.col("skip_reason").isNotNull()).cast("int").alias("skipped"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"))


@register("batch_intake_months", oracle="""
SELECT month, count(*) AS rows_stored
FROM (SELECT DISTINCT strftime(l_shipdate, '%Y%m') AS month, l_orderkey, l_linenumber FROM lineitem) k
GROUP BY month
""")
def batch_intake_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1/F1/K2/K3/L2 end to end: lineitem delivered as CSV files, taken in by the batch intake
    (ledger, quality log, first-wins month target), then delivered again (nothing new is stored)."""
    import datetime as _dt

    from intakeflow.streaming.intake import IntakePaths, read_target, run_batch_intake

    folder = write_csv_deliveries(spark, sf_dir, "lineitem", even=False)
    base = scratch_path(spark, f"intake-{uuid.uuid4().hex[:8]}")
    paths = IntakePaths(*(f"{base}/{n}" for n in ("target", "ledger", "quality", "alerts", "ckpt")))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in table(spark, sf_dir, "lineitem").columns])
    clock = lambda: _dt.datetime(2001, 12, 1)
    run_batch_intake(spark, folder, LINEITEM_CSV, schema, paths, run_id=0, as_of=clock)
    run_batch_intake(spark, folder, LINEITEM_CSV, schema, paths, run_id=1, as_of=clock)
    stored = read_target(spark, paths.target)
    # which duplicate wins follows file arrival order; the number stored per month does not
    return stored.groupBy("month").agg(F.count(F.lit(1)).alias("rows_stored"))


@register("stream_intake_months", oracle="""
SELECT month, count(*) AS rows_stored
FROM (SELECT DISTINCT strftime(l_shipdate, '%Y%m') AS month, l_orderkey, l_linenumber FROM lineitem) k
GROUP BY month
""")
def stream_intake_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV deliveries taken in by the Structured Streaming intake
    (``availableNow``, two files per micro-batch, first-wins across batches)."""
    import datetime as _dt

    from intakeflow.streaming.intake import IntakePaths, read_target, start_intake

    folder = write_csv_deliveries(spark, sf_dir, "lineitem")
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex[:8]}")
    paths = IntakePaths(*(f"{base}/{n}" for n in ("target", "ledger", "quality", "alerts", "ckpt")))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in table(spark, sf_dir, "lineitem").columns])
    q = start_intake(spark, folder, LINEITEM_CSV, schema, paths, available_now=True, max_files_per_trigger=2,
                     as_of=lambda: _dt.datetime(2001, 12, 1))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"intake stream failed: {q.exception()}")
    return read_target(spark, paths.target).groupBy("month").agg(F.count(F.lit(1)).alias("rows_stored"))


ORDERS_XLSX = TaskSpec(task_id="task_xlsx", base_table="orders_xlsx", keys=("o_orderkey",),
                       partition_field="o_orderdate", partition_format="%Y-%m-%d %H:%M:%S",
                       extensions=(".xlsx",))


@register("excel_intake_months", oracle="""
SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS row_count,
       count(DISTINCT o_custkey) AS customers, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1
""")
def excel_intake_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders delivered as .xlsx workbooks (order date as a date-formatted cell), parsed
    sheet by sheet, projected to named columns and routed by the order date."""
    from intakeflow.sources.fixtures import table_as_workbooks
    from intakeflow.sources.readers import excel_columns, parse_workbooks

    books = table_as_workbooks(spark, sf_dir, "orders", date_cols=("o_orderdate",))
    rows = excel_columns(parse_workbooks(books), ["o_orderkey", "o_custkey", "o_orderdate"])
    routed = route_months(rows, ORDERS_XLSX, AS_OF_ORDERS)
    return routed.groupBy("month").agg(F.count(F.lit(1)).alias("row_count"),
                                      F.count_distinct("o_custkey").alias("customers"),
                                      F.sum(F.col("o_orderkey").cast("bigint")).alias("key_sum"))


# Status labels in Chinese text, so that UTF-8 and GBK deliveries differ byte for byte.
STATUS_LABELS = {"O": "未结", "F": "完成", "P": "部分"}


@register("charset_intake_counts", oracle=f"""
SELECT CASE o_orderstatus {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_LABELS.items())} END AS label,
       count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1
""")
def charset_intake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders delivered as CSV files, half encoded as UTF-8 and half as GBK; each file's
    charset is detected from its bytes and each group is read with its decoder."""
    from intakeflow.sources.readers import read_csv_detected

    label = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in STATUS_LABELS.items()])
    df = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), "o_orderdate")
    out = scratch_path(spark, f"deliveries-charset-{uuid.uuid4().hex[:8]}")
    files = delivery_count(df.count(), 4)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for enc, part in (("UTF-8", F.col("o_orderkey") % 2 == 0), ("GBK", F.col("o_orderkey") % 2 == 1)):
        (df.filter(part).repartition(files).write.option("header", True).option("encoding", enc)
         .option("timestampNTZFormat", TS_TEXT).csv(f"{out}/{enc.lower()}"))
    rows = read_csv_detected(spark, out, recursive=True)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("row_count"),
                                     F.sum(F.col("o_orderkey").cast("bigint")).alias("key_sum"))
