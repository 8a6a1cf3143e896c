"""Stand-in inputs derived from the driver's test tables.

These builders only shape rows into the schemas the library's jobs expect
(a file ledger, a quality log, dirty string rows, an outcome stream); they do
none of the jobs' work.  Each has a DuckDB twin (``*_SQL``) used as a CTE by
the oracle queries, so both sides start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# pf: file ledger, one row per file; unique key (task_id, file_path, file_mtime)
# ---------------------------------------------------------------------------
PF_SQL = """
SELECT o.o_orderkey AS id,
       'task_' || substr(o.o_orderpriority, 1, 1) AS task_id,
       '/in/order_' || CAST(o.o_orderkey AS STRING) || '.csv' AS file_path,
       'order_' || CAST(o.o_orderkey AS STRING) || '.csv' AS file_name,
       1719000000000 + o.o_orderkey * 1000 AS file_mtime,
       CASE WHEN o.o_orderkey % 10 < 6 THEN 'SUCCESS'
            WHEN o.o_orderkey % 10 = 6 THEN 'FAILED'
            WHEN o.o_orderkey % 10 = 7 THEN 'SKIPPED'
            WHEN o.o_orderkey % 10 = 8 THEN 'PENDING'
            WHEN o.o_orderkey % 20 = 9 THEN 'CLAIMED'
            ELSE 'PROCESSING' END AS status,
       o.o_orderkey % 4 AS retry_count,
       CASE WHEN o.o_orderkey % 10 = 6 THEN 'RetryableError' END AS error_type,
       CASE WHEN o.o_orderkey % 10 = 6 THEN 'timeout on order ' || CAST(o.o_orderkey AS STRING) END AS error_message,
       coalesce(l.n, 0) AS row_count,
       coalesce(l.ok, 0) AS valid_row_count,
       CAST(floor(o.o_totalprice) AS BIGINT) % 5000 AS processing_time_ms,
       o.o_orderdate AS created_at,
       CASE WHEN o.o_orderkey % 10 < 6 THEN o.o_orderdate + INTERVAL '1' HOUR END AS processed_at,
       CASE WHEN o.o_orderkey % 10 = 9 THEN o.o_orderdate + INTERVAL '10' MINUTE END AS claim_expires_at
FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n,
                  CAST(sum(CASE WHEN l_discount <= 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS ok
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("l_discount") <= 0.08, 1).otherwise(0)).cast("bigint").alias("ok"))
    k = F.col("o_orderkey")
    sk = k.cast("string")
    status = (F.when(k % 10 < 6, "SUCCESS").when(k % 10 == 6, "FAILED")
              .when(k % 10 == 7, "SKIPPED").when(k % 10 == 8, "PENDING")
              .when(k % 20 == 9, "CLAIMED").otherwise("PROCESSING"))
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    return j.select(
        k.alias("id"),
        F.concat(F.lit("task_"), F.substring("o_orderpriority", 1, 1)).alias("task_id"),
        F.concat(F.lit("/in/order_"), sk, F.lit(".csv")).alias("file_path"),
        F.concat(F.lit("order_"), sk, F.lit(".csv")).alias("file_name"),
        (F.lit(1719000000000) + k * 1000).alias("file_mtime"),
        status.alias("status"),
        (k % 4).alias("retry_count"),
        F.when(k % 10 == 6, F.lit("RetryableError")).alias("error_type"),
        F.when(k % 10 == 6, F.concat(F.lit("timeout on order "), sk)).alias("error_message"),
        F.coalesce(F.col("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.col("ok"), F.lit(0)).alias("valid_row_count"),
        (F.floor("o_totalprice").cast("bigint") % 5000).alias("processing_time_ms"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 10 < 6, F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("processed_at"),
        F.when(k % 10 == 9, F.col("o_orderdate") + F.expr("INTERVAL 10 MINUTES")).alias("claim_expires_at"),
    )


# ---------------------------------------------------------------------------
# dq: quality log, one row per file
# ---------------------------------------------------------------------------
DQ_SQL = """
SELECT l_orderkey AS file_id,
       'task_' || CAST(l_orderkey % 5 + 1 AS STRING) AS task_id,
       max(l_shipdate) AS batch_time,
       count(*) AS total_rows,
       CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS error_rows,
       round(greatest(CAST(0 AS DOUBLE), CAST(100 AS DOUBLE) - CAST(60 AS DOUBLE)
             * CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)), 2) AS quality_score
FROM lineitem GROUP BY l_orderkey
"""


def quality_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    bad = F.sum(F.when(F.col("l_discount") > 0.08, 1).otherwise(0))
    return li.groupBy("l_orderkey").agg(
        F.concat(F.lit("task_"), (F.first("l_orderkey") % 5 + 1).cast("string")).alias("task_id"),
        F.max("l_shipdate").alias("batch_time"),
        F.count(F.lit(1)).alias("total_rows"),
        bad.cast("bigint").alias("error_rows"),
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(60.0) * bad.cast("double")
                           / F.count(F.lit(1)).cast("double")), 2).alias("quality_score"),
    ).withColumnRenamed("l_orderkey", "file_id").select(
        "file_id", "task_id", "batch_time", "total_rows", "error_rows", "quality_score")


# ---------------------------------------------------------------------------
# raw: dirty all-string rows (with exact duplicates) for the cleaners
# ---------------------------------------------------------------------------
RAW_SQL = """
WITH b AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderstatus AS st,
         CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
         CAST(CAST(o_orderdate AS DATE) AS STRING) FROM orders WHERE o_orderkey % 50 = 0)
SELECT CAST(k AS STRING) AS id,
       CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN NULL
                   WHEN 3 THEN '  cust ' || CAST(c AS STRING) || ' ' ELSE 'cust ' || CAST(c AS STRING) END AS name,
       CASE k % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN NULL
                  ELSE CAST(CAST(floor(p) AS BIGINT) AS STRING) || '.5' END AS value,
       CASE k % 13 WHEN 0 THEN 'not-a-date' WHEN 1 THEN NULL WHEN 2 THEN '2026-02-30' WHEN 3 THEN ''
                   ELSE d || ' 10:00:00' END AS date,
       CASE k % 6 WHEN 0 THEN ' ACTIVE ' WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'nan' ELSE st END AS status,
       CASE k % 5 WHEN 0 THEN '150' WHEN 1 THEN '-3' WHEN 2 THEN 'x' WHEN 3 THEN '77.9'
                  ELSE CAST(c % 101 AS STRING) END AS score
FROM b
"""


def _case(k, mod, mapping: dict, default):
    expr = None
    for v, out in mapping.items():
        cond = (k % mod) == v
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return expr.otherwise(default)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("st"),
        F.col("o_orderdate").cast("date").cast("string").alias("d"))
    b = o.unionAll(o.filter(F.col("k") % 50 == 0))
    k, c = F.col("k"), F.col("c")
    null = F.lit(None).cast("string")
    return b.select(
        k.cast("string").alias("id"),
        _case(k, 11, {0: F.lit(""), 1: F.lit("None"), 2: null,
                      3: F.concat(F.lit("  cust "), c.cast("string"), F.lit(" "))},
              F.concat(F.lit("cust "), c.cast("string"))).alias("name"),
        _case(k, 7, {0: F.lit("abc"), 1: F.lit(""), 2: null},
              F.concat(F.floor("p").cast("bigint").cast("string"), F.lit(".5"))).alias("value"),
        _case(k, 13, {0: F.lit("not-a-date"), 1: null, 2: F.lit("2026-02-30"), 3: F.lit("")},
              F.concat(F.col("d"), F.lit(" 10:00:00"))).alias("date"),
        _case(k, 6, {0: F.lit(" ACTIVE "), 1: F.lit("None"), 2: F.lit(""), 3: null, 4: F.lit("nan")},
              F.col("st")).alias("status"),
        _case(k, 5, {0: F.lit("150"), 1: F.lit("-3"), 2: F.lit("x"), 3: F.lit("77.9")},
              (c % 101).cast("string")).alias("score"),
    )


# ---------------------------------------------------------------------------
# outcomes: ordered per-task outcome stream
# ---------------------------------------------------------------------------
OUTCOMES_SQL = """
SELECT event_id AS id, 'task_' || CAST(user_id % 5 + 1 AS STRING) AS task_id, ts,
       CASE WHEN event_type IN ('error','click','view') THEN 'FAILED' ELSE 'SUCCESS' END AS outcome
FROM events
"""


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("task_"), (F.col("user_id") % 5 + 1).cast("string")).alias("task_id"),
        F.col("ts"),
        F.when(F.col("event_type").isin("error", "click", "view"), "FAILED")
        .otherwise("SUCCESS").alias("outcome"))


# ---------------------------------------------------------------------------
# file events: observations of (path, mtime, size) as a watcher would see them
# ---------------------------------------------------------------------------
FILE_EVENTS_SQL = """
SELECT event_id AS id,
       '/in/u' || CAST(user_id AS STRING) || '/' || event_type || '.csv' AS file_path,
       ts,
       CAST(ts AS DATE) AS file_day,
       CAST(floor(value) AS BIGINT) % 3 AS file_size
FROM events
"""


def file_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watcher observations: one per event; path from (user, type), (day, size) as the file's signature."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("/in/u"), F.col("user_id").cast("string"), F.lit("/"),
                 F.col("event_type"), F.lit(".csv")).alias("file_path"),
        F.col("ts"),
        F.col("ts").cast("date").alias("file_day"),
        (F.floor("value").cast("bigint") % 3).alias("file_size"))


# ---------------------------------------------------------------------------
# audit log: the events table read as a user audit trail
# ---------------------------------------------------------------------------
AUDIT_SQL = """
SELECT event_id AS id, ts AS timestamp, user_id,
       'user' || CAST(user_id AS STRING) AS username,
       '10.0.0.' || CAST(user_id % 250 AS STRING) AS user_ip,
       upper(event_type) || '_FILE' AS action,
       'order_' || CAST(event_id AS STRING) || '.csv' AS target,
       props AS detail
FROM events
"""


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), uid.alias("user_id"),
        F.concat(F.lit("user"), uid.cast("string")).alias("username"),
        F.concat(F.lit("10.0.0."), (uid % 250).cast("string")).alias("user_ip"),
        F.concat(F.upper("event_type"), F.lit("_FILE")).alias("action"),
        F.concat(F.lit("order_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("target"),
        F.col("props").alias("detail"))


def with_cte(body: str, **ctes: str) -> str:
    """Prefix an oracle query with fixture CTEs (a body starting with ',' adds more CTEs)."""
    parts = [f"{name} AS ({sql.strip()})" for name, sql in ctes.items()]
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    return "WITH " + ",\n".join(parts) + sep + body


# ---------------------------------------------------------------------------
# workbooks: table rows packed into .xlsx documents (standard library only)
# ---------------------------------------------------------------------------
def _cell_ref(r: int, c: int) -> str:
    letters, c = "", c + 1
    while c:
        c, m = divmod(c - 1, 26)
        letters = chr(65 + m) + letters
    return f"{letters}{r + 1}"


def workbook_bytes(header: list[str], rows: list[list], date_cols: frozenset = frozenset()) -> bytes:
    """A minimal one-sheet .xlsx: text as inline strings, numbers as numbers, and the
    ``date_cols`` (datetime values) as date-formatted serial numbers."""
    import datetime as dt
    import io
    import numbers
    import zipfile
    from xml.sax.saxutils import escape

    epoch = dt.datetime(1899, 12, 30)

    letters = [_cell_ref(0, c)[:-1] for c in range(max(map(len, [header, *rows])))]

    def cell(r, c, v, name):
        if v is None:
            return ""
        ref, kind = f"{letters[c]}{r + 1}", type(v)
        if kind is int:
            return f'<c r="{ref}"><v>{v}</v></c>'
        if kind is float:
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        if kind is str:
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if name in date_cols and isinstance(v, dt.datetime):
            serial = (v - epoch).days + (v - epoch).seconds / 86400
            return f'<c r="{ref}" s="1"><v>{serial:g}</v></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, numbers.Integral):
            return f'<c r="{ref}"><v>{int(v)}</v></c>'
        if isinstance(v, numbers.Real):
            return f'<c r="{ref}"><v>{float(v)!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    body = [f'<row r="1">{"".join(cell(0, c, h, None) for c, h in enumerate(header))}</row>']
    for r, row in enumerate(rows, start=1):
        body.append(f'<row r="{r + 1}">{"".join(cell(r, c, v, header[c]) for c, v in enumerate(row))}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/>'
                                      f'</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/>'
                                    f'</cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(body)}</sheetData></worksheet>')
    return buf.getvalue()


def table_as_workbooks(spark: SparkSession, sf_dir: str, name: str, rows_per_book: int = 5000,
                       date_cols: tuple[str, ...] = ()) -> DataFrame:
    """A test table delivered as .xlsx workbooks: ``(path, content)`` rows, one per workbook.

    Rows are hashed into ``ceil(rows / rows_per_book)`` workbooks, so each workbook (one
    ``applyInPandas`` group) stays bounded however large the table is.
    """
    import pandas as pd
    from pyspark.sql import types as T

    df = table(spark, sf_dir, name)
    cols = df.columns
    n_books = max(1, -(-df.count() // rows_per_book))
    keyed = df.withColumn("_book", F.pmod(F.xxhash64(*cols), F.lit(n_books)))
    dates = frozenset(date_cols)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        book = int(pdf["_book"].iloc[0])
        body = pdf[cols].astype(object).where(pdf[cols].notna(), None)
        rows = [[v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for v in r] for r in body.values.tolist()]
        return pd.DataFrame({"path": [f"/deliveries/{name}_{book:05d}.xlsx"],
                             "content": [workbook_bytes(cols, rows, dates)]})

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])
    # a row's work is far more than its bytes tell: partitions are dealt by workbooks and not put together
    tasks = min(n_books, 16 * spark.sparkContext.defaultParallelism)
    return keyed.repartition(tasks, "_book").groupBy("_book").applyInPandas(build, schema)
