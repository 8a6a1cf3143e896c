"""Driver queries: month routing, first-wins writes, schema union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeflow.operators.route import MONTH, month_counts, route_months
from intakeflow.operators.writer import align_columns, plan_first_wins
from intakeflow.plans.catalog import AS_OF_ORDERS, register
from intakeflow.sources.fixtures import RAW_SQL, raw_rows, table, with_cte
from intakeflow.spec import TaskSpec

LINEITEM_TASK = TaskSpec(task_id="task_lineitem", base_table="lineitem",
                         keys=("l_orderkey", "l_linenumber"), partition_field="l_shipdate")
LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate")
# Arrival order of the two deliveries: delivery first, then every column.
ARRIVAL = ("delivery",) + LINEITEM_COLS
_ARRIVAL_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in ARRIVAL)


def _lineitem_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_COLS)
    # Two deliveries of the same table: rows of even part keys arrive first.
    li = li.withColumn("delivery", F.col("l_partkey") % 2)
    return route_months(li, LINEITEM_TASK, AS_OF_ORDERS).drop("_route_fallback")


def first_wins_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target content after loading delivery 0, then delivery 1, with first-wins inserts."""
    routed = _lineitem_deliveries(spark, sf_dir)
    keys = LINEITEM_TASK.keys
    d0 = routed.filter(F.col("delivery") == 0)
    d1 = routed.filter(F.col("delivery") == 1)
    target = plan_first_wins(d0, None, keys, ARRIVAL)
    inserted = plan_first_wins(d1, target, keys, ARRIVAL)
    return target.unionByName(inserted)


@register("month_route", oracle="""
SELECT month,
       CASE WHEN month IS NOT NULL THEN substr(month, 1, 4) || '-' || substr(month, 5, 2) END AS year_month,
       CASE WHEN month IS NOT NULL THEN 'lineitem_' || month END AS table_name,
       count(*) AS row_count
FROM (SELECT strftime(l_shipdate, '%Y%m') AS month FROM lineitem) t
GROUP BY ROLLUP (month)
""")
def month_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route every lineitem row to its ship month; rows per month + total."""
    li = table(spark, sf_dir, "lineitem")
    return month_counts(route_months(li, LINEITEM_TASK, AS_OF_ORDERS), "lineitem")


RAW_TASK = TaskSpec(task_id="task_raw", base_table="raw_rows", keys=("id",),
                    partition_field="date", partition_format="%Y-%m-%d %H:%M:%S")


@register("month_route_bad_dates", oracle=with_cte("""
SELECT coalesce(strftime(CASE WHEN date <> '' THEN try_strptime(date, '%Y-%m-%d %H:%M:%S') END, '%Y%m'), '200112') AS month,
       strftime(CASE WHEN date <> '' THEN try_strptime(date, '%Y-%m-%d %H:%M:%S') END, '%Y%m') IS NULL AS _route_fallback,
       count(*) AS row_count
FROM raw GROUP BY ALL
""", raw=RAW_SQL))
def month_route_bad_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 fallback: missing / empty / unparsable dates go to the as_of month, flagged."""
    routed = route_months(raw_rows(spark, sf_dir), RAW_TASK, AS_OF_ORDERS)
    return routed.groupBy(MONTH, "_route_fallback").agg(F.count(F.lit(1)).alias("row_count"))


_FIRST_WINS_SQL = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT l.*, row_number() OVER (PARTITION BY month, l_orderkey, l_linenumber ORDER BY {_ARRIVAL_SQL}) AS rn
  FROM (SELECT {", ".join(LINEITEM_COLS)}, l_partkey % 2 AS delivery,
               strftime(l_shipdate, '%Y%m') AS month FROM lineitem) l) t
WHERE rn = 1
"""


@register("insert_ignore_first_wins", oracle=_FIRST_WINS_SQL)
def insert_ignore_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries into a month-partitioned target; the first row per (month, key) wins."""
    return first_wins_table(spark, sf_dir)


@register("insert_ignore_net_counts", oracle=f"""
WITH kept AS ({_FIRST_WINS_SQL})
SELECT r.delivery, r.month, r.received, coalesce(k.inserted, 0) AS inserted,
       r.received - coalesce(k.inserted, 0) AS ignored
FROM (SELECT l_partkey % 2 AS delivery, strftime(l_shipdate, '%Y%m') AS month, count(*) AS received
      FROM lineitem GROUP BY ALL) r
LEFT JOIN (SELECT delivery, month, count(*) AS inserted FROM kept GROUP BY ALL) k
  ON r.delivery = k.delivery AND r.month = k.month
""")
def insert_ignore_net_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 counts per (delivery, month): received, inserted (net), ignored."""
    received = _lineitem_deliveries(spark, sf_dir).groupBy("delivery", MONTH).agg(
        F.count(F.lit(1)).alias("received"))
    kept = first_wins_table(spark, sf_dir).groupBy("delivery", MONTH).agg(
        F.count(F.lit(1)).alias("inserted"))
    j = received.join(kept, ["delivery", MONTH], "left")
    ins = F.coalesce(F.col("inserted"), F.lit(0))
    return j.select("delivery", MONTH, "received", ins.alias("inserted"),
                    (F.col("received") - ins).alias("ignored"))


@register("schema_union", oracle="""
SELECT o_custkey AS custkey, o_totalprice AS amount, o_orderdate AS ts, NULL::VARCHAR AS name FROM orders
UNION ALL
SELECT c_custkey, c_acctbal, NULL::TIMESTAMP, c_name FROM customer
""")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of drifting batches by column name; absent columns become NULL."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("ts"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("amount"))
    return align_columns([o, c])


# A fixed demonstration key (16 bytes -> AES-128); real tasks pass their own.
DEMO_KEY = "0123456789abcdef"


@register("encrypt_roundtrip", oracle="""
SELECT c_custkey, c_name, TRUE AS balance_matches, TRUE AS ciphertext_differs FROM customer
""")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured fields encrypted (AES-GCM) before routing, then decrypted back."""
    from intakeflow.functions.crypto import decrypt_fields, encrypt_fields

    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("bal"),
        F.col("c_acctbal").cast("string").alias("plain_bal"))
    enc = encrypt_fields(c, ["c_name", "bal"], DEMO_KEY).withColumn("cipher", F.col("c_name"))
    dec = decrypt_fields(enc, ["c_name", "bal"], DEMO_KEY)
    return dec.select("c_custkey", "c_name", (F.col("bal") == F.col("plain_bal")).alias("balance_matches"),
                      (F.col("cipher") != F.col("c_name")).alias("ciphertext_differs"))
