"""Cleaning workbench (S10, U2, U3, A12, P14, K4): try a cleaner on one delivery.

Read the file with type inference, apply a registered cleaner (native) or a
pandas ``clean_data`` function (per file), count original / cleaned / dropped
rows (the cleaned count is observed during the export write), and return a
50-row preview.
Workbench inputs are single uploaded files, so the export is one CSV file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from intakeflow.operators.cleaners import apply_frame_function, cleaner
from intakeflow.plans.reports import write_csv
from intakeflow.sources.readers import FILE, ROW, read_csv
from intakeflow.spec import PREVIEW_ROWS


def run_workbench(spark: SparkSession, path: str, clean: str | Callable, export_path: str) -> dict:
    raw = read_csv(spark, path, infer=True)
    data_cols = [c for c in raw.columns if c not in (FILE, ROW)]
    original = raw.count()  # a job result: exact even if tasks are retried
    seen = raw
    if isinstance(clean, str):
        out = cleaner(clean)(seen.select(*data_cols, ROW))
    else:  # a pandas clean_data(df) -> df; its output schema comes from a trial on the first rows
        sample = raw.select(*data_cols).limit(PREVIEW_ROWS).toPandas()
        if not len(sample):
            raise ValueError("empty input: nothing to infer the cleaner's output from")
        out_schema = spark.createDataFrame(clean(sample.copy())).schema
        out = apply_frame_function(seen.select(*data_cols, FILE), clean, out_schema)
    ordered = out.orderBy(ROW) if ROW in out.columns else out
    after = Observation("cleaned")  # observed in the export's result stage: applied once per task
    export = (ordered.drop(ROW) if ROW in ordered.columns else ordered).observe(after, F.count(F.lit(1)).alias("n"))
    write_csv(export, export_path)
    cleaned = int(after.get["n"])
    preview = spark.read.option("header", True).csv(export_path).limit(PREVIEW_ROWS).collect()
    return {"original": original, "cleaned": cleaned, "dropped": original - cleaned,
            "columns": export.columns, "preview": [r.asDict() for r in preview]}
