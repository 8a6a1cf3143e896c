"""intakeflow: file intake into month-partitioned tables, on Spark.

Layers:
  functions/  column expressions (month suffix, date normalise, coercions, ...)
  sources/    file manifest, fingerprints, CSV/JSON/Excel readers, fixture views
  operators/  cleaners, validity split, month router, first-wins writer,
              quality scoring, ledger fold, lifecycle, ordered-sequence scans
  plans/      reporting queries over the ledger / quality / audit tables
  streaming/  Structured Streaming intake and stateful file-event operators
"""

from intakeflow.spec import TaskSpec

__all__ = ["TaskSpec"]
