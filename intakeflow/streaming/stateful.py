"""Stateful stream operators (T4, T5, T9); batch twins live in ``operators.sequence``.

* T4 debounce: ``session_window`` with a watermark; a session closes (and fires)
  once the watermark passes its end + gap.
* T5 stability and T9 breaker: ``applyInPandasWithState`` keyed by path / task.
  The state per key is a few scalars, so it stays small however long a key
  lives; rows of one key inside a micro-batch are replayed in (ts, id) order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from intakeflow.spec import BREAKER_FAILURE_THRESHOLD, BREAKER_RECOVERY_SECONDS


def debounce_stream(events: DataFrame, gap_seconds: int, watermark: str,
                    key: str = "file_path", ts: str = "ts") -> DataFrame:
    """T4: one row per closed session (append mode): key, session_start, session_end, events, fire_at."""
    ntz = isinstance(events.schema[ts].dataType, T.TimestampNTZType)
    if ntz:  # event time must be TIMESTAMP for watermarks; the session time zone maps it 1:1
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    w = F.session_window(F.col(ts), f"{int(gap_seconds)} seconds")
    g = events.withWatermark(ts, watermark).groupBy(F.col(key), w.alias("s")).agg(
        F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"))
    back = (lambda c: c.cast("timestamp_ntz")) if ntz else (lambda c: c)
    return g.select(key, back(F.col("s.start")).alias("session_start"), back(F.col("session_end")).alias("session_end"),
                    "events",
                    back(F.col("session_end") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds)))
                    .alias("fire_at"))


BREAKER_OUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("task_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("outcome", T.StringType()),
    T.StructField("failures_before", T.LongType()), T.StructField("state_before", T.StringType()),
    T.StructField("state_after", T.StringType()),
])
BREAKER_STATE = T.StructType([
    T.StructField("mode", T.StringType()), T.StructField("failures", T.LongType()),
    T.StructField("opened_at_us", T.LongType()),
])


def breaker_step(mode: str, failures: int, opened_us: int, outcome: str, t_us: int,
                 threshold: int, timeout_s: int) -> tuple[str, str, int, int]:
    """One outcome through the breaker: (state_before, state_after, failures, opened_at)."""
    if mode == "OPEN" and t_us - opened_us > timeout_s * 1_000_000:
        mode = "HALF_OPEN"
    before = mode
    if outcome == "SUCCESS":
        return before, "CLOSED", 0, opened_us
    failures += 1
    if mode == "HALF_OPEN" or failures >= threshold:
        return before, "OPEN", failures, t_us
    return before, mode, failures, opened_us


def breaker_stream(outcomes: DataFrame, threshold: int = BREAKER_FAILURE_THRESHOLD,
                   timeout_s: int = BREAKER_RECOVERY_SECONDS) -> DataFrame:
    """T9 on a stream of (id, task_id, ts, outcome): breaker state before/after each outcome."""
    import pandas as pd

    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            mode, failures, opened = state.get
        else:
            mode, failures, opened = "CLOSED", 0, 0
        rows = pd.concat(list(pdfs)).sort_values(["ts", "id"])
        out = []
        for r in rows.itertuples(index=False):
            t_us = int(pd.Timestamp(r.ts).value // 1000)
            k = failures
            before, after, failures, opened = breaker_step(mode, failures, opened, r.outcome, t_us,
                                                           threshold, timeout_s)
            out.append((r.id, r.task_id, r.ts, r.outcome, k, before, after))
            mode = after
        state.update((mode, int(failures), int(opened)))
        yield pd.DataFrame(out, columns=BREAKER_OUT.fieldNames())

    return outcomes.groupBy("task_id").applyInPandasWithState(
        run, BREAKER_OUT, BREAKER_STATE, "append", GroupStateTimeout.NoTimeout)


STABILITY_OUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("file_path", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("stable_count", T.LongType()),
    T.StructField("fire", T.BooleanType()),
])
STABILITY_STATE = T.StructType([T.StructField("sig", T.StringType()), T.StructField("count", T.LongType())])


def stability_stream(observations: DataFrame, signature: list[str], checks: int = 3) -> DataFrame:
    """T5 on a stream of observations (id, file_path, ts, signature...): fire on the
    ``checks``-th identical consecutive observation, then count afresh."""
    import json

    import pandas as pd

    def run(key, pdfs, state):
        sig, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(pdfs)).sort_values(["ts", "id"])
        out = []
        for r in rows.itertuples(index=False):
            cur = json.dumps([str(getattr(r, c)) for c in signature])
            count = count + 1 if cur == sig else 1
            fire = count >= checks
            out.append((r.id, r.file_path, r.ts, count, fire))
            if fire:  # emitted: the watcher forgets the file
                sig, count = None, 0
            else:
                sig = cur
        state.update((sig, int(count)))
        yield pd.DataFrame(out, columns=STABILITY_OUT.fieldNames())

    return observations.groupBy("file_path").applyInPandasWithState(
        run, STABILITY_OUT, STABILITY_STATE, "append", GroupStateTimeout.NoTimeout)
