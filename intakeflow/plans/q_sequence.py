"""Driver queries: ordered scans per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intakeflow.operators.sequence import (breaker_replay, debounce_sessions, failure_streaks,
                                           stability_runs)
from intakeflow.plans.catalog import register
from intakeflow.sources.fixtures import FILE_EVENTS_SQL, OUTCOMES_SQL, file_event_rows, outcome_rows, with_cte
from intakeflow.spec import BREAKER_FAILURE_THRESHOLD, BREAKER_RECOVERY_SECONDS

DEBOUNCE_SECONDS = 600
STABILITY_CHECKS = 3

_RUNS = """
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, id) AS rn FROM o),
m AS (SELECT *, coalesce(max(CASE WHEN outcome = 'SUCCESS' THEN rn END) OVER (
        PARTITION BY task_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lm,
      lag(ts) OVER (PARTITION BY task_id ORDER BY ts, id) AS prev_ts
      FROM r)
"""


@register("failure_streaks", oracle=with_cte(f"""
, {_RUNS.strip()}
SELECT id, task_id, ts, outcome,
       CASE WHEN outcome = 'FAILED' THEN rn - lm ELSE 0 END AS consecutive_failures,
       CASE WHEN outcome = 'FAILED' THEN rn - lm ELSE 0 END >= {BREAKER_FAILURE_THRESHOLD} AS tripped
FROM m
""".replace("\n, ", ", ", 1), o=OUTCOMES_SQL))
def failure_streaks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures per task, reset by success; threshold 5."""
    return failure_streaks(outcome_rows(spark, sf_dir))


_B_K = "(rn - lm - 1)"
_B_BEFORE = (f"CASE WHEN {_B_K} >= {BREAKER_FAILURE_THRESHOLD} THEN CASE WHEN "
             f"date_diff('microsecond', prev_ts, ts) > {BREAKER_RECOVERY_SECONDS * 1_000_000} "
             "THEN 'HALF_OPEN' ELSE 'OPEN' END ELSE 'CLOSED' END")


@register("breaker_replay", oracle=with_cte(f"""
, {_RUNS.strip()}
SELECT id, task_id, ts, outcome, {_B_K} AS failures_before, {_B_BEFORE} AS state_before,
       CASE WHEN outcome = 'SUCCESS' THEN 'CLOSED'
            WHEN {_B_BEFORE} = 'HALF_OPEN' OR {_B_K} + 1 >= {BREAKER_FAILURE_THRESHOLD} THEN 'OPEN'
            ELSE 'CLOSED' END AS state_after
FROM m
""".replace("\n, ", ", ", 1), o=OUTCOMES_SQL))
def breaker_replay_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuit-breaker state before/after each outcome (threshold 5, recovery 60 s)."""
    return breaker_replay(outcome_rows(spark, sf_dir))


@register("stable_files", oracle=with_cte(f"""
, p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts, id) AS rn,
           lag(file_day) OVER (PARTITION BY file_path ORDER BY ts, id) AS p_day,
           lag(file_size) OVER (PARTITION BY file_path ORDER BY ts, id) AS p_size,
           lag(id) OVER (PARTITION BY file_path ORDER BY ts, id) AS p_id
    FROM fe),
c AS (SELECT *, p_id IS NULL OR p_day IS DISTINCT FROM file_day OR p_size IS DISTINCT FROM file_size AS changed
      FROM p),
l AS (SELECT *, max(CASE WHEN changed THEN rn END) OVER (PARTITION BY file_path ORDER BY ts, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lm FROM c),
x AS (SELECT *, CASE WHEN changed THEN 1 ELSE rn - lm + 1 END AS run_length FROM l)
SELECT id, file_path, ts, file_day, file_size, run_length,
       (run_length - 1) % {STABILITY_CHECKS} + 1 AS stable_count,
       (run_length - 1) % {STABILITY_CHECKS} + 1 = {STABILITY_CHECKS} AS fire
FROM x
""".replace("\n, ", ", ", 1), fe=FILE_EVENTS_SQL))
def stable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run length of identical (day, size) observations per path; fire every 3rd identical check."""
    return stability_runs(file_event_rows(spark, sf_dir), ["file_day", "file_size"], checks=STABILITY_CHECKS)


@register("debounce_sessions", oracle=with_cte(f"""
, p AS (SELECT *, lag(ts) OVER (PARTITION BY file_path ORDER BY ts, id) AS prev_ts FROM fe),
s AS (SELECT *, prev_ts IS NULL OR date_diff('microsecond', prev_ts, ts) > {DEBOUNCE_SECONDS * 1_000_000} AS st FROM p),
f AS (SELECT *, max(CASE WHEN st THEN ts END) OVER (PARTITION BY file_path ORDER BY ts, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start FROM s)
SELECT file_path, session_start, max(ts) AS session_end, count(*) AS events,
       max(ts) + INTERVAL {DEBOUNCE_SECONDS} SECOND AS fire_at
FROM f GROUP BY file_path, session_start
""".replace("\n, ", ", ", 1), fe=FILE_EVENTS_SQL))
def debounce_sessions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: per-path bursts closer than 600 s collapse into one firing after the last event."""
    return debounce_sessions(file_event_rows(spark, sf_dir), DEBOUNCE_SECONDS)
