"""Queries on run logs and telemetry lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.registry import query, with_ctes
from tidelake.operators.runlog import (
    FailureRule,
    classify_failures,
    failed_tasks,
    last_job_summary,
    primary_failed,
    run_summary,
    telemetry_counts,
)

# Text both engines understand: task records made from the events.
_FIELDS = {
    "dag_id": "CASE user_id % 3 WHEN 0 THEN 'raw_load' WHEN 1 THEN 'feature_build' ELSE 'train' END",
    "run_id": "'run_' || CAST(user_id AS STRING)",
    "run_type": """CASE user_id % 5 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'Dataset_Triggered'
      WHEN 2 THEN 'manual' WHEN 3 THEN 'asset_triggered' ELSE 'backfill' END""",
    "task_id": """CASE video_id % 4 WHEN 0 THEN 'load_' WHEN 1 THEN 'wait_' WHEN 2 THEN 'build_'
      ELSE 'check_' END || CAST(video_id AS STRING)""",
    "state": """CASE event_type WHEN 'error' THEN 'failed' WHEN 'like' THEN 'upstream_failed'
      WHEN 'view' THEN 'running' ELSE 'success' END""",
}
_INSTANCES = f"""instances AS (
  SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _FIELDS.items())},
    event_timestamp AS start_date,
    CASE WHEN event_type <> 'view'
      THEN event_timestamp + to_seconds(CAST(floor(value) AS BIGINT)) END AS end_date
  FROM log)"""


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    ended = F.col("event_timestamp") + F.make_dt_interval(secs=F.floor("value"))
    return s.action_log(spark, sf).select(
        "event_id",
        *[F.expr(e).alias(n) for n, e in _FIELDS.items()],
        F.col("event_timestamp").alias("start_date"),
        F.when(F.col("event_type") != "view", ended).alias("end_date"),
    )


@query(
    "failed_tasks",
    with_ctes(
        """SELECT run_id, string_agg(DISTINCT task_id, ', ' ORDER BY task_id) AS failed_tasks
        FROM instances WHERE state IN ('failed', 'upstream_failed') GROUP BY run_id""",
        s.LOG,
        _INSTANCES,
    ),
)
def failed(spark: SparkSession, sf: str) -> DataFrame:
    lists = failed_tasks(_instances(spark, sf))
    return lists.withColumn("failed_tasks", F.array_join("failed_tasks", ", "))


@query(
    "primary_failed_task",
    with_ctes(
        """SELECT run_id, min(task_id) FILTER (state = 'failed') AS primary_task
        FROM instances GROUP BY run_id""",
        s.LOG,
        _INSTANCES,
    ),
)
def primary(spark: SparkSession, sf: str) -> DataFrame:
    return primary_failed(_instances(spark, sf))


@query(
    "run_summary",
    with_ctes(
        """SELECT dag_id, run_id, run_type,
          lower(run_type) IN ('scheduled', 'asset_triggered', 'dataset_triggered') AS automated,
          coalesce(failed, 'unknown') AS failed_tasks, primary_task,
          CASE WHEN seconds IS NULL THEN 'unknown'
            WHEN seconds >= 3600 THEN (seconds // 3600) || 'h ' || (seconds // 60 % 60) || 'm '
              || (seconds % 60) || 's'
            ELSE (seconds // 60) || 'm ' || (seconds % 60) || 's' END AS duration
        FROM (SELECT dag_id, run_id, run_type,
            string_agg(DISTINCT task_id, ', ' ORDER BY task_id)
              FILTER (state IN ('failed', 'upstream_failed')) AS failed,
            min(task_id) FILTER (state = 'failed') AS primary_task,
            greatest(CAST(floor(epoch_us(max(end_date)) / 1000000.0
              - epoch_us(min(start_date)) / 1000000.0) AS BIGINT), 0) AS seconds
          FROM instances GROUP BY ALL)""",
        s.LOG,
        _INSTANCES,
    ),
)
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return run_summary(_instances(spark, sf))


RULES = [
    FailureRule("raw_load", "input wait", prefix="wait_"),
    FailureRule("raw_load", "raw load", prefix="load_"),
    FailureRule("raw_load", "raw check", prefix="check_"),
    FailureRule("raw_load", "raw load of item 8", task_id="load_8"),
    FailureRule("feature_build", "feature build", task_id="build_2"),
    FailureRule("train", "training", task_id="check_3"),
]


@query(
    "failure_classify",
    with_ctes(
        """SELECT event_id, dag_id, task_id, coalesce(e.area, p.area, 'unregistered task') AS area
        FROM instances i
        LEFT JOIN (VALUES ('raw_load', 'load_8', 'raw load of item 8'),
          ('feature_build', 'build_2', 'feature build'), ('train', 'check_3', 'training'))
          e(dag, task, area) ON e.dag = i.dag_id AND e.task = i.task_id
        LEFT JOIN (VALUES ('raw_load', 'wait_', 'input wait'), ('raw_load', 'load_', 'raw load'),
          ('raw_load', 'check_', 'raw check')) p(dag, prefix, area)
          ON p.dag = i.dag_id AND starts_with(i.task_id, p.prefix)
        WHERE state = 'failed'""",
        s.LOG,
        _INSTANCES,
    ),
)
def classify(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _instances(spark, sf).where(F.col("state") == "failed")
    return classify_failures(tasks, RULES).select("event_id", "dag_id", "task_id", "area")


_LINE = """CASE event_id % 7
  WHEN 0 THEN 'plain line ' || CAST(event_id AS STRING)
  WHEN 1 THEN '{"event": "job_summary", "job": "job_' || CAST(user_id % 5 AS STRING)
    || '", "status": "' || CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END
    || '", "mode": "rebuild", "tables": "t' || CAST(video_id AS STRING) || '"}'
  WHEN 2 THEN '{"level": "INFO", "n": ' || CAST(event_id AS STRING) || '}'
  WHEN 3 THEN '{"event": "' || event_type || '", "note": "token=' || md5(event_type) || '"}'
  ELSE '{"event": "' || event_type || '", "n": ' || CAST(event_id AS STRING) || '}' END"""
_LINES = f"lines AS (SELECT event_id, {_LINE} AS line FROM log)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return s.action_log(spark, sf).select("event_id", F.expr(_LINE).alias("line"))


@query(
    "telemetry_counts",
    with_ctes(
        """SELECT json_extract_string(line, '$.event') AS event, count(*) AS lines,
          count(*) FILTER (regexp_matches(line, 'token=[^\\s,;]+')) AS leaking_lines
        FROM (SELECT CASE WHEN json_valid(line) THEN line END AS line FROM lines)
        WHERE json_extract_string(line, '$.event') IS NOT NULL GROUP BY event""",
        s.LOG,
        _LINES,
    ),
)
def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry_counts(_lines(spark, sf))


@query(
    "job_summary_last",
    with_ctes(
        """SELECT line->>'job' AS job, arg_max(line->>'status', event_id) AS status,
          arg_max(line->>'mode', event_id) AS mode, arg_max(line->>'tables', event_id) AS tables
        FROM (SELECT event_id, CAST(line AS JSON) AS line FROM lines WHERE json_valid(line))
        WHERE line->>'event' = 'job_summary' GROUP BY job""",
        s.LOG,
        _LINES,
    ),
)
def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    return last_job_summary(_lines(spark, sf), "event_id")
