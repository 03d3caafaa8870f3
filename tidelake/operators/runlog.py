"""Run logs: failed tasks, run summaries, failure classes and telemetry lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.redact import redact

# States that count as failed, and run types started by the scheduler.
FAILED_STATES = ("failed", "upstream_failed")
AUTOMATED_RUN_TYPES = ("scheduled", "asset_triggered", "dataset_triggered")
UNKNOWN = "unknown"


def failed_tasks(instances: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Sorted ids of the failed tasks of each run that has any.

    Ids are made distinct first, so a run's list is as long as its graph has tasks.
    """
    failed = instances.where(F.col("state").isin(*FAILED_STATES)).select(*run, "task_id").distinct()
    return failed.groupBy(*run).agg(F.sort_array(F.collect_list("task_id")).alias("failed_tasks"))


def primary_failed(instances: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Smallest id of a task that failed itself; NULL if a run has none."""
    own = F.when(F.col("state") == "failed", F.col("task_id"))
    return instances.groupBy(*run).agg(F.min(own).alias("primary_task"))


def duration_text(start: Column, end: Column) -> Column:
    """``1h 2m 3s`` or ``4m 0s``; a negative span is 0, a missing end unknown."""
    seconds = F.greatest(_whole_seconds(start, end), F.lit(0).cast("long"))
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    text = F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, rest)).otherwise(
        F.format_string("%dm %ds", minutes, rest)
    )
    return F.when(start.isNull() | end.isNull(), F.lit(UNKNOWN)).otherwise(text)


def _whole_seconds(start: Column, end: Column) -> Column:
    return (end - start).cast("interval second").cast("long")


def run_summary(instances: DataFrame) -> DataFrame:
    """One row per run: automated or not, failed tasks, the primary one, duration.

    A run starts with its first task and ends with its last. Task states are reduced
    to one row per run and task before the lists are built.
    """
    run = ["dag_id", "run_id", "run_type"]
    per_task = instances.groupBy(*run, "task_id").agg(
        F.max(F.col("state").isin(*FAILED_STATES)).alias("_failed"),
        F.max(F.col("state") == "failed").alias("_own"),
        F.min("start_date").alias("start_date"),
        F.max("end_date").alias("end_date"),
    )
    names = F.sort_array(F.collect_list(F.when(F.col("_failed"), F.col("task_id"))))
    summary = per_task.groupBy(*run).agg(
        names.alias("_names"),
        F.min(F.when(F.col("_own"), F.col("task_id"))).alias("primary_task"),
        F.min("start_date").alias("start_date"),
        F.max("end_date").alias("end_date"),
    )
    listed = F.when(F.size("_names") > 0, F.array_join("_names", ", "))
    return summary.select(
        *run,
        F.lower("run_type").isin(*AUTOMATED_RUN_TYPES).alias("automated"),
        F.coalesce(listed, F.lit(UNKNOWN)).alias("failed_tasks"),
        "primary_task",
        duration_text(F.col("start_date"), F.col("end_date")).alias("duration"),
    )


@dataclass(frozen=True)
class FailureRule:
    """Area of a failure, for an exact task or for a task prefix of one graph."""

    dag_id: str
    area: str
    task_id: str | None = None
    prefix: str | None = None


def classify_failures(
    tasks: DataFrame, rules: Sequence[FailureRule], default: str = "unregistered task"
) -> DataFrame:
    """Add ``area``: an exact rule wins over a prefix rule, else the default.

    Rules are settings, not data, so they become one expression without a join.
    """

    def matches(rule: FailureRule) -> Column:
        same_dag = F.col("dag_id") == rule.dag_id
        if rule.task_id is not None:
            return same_dag & (F.col("task_id") == rule.task_id)
        return same_dag & F.startswith(F.col("task_id"), F.lit(rule.prefix))

    ordered = [r for r in rules if r.task_id is not None] + [r for r in rules if r.task_id is None]
    area = F.lit(None).cast("string")
    for rule in reversed(ordered):
        area = F.when(matches(rule), F.lit(rule.area)).otherwise(area)
    return tasks.withColumn("area", F.coalesce(area, F.lit(default)))


def telemetry_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """Structured log lines per event name, and how many of them leak a credential.

    Lines that are no JSON object or carry no ``event`` are ordinary logs.
    """
    event = F.try_variant_get(F.try_parse_json(column), "$.event", "string")
    leaks = redact(F.col(column), None) != F.col(column)
    return (
        lines.select(event.alias("event"), leaks.alias("_leak"))
        .where(F.col("event").isNotNull())
        .groupBy("event")
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if("_leak").alias("leaking_lines"))
    )


def last_job_summary(lines: DataFrame, order: str, column: str = "line") -> DataFrame:
    """The last ``job_summary`` line of each job: status, mode and tables."""
    doc = F.try_parse_json(column)
    fields = {
        k: F.try_variant_get(doc, f"$.{k}", "string") for k in ("event", "job", "status", "mode", "tables")
    }
    parsed = lines.select(order, *[c.alias(k) for k, c in fields.items()])
    kept = parsed.where(F.col("event") == "job_summary")
    last = F.max_by(F.struct("status", "mode", "tables"), order).alias("_last")
    return kept.groupBy("job").agg(last).select("job", "_last.*")
