from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelake.operators import runlog as r

T0 = datetime(2026, 7, 20, 0, 1)
SCHEMA = "dag_id string, run_id string, run_type string, task_id string, state string, start_date timestamp_ntz, end_date timestamp_ntz"


@pytest.fixture
def instances(spark):
    rows = [
        ("d", "r1", "Scheduled", "first", "success", T0, datetime(2026, 7, 20, 0, 2)),
        ("d", "r1", "Scheduled", "upstream", "upstream_failed", None, None),
        ("d", "r1", "Scheduled", "failed_task", "failed", T0, datetime(2026, 7, 20, 0, 5)),
        ("d", "r1", "Scheduled", "failed_task", "failed", T0, datetime(2026, 7, 20, 0, 5)),
        ("d", "r2", "manual", "first", "success", T0, None),
        ("d", "r3", "backfill", "a", "upstream_failed", datetime(2026, 7, 20, 9), datetime(2026, 7, 20, 8)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_failed_and_primary(instances):
    lists = {x.run_id: x.failed_tasks for x in r.failed_tasks(instances).collect()}
    assert lists == {"r1": ["failed_task", "upstream"], "r3": ["a"]}
    first = {x.run_id: x.primary_task for x in r.primary_failed(instances).collect()}
    assert first == {"r1": "failed_task", "r2": None, "r3": None}


def test_summary(instances):
    got = {x.run_id: tuple(x)[3:] for x in r.run_summary(instances).collect()}
    assert got == {
        "r1": (True, "failed_task, upstream", "failed_task", "4m 0s"),
        "r2": (False, "unknown", None, "unknown"),
        "r3": (False, "a", None, "0m 0s"),
    }


@pytest.mark.parametrize(
    ("seconds", "want"), [(0, "0m 0s"), (61, "1m 1s"), (3600, "1h 0m 0s"), (90_061, "25h 1m 1s")]
)
def test_duration(spark, seconds, want):
    df = spark.createDataFrame([(T0, seconds)], "a timestamp_ntz, s int")
    end = F.col("a") + F.make_dt_interval(secs=F.col("s"))
    assert df.select(r.duration_text(F.col("a"), end)).first()[0] == want


def test_failure_rules_precedence(spark):
    rules = [
        r.FailureRule("load", "waiting", prefix="wait_"),
        r.FailureRule("load", "special", task_id="wait_x"),
        r.FailureRule("train", "training", task_id="fit"),
    ]
    cases = {
        ("load", "wait_x"): "special",
        ("load", "wait_y"): "waiting",
        ("train", "wait_y"): "unregistered task",
        ("train", "fit"): "training",
        ("other", "fit"): "unregistered task",
        ("load", None): "unregistered task",
    }
    tasks = spark.createDataFrame(list(cases), "dag_id string, task_id string")
    got = {(x.dag_id, x.task_id): x.area for x in r.classify_failures(tasks, rules).collect()}
    assert got == cases


def test_telemetry(spark):
    lines = [
        (1, '{"event": "attempt", "n": 1}'),
        (2, '{"event": "attempt", "note": "Bearer abc"}'),
        (3, '{"message": "no event"}'),
        (4, "INFO plain"),
        (5, '{"event": "job_summary", "job": "j", "status": "failed", "mode": "rebuild", "tables": ["a"]}'),
        (6, '{"event": "job_summary", "job": "j", "status": "succeeded", "mode": "rebuild", "tables": ["a", "b"]}'),
        (7, None),
    ]
    df = spark.createDataFrame(lines, "n long, line string")
    got = {x.event: (x.lines, x.leaking_lines) for x in r.telemetry_counts(df).collect()}
    assert got == {"attempt": (2, 1), "job_summary": (2, 0)}
    last = r.last_job_summary(df, "n").first()
    assert (last.job, last.status, last.mode, last.tables) == ("j", "succeeded", "rebuild", '["a","b"]')
