import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelake.operators.coverage import coverage, ready_dates, window_gaps, write_conflicts
from tidelake.operators.objects import audit_objects, is_strict_path, partition_object, split_base_path
from tidelake.operators.requests import ACTION_LOG, BACKFILL, resolve_requests, validate_requests
from tidelake.operators.results import audit_results


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("gs://reef/tide/daily", ("reef", "tide/daily")),
        ("gs://reef/tide/hourly/", ("reef", "tide/hourly")),
        ("", None),
        ("reef/tide", None),
        ("gs://", None),
        ("gs://reef", None),
        ("gs://reef/", None),
    ],
)
def test_base_path(spark, uri, want):
    df = spark.createDataFrame([(uri,)], "u string")
    got = df.select(split_base_path(F.col("u"))).first()[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "uri",
    ["", "reef/tide", "gs://reef/tide//x", "gs://reef/tide/", "gs://b/a\\c",
     "gs://b/../c", "gs://b", "gs:///x", None],
)
def test_strict_path_refuses(spark, uri):
    df = spark.createDataFrame([(uri,)], "u string")
    assert df.select(is_strict_path(F.col("u"))).first()[0] is False


OBJECTS = {
    "gs://b/lake/log/dt=2024-01-02/part-0.parquet": ("b", "lake/log", date(2024, 1, 2), "canonical"),
    "gs://b/dt=2024-01-02/part-00001-x.snappy.parquet": ("b", "", date(2024, 1, 2), "canonical"),
    "gs://b/l/dt=2024-01-02/part-0.parquet.staging-11aa22bb": ("b", "l", date(2024, 1, 2), "staging"),
    "gs://b/l/dt=2024-01-02/shard=001/part-0.parquet": ("b", "l", date(2024, 1, 2), "shard"),
    "gs://b/l/dt=2024-01-02/quarantine.jsonl": ("b", "l", date(2024, 1, 2), "other"),
    "gs://b/l/dt=2024-02-30/part-0.parquet": ("b", "l/dt=2024-02-30", None, "other"),
    "gs://b/l/../dt=2024-01-02/part-0.parquet": (None, None, None, "not_normalized"),
    "gs://b/l//dt=2024-01-02/part-0.parquet": (None, None, None, "not_normalized"),
    "gs://b": (None, None, None, "not_normalized"),
    "s3://b/l/dt=2024-01-02/part-0.parquet": (None, None, None, "foreign"),
}


@pytest.mark.parametrize("strict", [False, True])
def test_object_classes(spark, strict):
    df = spark.createDataFrame([(u,) for u in OBJECTS], "uri string")
    rows = {r.uri: (r.bucket, r.prefix, r.dt, r["class"]) for r in audit_objects(df, strict=strict).collect()}
    assert rows == OBJECTS


def test_outer_slash_only_matters_in_strict_mode(spark):
    df = spark.createDataFrame([("gs://b/l/dt=2024-01-02/part-0.parquet/",), (None,)], "uri string")
    assert [r["class"] for r in audit_objects(df).collect()] == ["canonical", "foreign"]
    assert audit_objects(df, strict=True).first()["class"] == "not_normalized"


PREFIX = "gs://reef/qa/action-log/trial-3"
QA = {
    "qa_prefix": PREFIX,
    "youtube_base_path": f"{PREFIX}/source",
    "virtual_users_path": f"{PREFIX}/people",
    "action_log_output_base_path": f"{PREFIX}/log",
    "action_log_quarantine_base_path": f"{PREFIX}/aside",
}


def errors(spark, conf, kind=ACTION_LOG):
    text = conf if isinstance(conf, str) else json.dumps(conf)
    df = spark.createDataFrame([(text,)], "conf string")
    return validate_requests(df, kind).first().errors


@pytest.mark.parametrize(
    "conf",
    [
        {},
        {"partition_date": "2024-01-01", "overwrite": True},
        QA,
        {**QA, "candidates_per_user": 37},
        {**QA, "candidates_per_user": " 37 "},
        {**QA, "qa_prefix": PREFIX + "/"},
        {**QA, "youtube_base_path": f"  {PREFIX}/source//  "},
    ],
)
def test_valid_requests(spark, conf):
    assert errors(spark, conf) == []


@pytest.mark.parametrize(
    ("conf", "error"),
    [
        ({"qa_prefix": PREFIX, "youtube_base_path": f"{PREFIX}/y"}, "paths are missing"),
        ({**QA, "youtube_base_path": 7}, "paths are missing"),
        ({"candidates_per_user": 37}, "qa_prefix is missing"),
        ({**QA, "qa_prefix": "gs://reef/live/log"}, "qa_prefix is outside its namespace"),
        ({**QA, "qa_prefix": "gs://reef/qa/action-log"}, "qa_prefix is outside its namespace"),
        ({**QA, "qa_prefix": "gs://reef//qa/action-log/trial-3"}, "qa_prefix is not normalized"),
        ({**QA, "action_log_output_base_path": "gs://reef/live/log"}, "path is outside qa_prefix"),
        ({**QA, "action_log_output_base_path": PREFIX + "-2/x"}, "path is outside qa_prefix"),
        ({**QA, "action_log_quarantine_base_path": f"{PREFIX}/log"}, "paths are not distinct"),
        ({**QA, "youtube_base_path": f"{PREFIX}/../source"}, "path is not normalized"),
        ({"colour": "x"}, "unsupported keys: colour"),
        ({"speed": 1, "colour": "x"}, "unsupported keys: colour, speed"),
        ({**QA, "candidates_per_user": 0}, "candidates_per_user is out of range"),
        ({**QA, "candidates_per_user": "201"}, "candidates_per_user is out of range"),
        ({**QA, "candidates_per_user": True}, "candidates_per_user is not an integer"),
        ({**QA, "candidates_per_user": "3.7"}, "candidates_per_user is not an integer"),
        ({**QA, "candidates_per_user": 37.0}, "candidates_per_user is not an integer"),
        ({**QA, "candidates_per_user": None}, "candidates_per_user is not an integer"),
        ({**QA, "qa_prefix": "/"}, "qa_prefix is not normalized"),
        ({**QA, "qa_prefix": {"a": 1}}, "qa_prefix is missing"),
        ({**QA, "candidates_per_user": "a few"}, "candidates_per_user is not an integer"),
        ({**QA, "candidates_per_user": "9" * 60}, "candidates_per_user is out of range"),
        ("[1]", "not a JSON object"),
        ("{", "not a JSON object"),
    ],
)
def test_invalid_requests(spark, conf, error):
    assert error in errors(spark, conf)


RUN = "gs://reef/qa/youtube-backfill/trial-3"
FILL = {"qa_prefix": RUN, "source_path": f"{RUN}/from", "youtube_base_path": f"{RUN}/to"}


def test_backfill_requests(spark):
    assert errors(spark, {}, BACKFILL) == [] and errors(spark, FILL, BACKFILL) == []
    for conf, error in (
        ({"source_path": FILL["source_path"]}, "paths are missing"),
        ({**FILL, "colour": "x"}, "unsupported keys: colour"),
        ({**FILL, "youtube_base_path": "gs://reef/live/to"}, "path is outside qa_prefix"),
        ({**FILL, "qa_prefix": "gs://reef/qa/sandbox/trial-3"}, "qa_prefix is outside its namespace"),
        ({**FILL, "qa_prefix": RUN + "/deep"}, "qa_prefix is outside its namespace"),
        ({**FILL, "qa_prefix": RUN + "/"}, "qa_prefix is not normalized"),
        ({**FILL, "youtube_base_path": FILL["source_path"]}, "paths are not distinct"),
    ):
        assert error in errors(spark, conf, BACKFILL), conf


def test_requests_resolve_to_their_own_paths_or_the_fallbacks(spark):
    fallbacks = {k: f"gs://prod/{k}" for k in ACTION_LOG.paths}
    confs = [{}, {**QA, "candidates_per_user": "30"}, {"colour": "x"}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(confs)], "i int, conf string")
    rows = {r.i: r for r in resolve_requests(df, ACTION_LOG, fallbacks).collect()}
    assert [rows[0][k] for k in ACTION_LOG.paths] == list(fallbacks.values())
    assert [rows[1][k] for k in ACTION_LOG.paths] == [QA[k] for k in ACTION_LOG.paths]
    assert (rows[0].candidates_per_user, rows[1].candidates_per_user) == (24, 30)
    assert rows[2].errors and all(rows[2][k] is None for k in ACTION_LOG.paths)
    with pytest.raises(ValueError):
        resolve_requests(df, ACTION_LOG, {})


def test_partition_object(spark):
    rows = [("gs://b/lake/log/", date(2024, 1, 2)), ("gs://b", date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "u string, d date")
    got = [r[0] for r in df.select(partition_object(F.col("u"), F.col("d"))).collect()]
    assert got == ["lake/log/dt=2024-01-02/part-0.parquet", None]


RECORD = {
    "event": "model_promotion_result",
    "contract_version": "model-promotion-result-v1",
    "outcome": "promoted",
    "reason_code": "metric_not_degraded",
    "model_name": "tide",
    "champion_alias": "best",
    "candidate_version": "31",
    "champion_version": "29",
    "metric_name": "val_roc_auc",
    "candidate_metric": 0.6425,
    "champion_metric": 0.6375,
}
NO_CHAMPION = {"champion_version": None, "champion_metric": None}
REJECTED = {"outcome": "rejected", "reason_code": "metric_below_champion"}


def result_errors(spark, change):
    df = spark.createDataFrame([(json.dumps({**RECORD, **change}),)], "record string")
    return audit_results(df).first().errors


@pytest.mark.parametrize(
    "change",
    [
        {},
        REJECTED,
        {"reason_code": "first_champion", **NO_CHAMPION},
        {"outcome": "rejected", "reason_code": "calibration_artifact_missing", **NO_CHAMPION},
        {"outcome": "rejected", "reason_code": "serving_calibration_not_ready"},
        {"candidate_metric": 1},
    ],
)
def test_valid_results(spark, change):
    assert result_errors(spark, change) == []


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"event": "other"}, "unknown contract"),
        ({"contract_version": "v0"}, "unknown contract"),
        ({"outcome": "no_candidate"}, "unknown outcome"),
        ({"outcome": "error"}, "unknown outcome"),
        ({"reason_code": "metric_below_champion"}, "reason does not fit the outcome"),
        ({"outcome": "rejected"}, "reason does not fit the outcome"),
        ({"outcome": "rejected", "reason_code": "felt_right"}, "reason does not fit the outcome"),
        ({"reason_code": None}, "reason does not fit the outcome"),
        ({"model_name": None}, "model_name is missing"),
        ({"champion_alias": " "}, "champion_alias is missing"),
        ({"candidate_version": 31}, "candidate_version is missing"),
        ({"metric_name": "log_loss"}, "unknown metric"),
        ({"candidate_metric": None}, "candidate_metric is not a finite number"),
        ({"candidate_metric": True}, "candidate_metric is not a finite number"),
        ({"candidate_metric": "0.6425"}, "candidate_metric is not a finite number"),
        ({"champion_metric": "0.6375"}, "champion is incomplete"),
        ({**REJECTED, **NO_CHAMPION}, "champion is incomplete"),
        ({"reason_code": "first_champion"}, "first champion has a predecessor"),
        (
            {"outcome": "rejected", "reason_code": "calibration_artifact_missing", "champion_metric": None},
            "champion is half given",
        ),
    ],
)
def test_invalid_results(spark, change, error):
    assert error in result_errors(spark, change)


def test_unparsable_record_is_an_error(spark):
    df = spark.createDataFrame([("{",), (None,)], "record string")
    assert all(r.errors for r in audit_results(df).collect())


DAY = date(2024, 1, 1)


def test_coverage_both_ways(spark):
    schema = "table_name string, dt date"
    produced = spark.createDataFrame([("a", DAY), ("a", DAY), ("b", DAY)], schema)
    required = spark.createDataFrame([("b", DAY), ("c", DAY)], schema)
    got = {tuple(r) for r in coverage(produced, required, ["table_name", "dt"]).collect()}
    assert got == {("a", DAY, "not_required"), ("c", DAY, "not_produced")}
    assert [tuple(r) for r in write_conflicts(produced, required).collect()] == [("b", DAY)]


def test_ready_needs_every_table(spark):
    from datetime import datetime

    at = [datetime(2024, 1, 2, h) for h in range(4)]
    rows = [("a", DAY, at[0]), ("b", DAY, at[2]), ("a", DAY, at[3]), ("x", DAY, at[1]),
            ("a", date(2024, 1, 2), at[0]), ("b", date(2024, 1, 3), None)]
    ledger = spark.createDataFrame(rows, "table_name string, dt date, validated_at timestamp_ntz")
    assert [tuple(r) for r in ready_dates(ledger, ["a", "b"]).collect()] == [(DAY, at[2])]


def test_window_gaps(spark):
    rows = [("a", DAY), ("a", date(2024, 1, 3)), ("b", date(2024, 1, 2)), ("x", date(2024, 1, 2))]
    inventory = spark.createDataFrame(rows, "table_name string, dt date")
    got = {(r.table_name, r.dt.day) for r in window_gaps(inventory, ["a", "b"], DAY, date(2024, 1, 3)).collect()}
    assert got == {("a", 2), ("b", 1), ("b", 3)}
