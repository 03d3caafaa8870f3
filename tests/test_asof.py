import random
from datetime import date, datetime, timedelta

import pytest

from tidelake.operators.asof import pit_join, span_of, with_static
from tidelake.plans.training import View, training_dataset

START = datetime(2024, 1, 1)


def frames(spark, seed, n=300, m=120, keys=3, step=17):
    rng = random.Random(seed)
    spine = [
        (
            i,
            None if rng.random() < 0.05 else rng.randrange(keys),
            START + timedelta(minutes=step * rng.randrange(300)),
        )
        for i in range(n)
    ]
    unique = {(rng.randrange(keys + 1), step * rng.randrange(300)) for _ in range(m)}
    view = [
        (k, START + timedelta(minutes=t), None if rng.random() < 0.2 else rng.random())
        for k, t in sorted(unique)
    ]
    return (
        spine,
        view,
        spark.createDataFrame(spine, "event_id long, user_id long, event_timestamp timestamp_ntz"),
        spark.createDataFrame(view, "user_id long, event_timestamp timestamp_ntz, x double"),
    )


def brute_force(spine, view):
    found = {}
    for event, key, at in spine:
        past = [(t, x) for k, t, x in view if k == key and t <= at]
        found[event] = max(past, key=lambda p: p[0]) if past else (None, None)
    return found


@pytest.mark.parametrize("bucket", [60, 600, 86_400])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_latest_earlier_row_wins(spark, seed, bucket):
    spine, view, left, right = frames(spark, seed)
    joined = pit_join(left, right, ["user_id"], ["x"], prefix="f_", bucket_seconds=bucket)
    got = joined.collect()
    assert len(got) == len(spine)
    assert {r.event_id: (r.f_event_timestamp, r.f_x) for r in got} == brute_force(spine, view)
    assert joined.columns == ["event_id", "user_id", "event_timestamp", "f_event_timestamp", "f_x"]


def test_null_feature_of_the_latest_row_is_not_filled_from_an_older_one(spark):
    left = spark.createDataFrame([(1, 1, START)], "event_id long, user_id long, event_timestamp timestamp_ntz")
    right = spark.createDataFrame(
        [(1, START - timedelta(days=9), 5.0), (1, START - timedelta(days=1), None)],
        "user_id long, event_timestamp timestamp_ntz, x double",
    )
    row = pit_join(left, right, ["user_id"], ["x"]).first()
    assert row.x is None and row.feature_timestamp == START - timedelta(days=1)


def test_no_future_row_is_ever_used(spark):
    _, _, left, right = frames(spark, 11)
    joined = pit_join(left, right, ["user_id"], ["x"], prefix="f_")
    assert joined.where("f_event_timestamp > event_timestamp").count() == 0


def test_two_keys(spark):
    left = spark.createDataFrame(
        [(1, 1, 1, START), (2, 1, 2, START)], "event_id long, a long, b long, event_timestamp timestamp_ntz"
    )
    right = spark.createDataFrame(
        [(1, 1, START - timedelta(hours=30), "old")], "a long, b long, event_timestamp timestamp_ntz, v string"
    )
    got = {r.event_id: r.v for r in pit_join(left, right, ["a", "b"], ["v"]).collect()}
    assert got == {1: "old", 2: None}


def test_plan_builds_no_pairs(spark):
    _, _, left, right = frames(spark, 5)
    plan = pit_join(left, right, ["user_id"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_training_dataset_keeps_every_row_of_the_window(spark):
    _, _, left, right = frames(spark, 6)
    spine = left.selectExpr("*", "to_date(event_timestamp) as dt", "1 as label")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "user_id long, segment string")
    views = [View(right, "user_id", ["x"], "u_")]
    start, end = date(2024, 1, 2), date(2024, 1, 3)
    rows = training_dataset(spine, views, [(dim, "user_id")], start, end)
    assert rows.count() == spine.where("dt between '2024-01-02' and '2024-01-03'").count()
    assert "segment" in rows.columns
    assert with_static(spine, dim, "user_id").count() == spine.count()


@pytest.mark.parametrize("bucket", [60, 7200, 86_400])
@pytest.mark.parametrize("seed", [7, 8])
def test_knowing_the_span_changes_nothing(spark, seed, bucket):
    _, _, left, right = frames(spark, seed)
    start, end = START + timedelta(hours=20), START + timedelta(hours=50)
    part = left.where(f"event_timestamp between '{start}' and '{end}'")
    whole = pit_join(part, right, ["user_id"], ["x"], bucket_seconds=bucket).collect()
    near = pit_join(part, right, ["user_id"], ["x"], bucket_seconds=bucket, span=span_of(part))
    assert sorted(map(repr, whole)) == sorted(map(repr, near.collect())) and len(whole) > 20
    assert span_of(left.where("false")) is None


def test_empty_window_gives_no_rows(spark):
    _, _, left, right = frames(spark, 6)
    spine = left.selectExpr("*", "to_date(event_timestamp) as dt", "1 as label")
    views = [View(right, "user_id", ["x"], "u_")]
    assert training_dataset(spine, views, [], date(2030, 1, 1), date(2030, 1, 2)).count() == 0


def test_every_view_adds_the_same_work(spark):
    day = date(2024, 1, 1)
    rows = [(i, i % 3, datetime(2024, 1, 1, i % 14), day) for i in range(40)]
    spine = spark.createDataFrame(rows, "event_id long, k long, event_timestamp timestamp_ntz, dt date")
    facts = [(i % 3, datetime(2023, 12, 31, i), float(i)) for i in range(24)]
    view = spark.createDataFrame(facts, "k long, event_timestamp timestamp_ntz, x double")

    def plan(n):
        views = [View(view, "k", ["x"], f"v{i}_") for i in range(n)]
        joined = training_dataset(spine, views, [], day, day)
        assert joined.count() == 40 and joined.where("v0_x IS NULL").count() == 0
        return joined._jdf.queryExecution().optimizedPlan().toString()

    reads = [plan(n).count("Relation") for n in (1, 2, 3)]
    windows = [plan(n).count("Window [") for n in (1, 2, 3)]
    # the stored spine once and once a view, and each stored view twice
    assert reads == [4, 7, 10] and windows == [2, 4, 6]


def test_views_are_evaluated_once(spark):
    """The registered training set reads stored tables alone and exchanges rows eleven times at most."""
    from tidelake.catalog.training import _dataset

    physical = _dataset(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") <= 11
    assert "events.parquet" not in physical and physical.count("FileScan") <= 8
