from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidelake.operators.candidates import (
    Mix,
    decide_click,
    permuted,
    positions,
    quota_mix,
    threshold_choice,
    threshold_sweep,
    user_keys,
)
from tidelake.catalog.ingest import ACTION_LOG
from tidelake.operators.quality import ValidationError
from tidelake.plans.exposure_log import exposure_events, publish_day
from tidelake.plans.raw_load import load_day
from tidelake.session import scratch
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import read_lake
from tidelake.sources.schemas import SchemaDriftError


@pytest.fixture
def items(spark):
    return spark.range(300).select(
        F.col("id").alias("video_id"),
        F.when(F.col("id") < 290, F.concat(F.lit("c"), F.col("id") % 5)).otherwise("rare").alias("category"),
        (F.col("id") * 7 % 301).cast("double").alias("score"),
    )


@pytest.fixture
def users(spark):
    rows = [(u, ["c0", "c1", "rare", "absent", None][u % 5]) for u in range(50)]
    return spark.createDataFrame(rows, "user_id long, category string")


def test_quotas_and_limits():
    assert Mix().quotas == (17, 5, 2)
    assert Mix(n=1).quotas == (1, 0, 0)
    assert Mix(personalized=0, popular=0.5, exploration=0.5).quotas == (0, 12, 12)
    for bad in (dict(n=0), dict(n=201), dict(popular=0.9), dict(personalized=-0.1, popular=1.0)):
        with pytest.raises(ValueError):
            Mix(**bad)


def test_every_user_gets_a_full_list_of_distinct_items(users, items):
    rows = quota_mix(users, items).collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.user_id, []).append(r)
    assert len(lists) == 50
    for user, picks in lists.items():
        assert sorted(p.slot for p in picks) == list(range(1, 25))
        assert len({p.video_id for p in picks}) == 24
        kinds = [p.strategy for p in sorted(picks, key=lambda p: p.slot)]
        mine = {0: 17, 1: 17, 2: 10}.get(user % 5, 0)
        assert kinds.count("personalized") == mine and kinds.count("popular") == 5
        assert kinds == sorted(kinds, key=["personalized", "popular", "exploration"].index)


def test_mix_is_repeatable_and_seeded(users, items):
    first = sorted(map(tuple, quota_mix(users, items).collect()))
    assert first == sorted(map(tuple, quota_mix(users.repartition(3), items.repartition(5)).collect()))
    assert first != sorted(map(tuple, quota_mix(users, items, Mix(seed=7)).collect()))


def test_small_catalog_is_shown_whole(spark, users, items):
    few = items.where("video_id < 9")
    rows = quota_mix(users, few).groupBy("user_id").agg(F.count_distinct("video_id").alias("n")).collect()
    assert {r.n for r in rows} == {9} and len(rows) == 50


def test_positions_number_the_catalog_once(items):
    for ranges in (1, 7, 4096):
        rows = positions(items, 42, ranges).collect()
        assert sorted(r.position for r in rows) == list(range(300)) == sorted(r.video_id for r in rows)


@pytest.mark.parametrize("total", [1, 2, 3, 5, 24, 25, 97, 256, 300, 1000])
def test_every_users_walk_is_a_permutation(spark, total):
    users = spark.createDataFrame([(u,) for u in range(5)], "user_id long")
    places = users.crossJoin(spark.range(total)).select(
        "user_id", "id", permuted(F.col("id"), user_keys(42), F.lit(total).cast("long")).alias("at")
    ).collect()
    orders = {u: [r.at for r in sorted(places, key=lambda r: r.id) if r.user_id == u] for u in range(5)}
    assert all(sorted(o) == list(range(total)) for o in orders.values())
    assert total < 24 or len({tuple(o) for o in orders.values()}) == 5


def test_every_item_reaches_every_part_of_the_users(spark, items):
    """Exploration alone: 2,000 users with 6 of 300 items see each about 40 times."""
    users = spark.range(2000).select(F.col("id").alias("user_id"), F.lit(None).cast("string").alias("category"))
    mix = Mix(n=6, personalized=0.0, popular=0.0, exploration=1.0)
    picks = quota_mix(users, items, mix).collect()
    assert len(picks) == 12_000 and {r.strategy for r in picks} <= {"personalized", "exploration"}
    for half in (0, 1):
        seen = Counter(r.video_id for r in picks if r.user_id % 2 == half)
        assert len(seen) == 300 and max(seen.values()) < 60
    pairs = Counter(frozenset(p) for p in _first_two(picks).values())
    assert max(pairs.values()) <= 4


def _first_two(picks):
    out = {}
    for r in picks:
        if r.slot <= 2:
            out.setdefault(r.user_id, []).append(r.video_id)
    return out


def test_nothing_runs_while_the_plan_is_made(spark, users, items):
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    quota_mix(users, items)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_an_empty_catalog_gives_no_candidates(users, items):
    assert quota_mix(users, items.where("false")).count() == 0


def test_plan_has_no_cross_join(users, items):
    text = quota_mix(users, items)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_click_needs_a_threshold(spark):
    df = spark.createDataFrame([(0.5,), (0.4,), (None,)], "score double")
    got = [r.clicked for r in decide_click(df, "score", 0.5).collect()]
    assert got == [True, False, False]
    with pytest.raises(ValueError):
        decide_click(df, "score", None)


def test_calibration_picks_the_closest_rate(spark):
    """279 of 10,000 scores reach 0.4 and 188 reach 0.5; the target of 2 % takes 0.5."""
    rows = [(0.55,)] * 188 + [(0.45,)] * 91 + [(0.1,)] * (10_000 - 279)
    sweep = threshold_sweep(spark.createDataFrame(rows, "score double"), "score", [0.4, 0.5])
    assert {r.threshold: r.ctr for r in sweep.collect()} == {0.4: 0.0279, 0.5: 0.0188}
    assert threshold_choice(sweep, 0.02).first().threshold == 0.5
    assert threshold_choice(sweep, 0.03).first().threshold == 0.4


DAY = date(2024, 1, 2)


@pytest.fixture
def log(spark):
    at = datetime(2024, 1, 2, 3)
    rows = [
        (u * 24 + v, u, v, at, DAY, 0.9 if (u + v) % 7 == 0 else 0.1)
        for u in range(5)
        for v in range(24)
    ]
    shown = "event_id long, user_id long, video_id long, event_timestamp timestamp_ntz, dt date"
    scored = spark.createDataFrame(rows, f"{shown}, score double")
    return exposure_events(scored, "score", 0.5, "m")


def publish(spark, log, rules, **more):
    ids = spark.range(24)
    return publish_day(
        log,
        rules,
        ids.withColumnRenamed("id", "video_id"),
        ids.withColumnRenamed("id", "user_id"),
        scratch(spark, "published"),
        scratch(spark, "aside"),
        DAY,
        "m",
        **more,
    )


def test_exposure_log_passes_its_own_quality_report(spark, log):
    (row,) = publish(spark, log, {"none": F.lit(False)})
    assert row["impressions"] == 120 and row["clicks"] == row["views"] > 0
    assert log.select("event_id").distinct().count() == log.count()


def test_too_many_bad_rows_stop_the_day(spark, log):
    with pytest.raises(ValidationError, match="quarantine ratio"):
        publish(spark, log, {"most": F.col("video_id") > 3})


def test_quarantined_rows_are_left_out(spark, log):
    (row,) = publish(spark, log, {"one": F.col("video_id") == 3})
    assert row["impressions"] == 115


def test_existing_day_is_not_overwritten_by_default(spark, log):
    base, ids = scratch(spark, "published"), spark.range(24)
    args = (
        {"none": F.lit(False)},
        ids.withColumnRenamed("id", "video_id"),
        ids.withColumnRenamed("id", "user_id"),
        base,
        scratch(spark, "aside"),
        DAY,
        "m",
    )
    publish_day(log, *args)
    with pytest.raises(FileExistsError):
        publish_day(log, *args)
    publish_day(log, *args, overwrite=True)


def test_a_failed_day_changes_nothing_and_a_clean_one_empties_the_quarantine(spark, log):
    base, aside, ids = scratch(spark, "published"), scratch(spark, "aside"), spark.range(24)
    dims = (ids.withColumnRenamed("id", "video_id"), ids.withColumnRenamed("id", "user_id"))
    where = (base, aside, DAY, "m")
    publish_day(log, {"one": F.col("video_id") == 3}, *dims, *where)
    assert spark.read.json(aside).count() == 5 + log.where("video_id = 3 and event_type <> 'impression'").count()
    worse = log.withColumn("llm_model", F.lit("other"))
    with pytest.raises(ValidationError, match="unexpected model"):
        publish_day(worse, {"none": F.lit(False)}, *dims, *where, overwrite=True)
    assert read_lake(spark, base).where("video_id = 3 or llm_model <> 'm'").count() == 0
    assert SharedFs(spark, aside).exists(f"{aside}/dt={DAY}")
    publish_day(log, {"none": F.lit(False)}, *dims, *where, overwrite=True)
    assert read_lake(spark, base).count() == log.count()
    assert not SharedFs(spark, aside).exists(f"{aside}/dt={DAY}")
    load_day(spark, base, scratch(spark, "loaded"), DAY, ACTION_LOG)
    with pytest.raises(SchemaDriftError):
        publish_day(log.drop("value"), {"none": F.lit(False)}, *dims, *where, overwrite=True)
