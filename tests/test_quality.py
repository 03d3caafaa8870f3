from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.operators import quality as q

DAY = date(2024, 1, 2)
REQUIRED = ("event_id", "user_id")


@pytest.fixture
def clean(make_log):
    return make_log([(n, n, n, f"2024-01-02 0{n}:00:00", "click") for n in range(6)])


def test_clean_day_passes(clean):
    rows = q.enforce(q.validate_raw(clean, clean, REQUIRED, "event_id", DAY))
    assert len(rows) == 1 and rows[0]["row_count"] == 6


FAULTS = {
    "partition is empty": lambda df: df.where("false"),
    "row count mismatch loaded=5 source=6": lambda df: df.where("event_id < 5"),
    "1 rows with NULL required columns": lambda df: df.withColumn(
        "user_id", F.when(F.col("event_id") != 3, F.col("user_id"))
    ),
    "1 duplicate event_id rows": lambda df: df.withColumn(
        "event_id", F.when(F.col("event_id") == 5, 4).otherwise(F.col("event_id")).cast("long")
    ),
}


@pytest.mark.parametrize("message", FAULTS)
def test_each_fault_fails_its_check(clean, message):
    metrics = q.validate_raw(FAULTS[message](clean), clean, REQUIRED, "event_id", DAY)
    with pytest.raises(q.ValidationError, match=message):
        q.enforce(metrics)


def test_all_violations_are_listed_together(clean):
    bad = clean.unionByName(clean).withColumn("user_id", F.lit(None).cast("long"))
    with pytest.raises(q.ValidationError) as error:
        q.enforce(q.validate_raw(bad, clean, REQUIRED, "event_id", DAY))
    for part in ("mismatch", "12 rows with NULL", "6 duplicate"):
        assert part in str(error.value)


def test_named_days_agree_with_all_days_at_once(spark, clean, make_log):
    other = make_log([(n, n, n, "2024-01-05 01:00:00", "view") for n in (7, 7, 8)])
    loaded, source = clean.unionByName(other), clean
    every = {r.dt: r for r in q.validate_raw(loaded, source, REQUIRED, "event_id").collect()}
    for day in (DAY, date(2024, 1, 5)):
        one = q.validate_raw(loaded, source, REQUIRED, "event_id", day).first()
        assert one.asDict() == every[day].asDict()
    assert every[date(2024, 1, 5)].duplicate_key_count == 1


def test_null_keys_are_no_duplicates(clean):
    blank = clean.withColumn("event_id", F.lit(None).cast("long"))
    row = q.validate_raw(blank, blank, REQUIRED, "event_id", DAY).first()
    assert (row.duplicate_key_count, row.null_key_count) == (0, 6)


def test_global_duplicates_cross_days(clean):
    twice = clean.unionByName(clean.withColumn("dt", F.date_add("dt", 1)))
    assert {r.duplicate_key_count for r in q.duplicate_keys(twice, "event_id").collect()} == {0}
    assert q.dup_keys_global(twice, "event_id").count() == 6


def test_feature_checks(clean):
    features = clean.select("user_id", "event_timestamp", "dt")
    q.enforce(q.validate_feature(features, ["user_id"], day=DAY))
    for broken, message in (
        (features.unionByName(features.limit(1)), "1 duplicate key rows"),
        (features.withColumn("user_id", F.lit(None).cast("long")), "6 rows with NULL key"),
        (features.where("false"), "partition is empty"),
    ):
        with pytest.raises(q.ValidationError, match=message):
            q.enforce(q.validate_feature(broken, ["user_id"], day=DAY))


@pytest.fixture
def smoke(make_log):
    """120 impressions, 2 clicks, 2 views and 2 likes."""
    kinds = ["impression"] * 120 + ["click"] * 2 + ["view"] * 2 + ["like"] * 2
    return make_log([(n, n % 5, n % 30, "2024-01-02 01:00:00", k) for n, k in enumerate(kinds)])


def report(log, spark, model="m", users=5, videos=30):
    return q.action_log_quality(
        log,
        spark.range(videos).withColumnRenamed("id", "video_id"),
        spark.range(users).withColumnRenamed("id", "user_id"),
        model,
        DAY,
    )


def test_complete_log_has_no_errors(spark, smoke):
    row = report(smoke, spark).first()
    assert row.errors == [] and row.row_count == 126
    assert row.ctr == pytest.approx(1 / 60)
    assert q.enforce(report(smoke, spark))


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda d: d.where("event_type <> 'click'"), "no click event"),
        (lambda d: d.where("event_id <> 122"), "click and view counts differ"),
        (lambda d: d.withColumn("llm_model", F.lit(None).cast("string")), "unexpected model"),
        (lambda d: d.withColumn("video_id", F.col("video_id") + 1), "video outside the snapshot"),
        (lambda d: d.withColumn("user_id", F.lit(None).cast("long")), "user outside the sample"),
        (
            lambda d: d.withColumn(
                "event_timestamp", F.col("event_timestamp") + F.expr("interval 1 day")
            ),
            "event time outside the partition",
        ),
        (lambda d: d.where("false"), "partition is empty"),
    ],
)
def test_each_defect_is_reported(spark, smoke, change, error):
    assert error in report(change(smoke), spark).first().errors
    with pytest.raises(q.ValidationError, match=error):
        q.enforce(report(change(smoke), spark))


def test_ctr_without_impressions_is_null(make_log):
    row = q.ctr(make_log([(1, 1, 1, "2024-01-02 01:00:00", "click")])).first()
    assert (row.clicks, row.impressions, row.ctr) == (1, 0, None)


def test_quarantine_gate_is_inclusive(spark):
    rows = [(DAY, ["x"]), (DAY, []), (DAY + timedelta(days=1), ["x"])]
    tagged = spark.createDataFrame(rows, "dt date, reasons array<string>")
    got = {r.dt: (r.bad_ratio, r.within_limit) for r in q.quarantine_ratio(tagged, 0.5).collect()}
    assert got == {DAY: (0.5, True), DAY + timedelta(days=1): (1.0, False)}


def test_orphans_leave_null_keys_out(spark):
    fact = spark.createDataFrame([(DAY, 1), (DAY, 9), (DAY, 9), (DAY, None)], "dt date, k long")
    dim = spark.createDataFrame([(1,)], "k long")
    assert [tuple(r) for r in q.orphans(fact, dim, "k").collect()] == [(DAY, 9, 2)]


def test_a_bitmap_of_known_keys_leaves_only_suspects(spark):
    known = [-70_000, -32_769, -32_768, -32_767, -1, 0, 1, 5, 32_767, 32_768, 32_769, 40_000, 10**12]
    asked = sorted({k + d for k in known for d in (-1, 0, 1)})
    fact = spark.createDataFrame([(DAY, k) for k in asked for _ in range(3)], "dt date, k long")
    dim = spark.createDataFrame([(k,) for k in known] + [(None,), (5,)], "k long")
    want = sorted((DAY, k, 3) for k in asked if k not in known)
    assert sorted(tuple(r) for r in q.suspects(fact, dim, "k").groupBy("dt", "k").count().collect()) == want
    assert sorted(tuple(r) for r in q.orphans(fact, dim, "k").collect()) == want
    # with a bitmap of one block alone the others stay suspects, and the answer the same
    few = q.suspects(fact, dim, "k", blocks=1).groupBy("dt", "k").count()
    assert len(want) < few.count() < len(asked)
    ints = dim.where("k between -70000 and 40000").select(F.col("k").try_cast("int").alias("k"))
    assert {r.k for r in q.orphans(fact.where("k < 100000"), ints, "k").collect()} == {k for _, k, _ in want if k < 100_000}
    names = fact.select("dt", F.concat(F.lit("n"), "k").alias("k"))
    people = dim.select(F.concat(F.lit("n"), "k").alias("k"))
    assert sorted(r.k for r in q.orphans(names, people, "k").collect()) == sorted(f"n{k}" for _, k, _ in want)
    assert q.orphans(fact, dim.limit(0), "k").count() == len(asked)


def test_the_screen_stands_before_the_shuffle(spark):
    fact = spark.range(1000).selectExpr("date_add(date'2024-01-01', int(id % 2)) as dt", "id as k")
    plan = q.orphans(fact, spark.range(990).selectExpr("id as k"), "k")._jdf.queryExecution().executedPlan().toString()
    # top down: what map tasks send is counted above the screen
    assert plan.index("partial_count") < plan.index("LeftOuter")
    assert "Cartesian" not in plan and "NestedLoop" not in plan
