import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tidelake.operators.evaluation import (
    _in_ranges,
    calibrate_scores,
    downsample,
    fit_score,
    promotion_decision,
    roc_auc,
)


def pairs_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("distinct", [2, 10, 100_000])
def test_auc_agrees_with_all_pairs(spark, distinct):
    rng = random.Random(distinct)
    rows = [(rng.choice("ab"), rng.randrange(distinct) / 7, int(rng.random() < 0.2)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: r for r in roc_auc(df, "s", "y", ["g"]).collect()}
    for g in "ab":
        assert got[g].auc == pytest.approx(pairs_auc([(s, y) for k, s, y in rows if k == g]), abs=1e-12)
    whole = roc_auc(df, "s", "y").first()
    assert whole.auc == pytest.approx(pairs_auc([(s, y) for _, s, y in rows]), abs=1e-12)
    assert whole.positives + whole.negatives == 900
    ml = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y")
    if distinct <= 10:
        assert whole.auc == pytest.approx(ml.evaluate(df), abs=1e-9)


def test_every_group_is_cut_by_itself_and_cuts_change_nothing(spark):
    rng = random.Random(5)
    rows = [("low", rng.random(), int(rng.random() < 0.3)) for _ in range(400)]
    rows += [("high", 1e6 + rng.random(), int(rng.random() < 0.3)) for _ in range(400)]
    rows += [(None, 7.0, i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    want = {g: pairs_auc([(s, y) for k, s, y in rows if k == g]) for g in ("low", "high", None)}
    for ranges in (1, 16, 500):
        got = {r.g: r.auc for r in roc_auc(df, "s", "y", ["g"], ranges).collect()}
        assert got == {g: pytest.approx(v, abs=1e-12) for g, v in want.items()}
    spread = _in_ranges(df.select("g", F.col("s").alias("_score")), ["g"], 16)
    used = {r.g: r.n for r in spread.groupBy("g").agg(F.count_distinct("_range").alias("n")).collect()}
    assert used == {"low": 16, "high": 16, None: 1}


def test_auc_starts_no_job_before_it_is_asked_for(spark):
    tracker = spark.sparkContext.statusTracker()
    df = spark.range(100).select(F.col("id").alias("s"), (F.col("id") % 2).alias("y"))
    spark.sparkContext.setJobGroup("auc-plan", "")
    try:
        frames = [roc_auc(df, "s", "y"), roc_auc(df, "s", "y", ["y"])]
        assert frames and not tracker.getJobIdsForGroup("auc-plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_auc_edge_cases(spark):
    df = spark.createDataFrame(
        [("one", 1.0, 1), ("one", 2.0, 1), ("tie", 5.0, 1), ("tie", 5.0, 0), ("tie", None, 1), (None, 1.0, 0), (None, 2.0, 1)],
        "g string, s double, y int",
    )
    got = {r.g: r.auc for r in roc_auc(df, "s", "y", ["g"]).collect()}
    assert got == {"one": None, "tie": 0.5, None: 1.0}
    assert roc_auc(df.where("false"), "s", "y").first().auc is None


def test_downsampling_keeps_positives_and_repeats(spark):
    df = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    kept = downsample(df, "y", 0.25, 42)
    assert kept.where("y = 1").count() == 400
    assert kept.where("y = 0").count() == pytest.approx(19_600 * 0.25, rel=0.05)
    again = downsample(df.repartition(7), "y", 0.25, 42)
    assert kept.exceptAll(again).count() == 0 == again.exceptAll(kept).count()
    assert downsample(df, "y", 1.0, 42).count() == 20_000
    for rate in (0, 1.5):
        with pytest.raises(ValueError):
            downsample(df, "y", rate, 42)


def test_calibration_undoes_the_sampling(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    got = [r.calibrated for r in calibrate_scores(df, "p", 0.25).collect()]
    assert got == pytest.approx([0.0, 0.2, 1.0])


VERSION = "model_name string, version int, is_champion boolean, val_roc_auc double, downsampled boolean, has_calibration boolean"


def decide(spark, rows, ready=True):
    df = spark.createDataFrame([("m", *r) for r in rows], VERSION)
    row = promotion_decision(df, ready).first()
    return row.outcome, row.reason_code, row.candidate_version


CHAMPION = (3, True, 0.80, False, False)


@pytest.mark.parametrize(
    ("rows", "ready", "want"),
    [
        ([(1, False, 0.7, False, False)], True, ("promoted", "first_champion", 1)),
        ([CHAMPION, (4, False, 0.81, False, False)], True, ("promoted", "metric_not_degraded", 4)),
        ([CHAMPION, (4, False, 0.80, False, False)], True, ("promoted", "metric_not_degraded", 4)),
        ([CHAMPION, (4, False, 0.79, True, False)], True, ("rejected", "metric_below_champion", 4)),
        ([CHAMPION, (4, False, 0.9, True, False)], True, ("rejected", "calibration_artifact_missing", 4)),
        ([CHAMPION, (4, False, 0.9, True, True)], False, ("rejected", "serving_calibration_not_ready", 4)),
        ([CHAMPION, (4, False, 0.9, True, True)], True, ("promoted", "metric_not_degraded", 4)),
        ([CHAMPION, (4, False, 0.9, False, False)], False, ("promoted", "metric_not_degraded", 4)),
        ([(1, False, 0.9, True, False)], True, ("rejected", "calibration_artifact_missing", 1)),
        ([CHAMPION, (2, False, 0.99, False, False)], True, ("no_candidate", None, None)),
        ([CHAMPION, (4, False, None, False, False)], True, ("no_candidate", None, None)),
        ([CHAMPION, (4, False, 0.9, False, False), (5, False, float("nan"), False, False)], True,
         ("promoted", "metric_not_degraded", 4)),
        ([CHAMPION, (4, False, 0.9, False, False), (5, False, 0.1, False, False)], True,
         ("rejected", "metric_below_champion", 5)),
    ],
)
def test_promotion(spark, rows, ready, want):
    assert decide(spark, rows, ready) == want


def test_deciding_again_after_a_promotion_changes_nothing(spark):
    rows = [(3, False, 0.80, False, False), (4, True, 0.9, False, False)]
    assert decide(spark, rows) == ("no_candidate", None, None)


def test_trees_learn_a_plain_rule(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 6).cast("int").alias("label")
    )
    scored = fit_score(df.where("id < 400"), df.where("id >= 400"), ["x"], iterations=3)
    assert scored.count() == 200
    assert roc_auc(scored, "score", "label").first().auc == 1.0
