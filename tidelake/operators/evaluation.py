"""Training-set sampling, score calibration, ROC-AUC and the promotion decision."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.predicates import HASH_SPAN, md5_number

# The promotion metric.
METRIC = "val_roc_auc"


def _check_rate(rate: float) -> None:
    if not 0 < rate <= 1:
        raise ValueError(f"the sampling rate must lie in (0, 1]: {rate}")


def downsample(df: DataFrame, label: str, rate: float, seed: int, key: str = "event_id") -> DataFrame:
    """All positives and a repeatable share of the negatives, chosen by key hash."""
    _check_rate(rate)
    kept = md5_number(F.col(key), seed) < F.lit(int(rate * HASH_SPAN))
    return df.where((F.col(label) == 1) | kept)


def calibrated(p: Column, rate: float) -> Column:
    """Undo the effect of keeping only ``rate`` of the negatives on a probability."""
    _check_rate(rate)
    return p / (p + (F.lit(1.0) - p) / F.lit(rate))


def calibrate_scores(df: DataFrame, p: str, rate: float) -> DataFrame:
    return df.withColumn("calibrated", calibrated(F.col(p), rate))


def roc_auc(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Exact ROC-AUC per group; equal scores count half.

    Rows shrink to counts per distinct score. The scores of each group are then cut at
    approximate percentiles into ``ranges``, by default one for each shuffle partition of
    the session: the cut points only spread the work, the sum over ranges is exact whatever
    they are. Each range starts from a seed row with the negatives below it, so no task
    ranks a whole group. Groups of one class get a NULL.
    """
    by = list(by)
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    scores = rows.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) == 0).alias("_neg"),
    )
    counted = in_ranges(scores, by, max(ranges, 2))
    # one row per group and range
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        counted.groupBy(*by, "_range")
        .agg(F.sum("_neg").alias("_neg"))
        .select(
            *by,
            "_range",
            F.lit(None).cast("double").alias("_score"),
            F.lit(0).cast("long").alias("_pos"),
            F.coalesce(F.sum("_neg").over(below), F.lit(0)).alias("_neg"),
            F.lit(True).alias("_seed"),
        )
    )
    merged = counted.withColumn("_seed", F.lit(False)).unionByName(seeds)
    walk = (
        Window.partitionBy(*by, "_range")
        .orderBy(F.asc_nulls_first("_score"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    smaller = F.coalesce(F.sum("_neg").over(walk), F.lit(0))
    doubled = F.col("_pos").cast("decimal(18,0)") * (2 * smaller + F.col("_neg")).cast("decimal(19,0)")
    scored = merged.withColumn("_area", doubled).where(~F.col("_seed"))
    positives, negatives = F.sum("_pos"), F.sum("_neg")
    return scored.groupBy(*by).agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.try_divide(
            F.sum("_area").cast("double"),
            positives.cast("double") * negatives.cast("double") * 2,
        ).alias("auc"),
    )


def in_ranges(scores: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """Add ``_range``, the number of cut points of the row's group below its score.

    A group has one row of cuts. Without groups the cuts are a scalar subquery, else they
    join with no hint: small ones are broadcast by their measured size, and a hot group's
    scores are split at run time.
    """
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = F.percentile_approx("_score", steps, F.lit(max(1_000, 8 * ranges))).alias("_cuts")
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col("_score")))
    if not by:
        cut_scores = scores.withColumn("_cuts", scores.select(cuts).scalar())
    else:
        names = [f"_group_{i}" for i in range(len(by))]
        groups = scores.groupBy(*by).agg(cuts).toDF(*names, "_cuts")
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]
        cut_scores = scores.join(groups, reduce(and_, same)).drop(*names)
    return cut_scores.withColumn("_range", below).drop("_cuts")


_in_ranges = in_ranges


def latest_candidate(versions: DataFrame) -> DataFrame:
    """Per model its ``champion`` and its ``candidate`` row, either of them NULL.

    The candidate is the newest version above the champion that has a finite metric.
    Both are partial aggregates: a model with very many versions sends one row per
    task.
    """
    metric = F.col(METRIC)
    finite = metric.isNotNull() & ~F.isnan(metric) & (F.abs(metric) != F.lit(float("inf")))
    fields = F.struct(*[c for c in versions.columns if c != "model_name"])
    is_champion = F.coalesce(F.col("is_champion"), F.lit(False))
    grouped = versions.groupBy("model_name").agg(
        F.max_by(fields, F.when(is_champion, F.col("version"))).alias("champion"),
        F.max_by(fields, F.when(~is_champion & finite, F.col("version"))).alias("_newest"),
    )
    is_newer = F.col("champion").isNull() | (F.col("_newest.version") > F.col("champion.version"))
    return grouped.select("model_name", "champion", F.when(is_newer, F.col("_newest")).alias("candidate"))


def promotion_decision(versions: DataFrame, serving_ready: Column | bool = True) -> DataFrame:
    """One decision per model from its registered versions.

    Without a candidate the outcome is ``no_candidate``, so deciding again after a
    promotion changes nothing.
    """
    ready = F.lit(serving_ready) if isinstance(serving_ready, bool) else serving_ready
    decided = latest_candidate(versions.withColumn("serving_ready", ready))
    old, new = F.col("champion"), F.col("candidate")
    sampled = F.coalesce(new["downsampled"], F.lit(False))
    reason = (
        F.when(new.isNull(), F.lit(None).cast("string"))
        .when(new[METRIC] < old[METRIC], F.lit("metric_below_champion"))
        .when(
            sampled & ~F.coalesce(new["has_calibration"], F.lit(False)),
            F.lit("calibration_artifact_missing"),
        )
        .when(
            sampled & ~F.coalesce(new["serving_ready"], F.lit(False)),
            F.lit("serving_calibration_not_ready"),
        )
        .when(old.isNull(), F.lit("first_champion"))
        .otherwise(F.lit("metric_not_degraded"))
    )
    promoted = F.col("reason_code").isin("first_champion", "metric_not_degraded")
    return decided.withColumn("reason_code", reason).select(
        "model_name",
        F.when(F.col("reason_code").isNull(), F.lit("no_candidate"))
        .when(promoted, F.lit("promoted"))
        .otherwise(F.lit("rejected"))
        .alias("outcome"),
        "reason_code",
        F.lit(METRIC).alias("metric_name"),
        new["version"].alias("candidate_version"),
        new[METRIC].alias("candidate_metric"),
        old["version"].alias("champion_version"),
        old[METRIC].alias("champion_metric"),
    )


def fit_score(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = "label",
    iterations: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Fit gradient-boosted trees and add ``score`` to the test rows.

    A feature that was never seen for an entity is -1, apart from every real value.
    """

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features}
        )

    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol=label, maxIter=iterations, maxDepth=4, seed=seed
    )
    model = Pipeline(stages=[assembler, trees]).fit(filled(train))
    scored = model.transform(filled(test))
    return scored.select(*test.columns, vector_to_array("probability")[1].alias("score"))
