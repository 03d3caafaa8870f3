"""Daily log from scored exposures: decide clicks, set bad rows aside, check, publish."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators.candidates import decide_click
from tidelake.operators.quality import (
    MAX_QUARANTINE_RATIO,
    ValidationError,
    action_log_quality,
    enforce,
    quarantine_ratio,
)
from tidelake.session import cut, scratch
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import read_partition
from tidelake.sources.schemas import ACTION_LOG
from tidelake.sources.sink import (
    replace_partition,
    split_tagged,
    tag_quarantine,
    write_quarantine,
)

STEPS = ("impression", "click", "view")


def exposure_events(
    exposures: DataFrame, score: str, threshold: float | None, model: str
) -> DataFrame:
    """Log rows of scored exposures: the impression, and a click and a view if it is clicked.

    An exposure is an impression row with its own id, time and day. Its rows are numbered
    from three times its id and follow each other by a second, so a repeated run gives
    the same rows.
    """
    kinds = F.array(*[F.lit(kind) for kind in STEPS])
    shown = F.when(F.col("clicked"), kinds).otherwise(F.slice(kinds, 1, 1))
    step = F.col("_step")
    return (
        decide_click(exposures, score, threshold)
        .withColumn("_score", F.col(score).cast("double"))
        .select("*", F.posexplode(shown).alias("_step", "_kind"))
        .select(
            (F.col("event_id") * len(STEPS) + step).alias("event_id"),
            "user_id",
            "video_id",
            (F.col("event_timestamp") + F.make_dt_interval(secs=step)).alias("event_timestamp"),
            F.col("_kind").alias("event_type"),
            F.lit(model).alias("llm_model"),
            F.col("_score").alias("value"),
            "dt",
        )
    )


def publish_day(
    log: DataFrame,
    rules: Mapping[str, Column],
    videos: DataFrame,
    users: DataFrame,
    base: str,
    quarantine: str,
    day: date,
    model: str,
    overwrite: bool = False,
    limit: float = MAX_QUARANTINE_RATIO,
) -> list[dict]:
    """Publish a day if not too much of it is bad and its quality report is clean.

    The report is made of a staged copy. A day that fails leaves the published one and its
    quarantine as they were; a day that passes replaces both.
    """
    spark = log.sparkSession
    tagged = cut(tag_quarantine(log, rules))
    over = quarantine_ratio(tagged, limit).where(~F.col("within_limit")).collect()
    if over:
        shares = ", ".join(f"dt={r.dt} {r.bad_ratio:.3f}" for r in over)
        raise ValidationError(f"quarantine ratio above {limit}: {shares}")
    good, bad = split_tagged(tagged)
    staging = scratch(spark, "staged-log")
    try:
        replace_partition(good, staging, day, schema=ACTION_LOG, rebalance=True)
        staged = read_partition(spark, staging, day, schema=ACTION_LOG)
        report = enforce(action_log_quality(staged, videos, users, model, day))
        replace_partition(staged, base, day, schema=ACTION_LOG, overwrite=overwrite)
    finally:
        SharedFs(spark, staging).delete(staging)
    write_quarantine(bad, quarantine, day)
    return report
