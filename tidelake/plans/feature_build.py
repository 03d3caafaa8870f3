"""Daily feature tables: snapshots of day D, and the labelled spine of day D-1.

The spine trails by a day because a click on the evening of D-1 may be filed under D.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from tidelake.operators.attribution import CLICK_WINDOW_SECONDS, attribute_clicks
from tidelake.operators.features import user_dynamic, video_feature
from tidelake.operators.quality import enforce, validate_feature
from tidelake.session import scratch
from tidelake.sources import schemas
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import read_partition
from tidelake.sources.sink import assert_layers_apart, replace_date


def publish_features(df: DataFrame, base: str, day: date, schema, keys: Sequence[str]) -> list[dict]:
    """Replace a day of a feature table if its staged copy passes the checks; a day that
    fails leaves the old one."""
    spark = df.sparkSession
    staging = scratch(spark, "staged-feature")
    try:
        replace_date(df, staging, day, schema=schema)
        staged = read_partition(spark, staging, day, schema=schema)
        metrics = enforce(validate_feature(staged, keys, day=day))
        replace_date(staged, base, day, schema=schema)
    finally:
        SharedFs(spark, staging).delete(staging)
    return metrics


def build_snapshots(
    log: DataFrame, trending: DataFrame, raw: str, features: str, day: date
) -> None:
    """Replace day ``day`` of the user and video tables, in this order; the first
    failing check stops the rest."""
    assert_layers_apart(raw, features)
    publish_features(
        user_dynamic(log, trending.where(trending.dt == day), day),
        f"{features}/user_dynamic_feature",
        day,
        schemas.USER_DYNAMIC_FEATURE,
        ["user_id"],
    )
    publish_features(
        video_feature(trending, day),
        f"{features}/video_feature",
        day,
        schemas.VIDEO_FEATURE,
        ["video_id"],
    )


def build_entity(
    log: DataFrame,
    raw: str,
    features: str,
    snapshot_day: date,
    keys: Sequence[str] = ("user_id", "video_id"),
    window_seconds: int = CLICK_WINDOW_SECONDS,
) -> None:
    """Replace the spine of the day before ``snapshot_day``."""
    assert_layers_apart(raw, features)
    day = snapshot_day - timedelta(days=1)
    spine = attribute_clicks(log, keys, window_seconds, day)
    publish_features(
        spine.select(*schemas.TRAINING_ENTITY.names, "dt"),
        f"{features}/training_entity",
        day,
        schemas.TRAINING_ENTITY,
        ["event_id"],
    )


def read_feature(spark: SparkSession, features: str, table: str, day: date) -> DataFrame:
    return read_partition(spark, f"{features}/{table}", day)
