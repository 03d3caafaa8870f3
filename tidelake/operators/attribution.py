"""Click attribution: label the impressions that led to a click.

Last touch: a click belongs to the latest impression of its key at or before it,
ties going to the larger event id. Then an impression is labelled exactly when the
next row of its key, in the order (time, impression before click, id), is a click
inside the window: any impression in between would take the click over. So one
``lead`` decides it, without building click-impression pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.dates import DAY_SECONDS, time_bucket
from tidelake.functions.predicates import any_null, none_null
from tidelake.operators.asof import pit_join

CLICK_WINDOW_SECONDS = 30 * 60
# one length for every table: the rows of a key in ten minutes meet in a task
BUCKET_SECONDS = 600


def two_day_slice(log: DataFrame, day: date) -> DataFrame:
    """The target day and the next: a click may fall after local midnight."""
    return log.where(F.col("dt").isin(day, day + timedelta(days=1)))


def attribute_clicks(
    log: DataFrame,
    keys: Sequence[str] = ("user_id", "video_id"),
    window_seconds: int = CLICK_WINDOW_SECONDS,
    day: date | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Impressions with ``label`` 0/1; of one day, or of every day when none is named.

    Rows meet per key and time bucket, so a key with a third of all rows is spread
    over its buckets however wide the click window is. If the first row after a
    bucket is a click, a copy of it closes the bucket. The length never changes the
    result; shorter buckets spread a key that is busier.
    """
    if window_seconds <= 0 or (day is not None and window_seconds > DAY_SECONDS):
        raise ValueError("the window must be positive and, as D and D+1 are read, within one day")
    keys = list(keys)
    log = log.where(F.col("event_type").isin("impression", "click"))
    if day is not None:
        log = two_day_slice(log, day)
    entity = list(dict.fromkeys(["event_id", "user_id", "video_id", *keys]))
    no_key = any_null(keys)
    bucket = time_bucket(log, "event_timestamp", bucket_seconds)
    rows = (
        log.select(
            *entity,
            "event_timestamp",
            "dt",
            (F.col("event_type") == "click").alias("_click"),
            # a hash spreads the impressions without a key, which nothing can follow
            F.when(no_key, F.xxhash64("event_id")).otherwise(bucket).alias("_bucket"),
        )
        .where(~(no_key & F.col("_click")))
    )
    closing = _closing_clicks(rows.where(none_null(keys)), keys)
    order = Window.partitionBy(*keys, "_bucket").orderBy("event_timestamp", "_click", "event_id")
    following = F.lead(F.struct("_click", "event_timestamp")).over(order)
    labelled = (
        rows.unionByName(closing, allowMissingColumns=True)
        .withColumn("_next", following)
        .where(~F.col("_click"))
    )
    if day is not None:
        labelled = labelled.where(F.col("dt") == F.lit(day))
    in_window = F.col("_next.event_timestamp") <= F.col("event_timestamp") + F.make_dt_interval(
        secs=F.lit(window_seconds)
    )
    hit = F.col("_next._click") & in_window & none_null(keys)
    return labelled.select(
        *entity,
        "event_timestamp",
        "dt",
        F.when(hit, 1).otherwise(0).alias("label"),
    )


def _closing_clicks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each (key, bucket) the first row of the next bucket in use, if a click.

    Works on the earliest click and impression times of each bucket, which the map
    tasks reduce before the shuffle; a key has at most one row per bucket.
    """
    at = F.col("event_timestamp")
    firsts = rows.groupBy(*keys, "_bucket").agg(
        F.min(F.when(F.col("_click"), at)).alias("_first_click"),
        F.min(F.when(~F.col("_click"), at)).alias("_first_impression"),
    )
    later = Window.partitionBy(*keys).orderBy("_bucket")
    upcoming = firsts.select(
        *keys, "_bucket", F.lead(F.struct("_first_click", "_first_impression")).over(later).alias("_n")
    )
    click, impression = F.col("_n._first_click"), F.col("_n._first_impression")
    return upcoming.where(click.isNotNull() & (impression.isNull() | (click < impression))).select(
        *keys, "_bucket", click.alias("event_timestamp"), F.lit(True).alias("_click")
    )


def last_touch(
    log: DataFrame,
    keys: Sequence[str] = ("user_id", "video_id"),
    window_seconds: int = CLICK_WINDOW_SECONDS,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Every click with the impression it goes to, NULL if none lies in the window.

    Impressions of one key and time count as the one with the largest id, which makes
    them a view that an as-of join can look clicks up in.
    """
    keys = list(keys)
    log = log.where(F.col("event_type").isin("impression", "click"))
    shown = log.where(F.col("event_type") == "impression")
    latest = shown.groupBy(*keys, "event_timestamp").agg(F.max("event_id").alias("event_id"))
    clicks = log.where(F.col("event_type") == "click").select(
        "event_id", *[k for k in keys if k != "event_id"], "event_timestamp", "dt"
    )
    matched = pit_join(
        clicks, latest, keys, ["event_id"], prefix="impression_", bucket_seconds=bucket_seconds
    )
    since = F.col("event_timestamp") - F.make_dt_interval(secs=F.lit(window_seconds))
    in_window = F.col("impression_event_timestamp") >= since
    return matched.select(
        *clicks.columns, F.when(in_window, F.col("impression_event_id")).alias("impression_id")
    )


def label_rate(spine: DataFrame, by: str = "dt") -> DataFrame:
    """Rows, positives and label rate per day; a day without positives shows up."""
    return spine.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
        (F.count_if(F.col("label") == 1) / F.count(F.lit(1))).alias("label_rate"),
    )


class NoPositivesError(ValueError):
    """A spine without a single positive label is not worth training on."""


def require_positives(spine: DataFrame) -> DataFrame:
    """The spine itself, after checking that it has positives."""
    if not spine.where(F.col("label") == 1).limit(1).count():
        raise NoPositivesError("the spine has no positive label")
    return spine
