"""Daily feature tables and trailing activity."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.dates import kst_midnight

# The event kinds of the log.
EVENT_TYPES = ("impression", "click", "view", "like")


def visible_from(day):
    """A day's snapshot is usable from the start of the next local day, never inside it."""
    return kst_midnight(F.date_add(day, 1))


def user_dynamic(log: DataFrame, videos: DataFrame, day: date | None = None) -> DataFrame:
    """Activity per user and day, for one target day or for every day of the log.

    Counts roll up in three steps, (user, day, video) then category then user, each
    with a partial aggregate. The distinct videos fall out of the first step.
    """
    rows = log.where(F.col("event_type").isin(*EVENT_TYPES))
    if day is not None:
        rows = rows.where(F.col("dt") == F.lit(day))
    names = {"impression": "impressions", "click": "clicks", "view": "views", "like": "likes"}
    per_video = rows.groupBy("user_id", "dt", "video_id").agg(
        *[F.count_if(F.col("event_type") == t).alias(n) for t, n in names.items()],
        F.count(F.lit(1)).alias("events"),
        F.max("event_timestamp").alias("last_event"),
    )
    per_category = (
        per_video.join(videos.select("video_id", "category"), "video_id", "left")
        .groupBy("user_id", "dt", "category")
        .agg(
            *[F.sum(n).alias(n) for n in names.values()],
            F.sum("events").alias("events"),
            F.count("video_id").alias("distinct_videos"),
            F.max("last_event").alias("last_event"),
        )
    )
    ranked = F.when(F.col("category").isNotNull(), F.struct("events", "category"))
    return (
        per_category.groupBy("user_id", "dt")
        .agg(
            *[F.sum(n).alias(n) for n in names.values()],
            F.sum("distinct_videos").alias("distinct_videos"),
            F.max_by("category", ranked).alias("top_category"),
            F.max("last_event").alias("last_event"),
        )
        .select(
            "user_id",
            visible_from(F.col("dt")).alias("event_timestamp"),
            *names.values(),
            F.try_divide("clicks", "impressions").alias("ctr"),
            "distinct_videos",
            "top_category",
            "last_event",
            "dt",
        )
    )


def video_feature(trending: DataFrame, day: date | None = None) -> DataFrame:
    """One row per video and day of the snapshot.

    Prices are ranked within a day; the collector bounds a day's snapshot.
    """
    rows = trending if day is None else trending.where(F.col("dt") == F.lit(day))
    by_price = Window.partitionBy("dt").orderBy(F.desc_nulls_last("price"), "video_id")
    place = F.row_number().over(by_price)
    return rows.select(
        "video_id",
        visible_from(F.col("dt")).alias("event_timestamp"),
        "category",
        "size",
        F.col("rank").alias("trend_rank"),
        place.alias("price_rank"),
        "dt",
    )


def trailing(
    daily: DataFrame, key: str, sums: Sequence[str], days: int = 7, day: str = "dt"
) -> DataFrame:
    """Sums over the last ``days`` calendar days, the row's own day included.

    The input has one row per key and day, so a group is as long as the calendar.
    """
    span = (
        Window.partitionBy(key).orderBy("_day_no").rangeBetween(-(days - 1), Window.currentRow)
    )
    numbered = daily.withColumn("_day_no", F.unix_date(day))
    return numbered.select(
        key,
        day,
        *[F.sum(c).over(span).alias(f"{c}_{days}d") for c in sums],
        F.count(F.lit(1)).over(span).alias(f"active_days_{days}d"),
    )


def trailing_distinct(
    log: DataFrame, key: str, item: str, days: int = 7, day: str = "dt", name: str | None = None
) -> DataFrame:
    """Different items of the last ``days`` calendar days, on every day a key has rows.

    Distinct counts of single days do not add up, but this does: an item counts from each of
    its days until the window has left it or its next day takes over, so per key and item
    these spans never overlap. A day's count is the spans begun less the spans ended by
    then. What is shuffled is one row per key, item and day, then one per key and day, and
    both are reduced in the map tasks; no set of items is ever held. NULL items count nothing.
    """
    name = name or f"distinct_{item}_{days}d"
    own = Window.partitionBy(key, item).orderBy("_no")
    seen = log.where(F.col(item).isNotNull()).select(key, item, F.unix_date(day).alias("_no")).distinct()
    ends = F.least(F.col("_no") + days, F.lead("_no").over(own))  # a NULL is passed over
    spans = seen.select(key, "_no", ends.alias("_end"))
    steps = spans.select(
        key,
        F.explode(
            F.array(
                F.struct(F.col("_no").alias("_at"), F.lit(1).alias("_step")),
                F.struct(F.col("_end").alias("_at"), F.lit(-1).alias("_step")),
            )
        ).alias("_s"),
    ).select(key, "_s._at", "_s._step", F.lit(False).alias("_shown"))
    rows = log.select(key, F.unix_date(day).alias("_at"), F.lit(0).alias("_step"), F.lit(True).alias("_shown"))
    daily = steps.unionByName(rows).groupBy(key, "_at").agg(
        F.sum("_step").alias("_step"), F.max("_shown").alias("_shown")
    )
    running = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        daily.withColumn(name, F.sum("_step").over(running))
        .where("_shown")
        .select(key, F.date_from_unix_date("_at").alias(day), name)
    )


def daily_activity(log: DataFrame, key: str = "user_id") -> DataFrame:
    """Impressions and clicks per key and day, the input of :func:`trailing`."""
    return log.groupBy(key, "dt").agg(
        F.count_if(F.col("event_type") == "impression").alias("impressions"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
    )
