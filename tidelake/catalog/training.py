"""Queries on attribution, point-in-time joins and the training set."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.registry import query, with_ctes
from tidelake.operators.asof import pit_join
from tidelake.operators.attribution import attribute_clicks, last_touch, require_positives
from tidelake.operators.evaluation import fit_score, roc_auc
from tidelake.plans.training import View, training_dataset
from tidelake.session import cut, stored

_SPINE = ["event_id", "user_id", "video_id", "event_timestamp", "dt", "label"]
USER_COLUMNS = ["impressions", "clicks", "ctr", "distinct_videos", "top_category"]
VIDEO_COLUMNS = ["category", "size", "trend_rank", "price_rank"]


@query("click_attribution", with_ctes("SELECT * FROM spine", s.LOG, s.spine_sql(1800)))
def click_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return attribute_clicks(s.action_log(spark, sf), ["user_id"]).select(*_SPINE)


@query("click_attribution_wide", with_ctes("SELECT * FROM spine", s.LOG, s.spine_sql()))
def click_attribution_wide(spark: SparkSession, sf: str) -> DataFrame:
    return s.spine(spark, sf).select(*_SPINE)


@query(
    "click_attribution_item",
    with_ctes("SELECT * FROM spine", s.LOG, s.spine_sql(86_400, ("user_id", "video_id"))),
)
def click_attribution_item(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed by user and video, with the widest window the two-day slice allows."""
    return attribute_clicks(s.action_log(spark, sf), window_seconds=86_400).select(*_SPINE)


@query(
    "click_last_touch",
    with_ctes(
        f"""SELECT c.event_id, c.user_id, c.event_timestamp, c.dt, h.impression_id
        FROM log c LEFT JOIN (
          SELECT c.event_id, i.event_id AS impression_id FROM log c JOIN log i
            ON i.user_id = c.user_id AND i.event_timestamp <= c.event_timestamp
            AND c.event_timestamp <= i.event_timestamp + INTERVAL {s.WIDE_SECONDS} SECOND
          WHERE c.event_type = 'click' AND i.event_type = 'impression'
          QUALIFY row_number() OVER (PARTITION BY c.event_id
            ORDER BY i.event_timestamp DESC, i.event_id DESC) = 1) h USING (event_id)
        WHERE c.event_type = 'click'""",
        s.LOG,
    ),
)
def click_last_touch(spark: SparkSession, sf: str) -> DataFrame:
    return last_touch(s.action_log(spark, sf), ["user_id"], s.WIDE_SECONDS)


@query(
    "pit_user_features",
    with_ctes(
        """SELECT p.event_id, p.user_id, p.event_timestamp, p.label,
          f.event_timestamp AS user_event_timestamp, f.impressions AS user_impressions,
          f.clicks AS user_clicks, round(f.ctr, 9) AS user_ctr,
          f.distinct_videos AS user_distinct_videos, f.top_category AS user_top_category
        FROM spine p ASOF LEFT JOIN
          (SELECT * FROM user_features LEFT JOIN top_categories USING (user_id, dt)) f
          ON p.user_id = f.user_id AND p.event_timestamp >= f.event_timestamp""",
        s.LOG,
        s.VIDEOS,
        s.spine_sql(),
        s.USER_FEATURES,
    ),
)
def pit_user_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.spine(spark, sf).select("event_id", "user_id", "event_timestamp", "label")
    view = stored(s.user_features(spark, sf).select("user_id", "event_timestamp", *USER_COLUMNS), "view")
    joined = pit_join(rows, view, ["user_id"], USER_COLUMNS, prefix="user_")
    return joined.withColumn("user_ctr", F.round("user_ctr", 9))


@query(
    "pit_video_features",
    with_ctes(
        """SELECT p.event_id, p.video_id, p.event_timestamp, p.label,
          f.event_timestamp AS video_event_timestamp, f.category AS video_category,
          f.size AS video_size, f.trend_rank AS video_trend_rank,
          f.price_rank AS video_price_rank
        FROM spine p ASOF LEFT JOIN video_features f
          ON p.video_id = f.video_id AND p.event_timestamp >= f.event_timestamp""",
        s.LOG,
        s.VIDEOS,
        s.TRENDING,
        s.spine_sql(),
        s.VIDEO_FEATURES,
    ),
)
def pit_video_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.spine(spark, sf).select("event_id", "video_id", "event_timestamp", "label")
    view = stored(s.video_features(spark, sf).select("video_id", "event_timestamp", *VIDEO_COLUMNS), "view")
    return pit_join(rows, view, ["video_id"], VIDEO_COLUMNS, prefix="video_")


def _dataset(spark: SparkSession, sf: str) -> DataFrame:
    return training_dataset(
        s.spine(spark, sf),
        [
            View(s.user_features(spark, sf), "user_id", USER_COLUMNS, "user_"),
            View(s.video_features(spark, sf), "video_id", VIDEO_COLUMNS, "video_"),
        ],
        [(s.users(spark, sf), "user_id")],
        *s.WINDOW,
    )


@query(
    "training_dataset",
    with_ctes(
        f"""SELECT p.event_id, p.user_id, p.video_id, p.event_timestamp, p.dt, p.label,
          u.event_timestamp AS user_event_timestamp, u.impressions AS user_impressions,
          u.clicks AS user_clicks, round(u.ctr, 9) AS user_ctr,
          u.distinct_videos AS user_distinct_videos, u.top_category AS user_top_category,
          v.event_timestamp AS video_event_timestamp, v.category AS video_category,
          v.size AS video_size, v.trend_rank AS video_trend_rank,
          v.price_rank AS video_price_rank, c_mktsegment AS segment, c_acctbal AS balance
        FROM (SELECT * FROM spine
              WHERE dt BETWEEN DATE '{s.WINDOW[0]}' AND DATE '{s.WINDOW[1]}') p
        ASOF LEFT JOIN
          (SELECT * FROM user_features LEFT JOIN top_categories USING (user_id, dt)) u
          ON p.user_id = u.user_id AND p.event_timestamp >= u.event_timestamp
        ASOF LEFT JOIN video_features v
          ON p.video_id = v.video_id AND p.event_timestamp >= v.event_timestamp
        LEFT JOIN customer ON p.user_id = c_custkey""",
        s.LOG,
        s.VIDEOS,
        s.TRENDING,
        s.spine_sql(),
        s.USER_FEATURES,
        s.VIDEO_FEATURES,
    ),
)
def training_set(spark: SparkSession, sf: str) -> DataFrame:
    return _dataset(spark, sf).withColumn("user_ctr", F.round("user_ctr", 9))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Trees fitted on all but the last day of the window score that day."""
    rows = cut(_dataset(spark, sf))
    last = s.WINDOW[1] - timedelta(days=1)
    numeric = [
        "user_impressions",
        "user_clicks",
        "user_ctr",
        "user_distinct_videos",
        "video_size",
        "video_trend_rank",
        "video_price_rank",
        "balance",
    ]
    train = require_positives(rows.where(F.col("dt") <= F.lit(last)))
    test = rows.where(F.col("dt") > F.lit(last))
    return fit_score(train, test, numeric, iterations=5)


@query("train_score")
def train_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("event_id", "label", F.round("score", 6).alias("score"))


@query(
    "train_score_rows",
    with_ctes(
        f"""SELECT event_id, dt, label, TRUE AS has_score FROM spine
        WHERE dt = DATE '{s.WINDOW[1]}'""",
        s.LOG,
        s.spine_sql(),
    ),
)
def train_score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows the model scores, and that every score is a probability."""
    scored = F.coalesce(F.col("score").between(0, 1), F.lit(False))
    return _scored(spark, sf).select("event_id", "dt", "label", scored.alias("has_score"))


@query(
    "train_score_separable",
    with_ctes(
        f"""SELECT dt % 2 AS fold, count(*) FILTER (label = 1) AS positives,
          count(*) FILTER (label = 0) AS negatives, 1.0::DOUBLE AS auc FROM (
            SELECT day(dt) AS dt, CAST(floor(value / 20) >= 6 AND event_type <> 'error' AS INTEGER) AS label FROM log
            WHERE dt > DATE '{s.DAY}')
        GROUP BY fold""",
        s.LOG,
    ),
)
def train_score_separable(spark: SparkSession, sf: str) -> DataFrame:
    """What the scores say, on a label that two columns decide: fitted on the days up to one,
    the model must rank every later positive above every later negative."""
    steps = F.least(F.floor(F.col("value") / 20), F.lit(20))  # fewer values than the trees have bins
    log = s.action_log(spark, sf).select(
        "dt",
        steps.alias("amount"),
        (F.col("event_type") != "error").cast("int").alias("known"),
        (F.col("event_id") % 17).alias("noise"),
        ((steps >= 6) & (F.col("event_type") != "error")).cast("int").alias("label"),
    )
    train, test = log.where(F.col("dt") <= F.lit(s.DAY)), log.where(F.col("dt") > F.lit(s.DAY))
    scored = fit_score(train, test, ["amount", "known", "noise"], iterations=5)
    return roc_auc(scored.withColumn("fold", (F.dayofmonth("dt") % 2).cast("long")), "score", "label", ["fold"])
