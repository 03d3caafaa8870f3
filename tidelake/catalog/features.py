"""Queries on feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.registry import query, with_ctes
from tidelake.operators import attribution
from tidelake.operators.asof import with_static
from tidelake.operators.features import daily_activity, trailing, trailing_distinct
from tidelake.plans.feature_build import build_entity, build_snapshots
from tidelake.session import scratch
from tidelake.sources import schemas
from tidelake.sources.lake import read_lake
from tidelake.sources.sink import backfill


@query(
    "user_dynamic_feature",
    with_ctes(
        """SELECT user_id, event_timestamp, impressions, clicks, views, likes,
          round(ctr, 9) AS ctr, distinct_videos, top_category, last_event, dt
        FROM user_features LEFT JOIN top_categories USING (user_id, dt)""",
        s.LOG,
        s.VIDEOS,
        s.USER_FEATURES,
    ),
)
def user_dynamic_feature(spark: SparkSession, sf: str) -> DataFrame:
    return s.user_features(spark, sf).withColumn("ctr", F.round("ctr", 9))


@query(
    "video_feature",
    with_ctes("SELECT * FROM video_features", s.LOG, s.VIDEOS, s.TRENDING, s.VIDEO_FEATURES),
)
def video_feature(spark: SparkSession, sf: str) -> DataFrame:
    return s.video_features(spark, sf)


@query(
    "user_trailing_7d",
    with_ctes(
        """SELECT user_id, dt,
          CAST(sum(impressions) OVER w AS BIGINT) AS impressions_7d,
          CAST(sum(clicks) OVER w AS BIGINT) AS clicks_7d,
          count(*) OVER w AS active_days_7d,
          (SELECT count(DISTINCT l.video_id) FROM log l
            WHERE l.user_id = a.user_id AND l.dt BETWEEN a.dt - 6 AND a.dt) AS distinct_videos_7d
        FROM (SELECT user_id, dt, count(*) FILTER (event_type = 'impression') AS impressions,
                count(*) FILTER (event_type = 'click') AS clicks
              FROM log GROUP BY user_id, dt) a
        WINDOW w AS (PARTITION BY user_id ORDER BY dt
          RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
        s.LOG,
    ),
)
def user_trailing_7d(spark: SparkSession, sf: str) -> DataFrame:
    log = s.action_log(spark, sf)
    sums = trailing(daily_activity(log), "user_id", ["impressions", "clicks"])
    videos = trailing_distinct(log, "user_id", "video_id", name="distinct_videos_7d")
    return sums.join(videos, ["user_id", "dt"], "left")


@query(
    "static_enrich",
    with_ctes(
        """SELECT event_id, user_id, c_mktsegment AS segment, c_acctbal AS balance
        FROM faulty LEFT JOIN customer ON user_id = c_custkey""",
        s.FAULTY,
    ),
)
def static_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the log, also those whose user is unknown or missing."""
    rows = s.faulty_log(spark, sf).select("event_id", "user_id")
    return with_static(rows, s.users(spark, sf), "user_id").select(
        "event_id", "user_id", "segment", "balance"
    )


@query(
    "label_rate",
    with_ctes(
        """SELECT dt, count(*) AS rows, count(*) FILTER (label = 1) AS positives,
          round(count(*) FILTER (label = 1) / count(*), 9) AS label_rate
        FROM spine GROUP BY dt""",
        s.LOG,
        s.spine_sql(),
    ),
)
def label_rate(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.label_rate(s.spine(spark, sf)).withColumn("label_rate", F.round("label_rate", 9))


@query(
    "daily_feature_build",
    with_ctes(
        f"""SELECT 'user_dynamic_feature' AS table_name, count(*) AS rows,
            CAST(sum(user_id) AS BIGINT) AS key_sum, CAST(sum(clicks) AS BIGINT) AS hits
          FROM user_features WHERE dt = DATE '{s.DAY}'
        UNION ALL SELECT 'video_feature', count(*), CAST(sum(video_id) AS BIGINT),
            CAST(sum(price_rank) AS BIGINT) FROM video_features WHERE dt = DATE '{s.DAY}'
        UNION ALL SELECT 'training_entity', count(*), CAST(sum(event_id) AS BIGINT),
            CAST(sum(label) AS BIGINT) FROM spine WHERE dt = DATE '{s.DAY}' - 1""",
        s.LOG,
        s.VIDEOS,
        s.TRENDING,
        s.spine_sql(),
        s.USER_FEATURES,
        s.VIDEO_FEATURES,
    ),
)
def daily_feature_build(spark: SparkSession, sf: str) -> DataFrame:
    """The three feature tables of one run, from the stored raw layer."""
    raw, out = scratch(spark, "raw"), scratch(spark, "features")
    backfill(s.action_log(spark, sf), f"{raw}/log", schema=schemas.ACTION_LOG)
    backfill(s.trending(spark, sf), f"{raw}/trending")
    log = read_lake(spark, f"{raw}/log", schema=schemas.ACTION_LOG)
    build_snapshots(log, read_lake(spark, f"{raw}/trending"), raw, out, s.DAY)
    build_entity(log, raw, out, s.DAY, ["user_id"], s.WIDE_SECONDS)

    def total(table: str, key: str, hits: str) -> DataFrame:
        return read_lake(spark, f"{out}/{table}").agg(
            F.lit(table).alias("table_name"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(key).alias("key_sum"),
            F.sum(hits).alias("hits"),
        )

    return (
        total("user_dynamic_feature", "user_id", "clicks")
        .unionByName(total("video_feature", "video_id", "price_rank"))
        .unionByName(total("training_entity", "event_id", "label"))
    )
