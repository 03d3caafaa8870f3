"""Queries on data-quality checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.ingest import ACTION_LOG
from tidelake.catalog.registry import query, with_ctes
from tidelake.operators import quality as q
from tidelake.operators.features import EVENT_TYPES
from tidelake.operators.repeats import blocks_for, repeats, take_in
from tidelake.session import scratch
from tidelake.sources import schemas
from tidelake.sources.lake import partitions
from tidelake.sources.sink import backfill, split_quarantine, tag_quarantine, write_quarantine


@query(
    "raw_validation",
    with_ctes(
        """SELECT dt, coalesce(l.n, 0) AS row_count, coalesce(c.n, 0) AS source_row_count,
          coalesce(l.nulls, 0) AS null_key_count, coalesce(l.dups, 0) AS duplicate_key_count,
          CASE WHEN coalesce(l.n, 0) = 0 THEN 'validation failed: partition is empty'
            ELSE 'ok' END AS non_empty_check,
          CASE WHEN coalesce(l.n, 0) <> coalesce(c.n, 0)
            THEN 'validation failed: row count mismatch loaded=' || coalesce(l.n, 0)
              || ' source=' || coalesce(c.n, 0) ELSE 'ok' END AS row_count_check,
          CASE WHEN coalesce(l.nulls, 0) > 0 THEN 'validation failed: ' || l.nulls
            || ' rows with NULL required columns' ELSE 'ok' END AS required_columns_check,
          CASE WHEN coalesce(l.dups, 0) > 0 THEN 'validation failed: ' || l.dups
            || ' duplicate event_id rows' ELSE 'ok' END AS unique_key_check
        FROM (SELECT dt, count(*) AS n,
                count(*) FILTER (event_id IS NULL OR user_id IS NULL OR video_id IS NULL
                  OR event_timestamp IS NULL) AS nulls,
                count(event_id) - count(DISTINCT event_id) AS dups
              FROM faulty GROUP BY dt) l
        FULL JOIN (SELECT dt, count(*) AS n FROM log GROUP BY dt) c USING (dt)""",
        s.FAULTY,
    ),
)
def raw_validation(spark: SparkSession, sf: str) -> DataFrame:
    return q.validate_raw(
        s.faulty_log(spark, sf), s.action_log(spark, sf), ACTION_LOG.required, ACTION_LOG.key
    )


@query(
    "duplicate_keys",
    with_ctes(
        """SELECT dt, count(event_id) - count(DISTINCT event_id) AS duplicate_key_count
        FROM faulty GROUP BY dt""",
        s.FAULTY,
    ),
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return q.duplicate_keys(s.faulty_log(spark, sf), "event_id")


@query(
    "duplicate_keys_global",
    with_ctes(
        "SELECT event_id, count(*) AS copies FROM faulty GROUP BY event_id HAVING count(*) > 1",
        s.FAULTY,
    ),
)
def duplicate_keys_global(spark: SparkSession, sf: str) -> DataFrame:
    return q.dup_keys_global(s.faulty_log(spark, sf), "event_id")


@query(
    "out_of_partition",
    with_ctes(
        """SELECT dt, count(*) FILTER (CAST(event_timestamp + INTERVAL 9 HOUR AS DATE) <> dt)
          AS out_of_partition_rows FROM faulty GROUP BY dt""",
        s.FAULTY,
    ),
)
def out_of_partition(spark: SparkSession, sf: str) -> DataFrame:
    return q.out_of_partition(s.faulty_log(spark, sf))


@query(
    "feature_validation",
    with_ctes(
        """SELECT dt, n AS row_count, nulls AS null_key_count, dups AS duplicate_key_count,
          'ok' AS non_empty_check,
          CASE WHEN nulls > 0 THEN 'validation failed: ' || nulls || ' rows with NULL key columns'
            ELSE 'ok' END AS required_columns_check,
          CASE WHEN dups > 0 THEN 'validation failed: ' || dups || ' duplicate key rows'
            ELSE 'ok' END AS unique_key_check
        FROM (SELECT dt, count(*) AS n, count(*) FILTER (user_id IS NULL) AS nulls,
                count(*) FILTER (user_id IS NOT NULL) - count(DISTINCT user_id)
                  FILTER (user_id IS NOT NULL) AS dups
              FROM (SELECT dt, CASE WHEN user_id % 37 = 4 THEN NULL ELSE user_id END AS user_id
                    FROM user_features
                    UNION ALL SELECT dt, user_id FROM user_features WHERE user_id % 41 = 6)
              GROUP BY dt)""",
        s.LOG,
        s.VIDEOS,
        s.USER_FEATURES,
    ),
)
def feature_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The user table with some keys blanked and some rows repeated."""
    rows = s.user_features(spark, sf).select("user_id", "event_timestamp", "dt")
    u = F.col("user_id")
    blanked = rows.withColumn("user_id", F.when(u % 37 == 4, F.lit(None)).otherwise(u))
    return q.validate_feature(blanked.unionByName(rows.where(u % 41 == 6)), ["user_id"])


@query(
    "event_type_distribution",
    with_ctes("SELECT dt, event_type, count(*) AS events FROM log GROUP BY ALL", s.LOG),
)
def event_type_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return q.event_type_distribution(s.action_log(spark, sf))


@query(
    "ctr_daily",
    with_ctes(
        """SELECT dt, clicks, impressions, round(clicks / NULLIF(impressions, 0), 9) AS ctr
        FROM (SELECT dt, count(*) FILTER (event_type = 'click') AS clicks,
                count(*) FILTER (event_type = 'impression') AS impressions
              FROM log GROUP BY dt)""",
        s.LOG,
    ),
)
def ctr_daily(spark: SparkSession, sf: str) -> DataFrame:
    return q.ctr(s.action_log(spark, sf)).withColumn("ctr", F.round("ctr", 9))


@query(
    "action_log_quality",
    with_ctes(
        """SELECT dt, row_count, impressions, clicks, views, likes, model_mismatch_rows,
          null_video_rows, null_user_rows, out_of_partition_rows, orphan_video_rows,
          orphan_user_rows, round(clicks / NULLIF(impressions, 0), 9) AS ctr,
          concat_ws('; ',
            CASE WHEN impressions = 0 THEN 'no impression event' END,
            CASE WHEN clicks = 0 THEN 'no click event' END,
            CASE WHEN views = 0 THEN 'no view event' END,
            CASE WHEN clicks <> views THEN 'click and view counts differ' END,
            CASE WHEN model_mismatch_rows > 0 THEN 'unexpected model' END,
            CASE WHEN orphan_video_rows + null_video_rows > 0
              THEN 'video outside the snapshot' END,
            CASE WHEN orphan_user_rows + null_user_rows > 0 THEN 'user outside the sample' END,
            CASE WHEN out_of_partition_rows > 0
              THEN 'event time outside the partition' END) AS errors
        FROM (SELECT dt, count(*) AS row_count,
          count(*) FILTER (event_type = 'impression') AS impressions,
          count(*) FILTER (event_type = 'click') AS clicks,
          count(*) FILTER (event_type = 'view') AS views,
          count(*) FILTER (event_type = 'like') AS likes,
          count(*) FILTER (llm_model <> 'primary-model') AS model_mismatch_rows,
          count(*) FILTER (video_id IS NULL) AS null_video_rows,
          count(*) FILTER (user_id IS NULL) AS null_user_rows,
          count(*) FILTER (CAST(event_timestamp + INTERVAL 9 HOUR AS DATE) <> dt)
            AS out_of_partition_rows,
          count(*) FILTER (video_id NOT IN (SELECT p_partkey FROM part)) AS orphan_video_rows,
          count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer)) AS orphan_user_rows
          FROM faulty GROUP BY dt)""",
        s.FAULTY,
    ),
)
def action_log_quality(spark: SparkSession, sf: str) -> DataFrame:
    report = q.action_log_quality(
        s.faulty_log(spark, sf), s.videos(spark, sf), s.users(spark, sf), s.MODEL
    )
    return report.withColumn("errors", F.array_join("errors", "; ")).withColumn(
        "ctr", F.round("ctr", 9)
    )


@query(
    "orphan_items",
    with_ctes(
        """SELECT dt, video_id, count(*) AS rows FROM faulty f
        WHERE video_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = f.video_id)
        GROUP BY ALL""",
        s.FAULTY,
    ),
)
def orphan_items(spark: SparkSession, sf: str) -> DataFrame:
    return q.orphans(s.faulty_log(spark, sf), s.videos(spark, sf), "video_id")


@query(
    "orphan_users",
    with_ctes(
        """SELECT dt, user_id, count(*) AS rows FROM faulty f
        WHERE user_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = f.user_id)
        GROUP BY ALL""",
        s.FAULTY,
    ),
)
def orphan_users(spark: SparkSession, sf: str) -> DataFrame:
    return q.orphans(s.faulty_log(spark, sf), s.users(spark, sf), "user_id")


def rules() -> dict[str, Column]:
    return {
        "unknown event type": ~F.col("event_type").isin(*EVENT_TYPES),
        "missing user": F.col("user_id").isNull(),
        "negative video": F.col("video_id") < 0,
    }


_REASONS = """concat_ws('; ',
    CASE WHEN event_type = 'error' THEN 'unknown event type' END,
    CASE WHEN user_id IS NULL THEN 'missing user' END,
    CASE WHEN video_id < 0 THEN 'negative video' END)"""


@query(
    "quarantine_split",
    with_ctes(
        f"""SELECT dt, event_id, {_REASONS} AS reasons,
          CASE WHEN {_REASONS} = '' THEN 'good' ELSE 'quarantine' END AS sink
        FROM faulty""",
        s.FAULTY,
    ),
)
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    """Good rows to Parquet, bad ones to JSON lines, both read back."""
    good_base, bad_base = scratch(spark, "good"), scratch(spark, "quarantine")
    good, bad = split_quarantine(s.faulty_log(spark, sf), rules())
    backfill(good, good_base)
    write_quarantine(bad, bad_base)
    kept = spark.read.parquet(good_base).select(
        "dt", "event_id", F.lit("").alias("reasons"), F.lit("good").alias("sink")
    )
    aside = spark.read.schema("event_id long, reasons array<string>, dt date").json(bad_base)
    return kept.unionByName(
        aside.select(
            "dt",
            "event_id",
            F.array_join("reasons", "; ").alias("reasons"),
            F.lit("quarantine").alias("sink"),
        )
    )


@query(
    "quarantine_ratio",
    with_ctes(
        f"""SELECT dt, count(*) AS row_count, count(*) FILTER ({_REASONS} <> '') AS bad_rows,
          round(count(*) FILTER ({_REASONS} <> '') / count(*), 9) AS bad_ratio,
          count(*) FILTER ({_REASONS} <> '') <= count(*) * 0.22 AS within_limit
        FROM faulty GROUP BY dt""",
        s.FAULTY,
    ),
)
def quarantine_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is set so that some days pass and some do not."""
    tagged = tag_quarantine(s.faulty_log(spark, sf), rules())
    return q.quarantine_ratio(tagged, 0.22).withColumn("bad_ratio", F.round("bad_ratio", 9))


def _resent_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log with some events sent again, up to two times, on other days."""
    log = s.action_log(spark, sf).where(F.col("dt") >= F.lit(s.FIRST_DAY))
    again = [
        log.where(F.col("event_id") % n == 0).withColumn("dt", F.least(F.date_add("dt", n % 7), F.lit(s.LAST_DAY)))
        for n in (211, 503)
    ]
    return log.unionByName(again[0]).unionByName(again[1])


@query(
    "duplicate_keys_incremental",
    with_ctes(
        f"""SELECT event_id, count(*) AS copies FROM (
          SELECT event_id FROM log WHERE dt >= DATE '{s.FIRST_DAY}'
          UNION ALL SELECT event_id FROM log WHERE dt >= DATE '{s.FIRST_DAY}' AND event_id % 211 = 0
          UNION ALL SELECT event_id FROM log WHERE dt >= DATE '{s.FIRST_DAY}' AND event_id % 503 = 0)
        GROUP BY event_id HAVING count(*) > 1""",
        s.LOG,
    ),
)
def duplicate_keys_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated events of the whole lake, found in three batches of days by their filters."""
    base, state = scratch(spark, "resent"), scratch(spark, "repeats")
    backfill(_resent_log(spark, sf), base, schema=schemas.ACTION_LOG)
    days = [date.fromisoformat(d) for d in partitions(spark, base)]
    size = -(-len(days) // 3)
    for start in range(0, len(days), size):
        batch = days[start : start + size]
        take_in(spark, base, state, batch, ["event_id"], blocks_for(20_000), schema=schemas.ACTION_LOG, committed=True)
    return repeats(spark, state)
