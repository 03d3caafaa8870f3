"""The driver's tables seen as a recommender's log, videos, users and so on.

Each Spark frame has a SQL twin of the same name for the oracles. Expressions that
only make up input text are shared by both engines; the work on it is not.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.dates import kst_date
from tidelake.operators.attribution import attribute_clicks
from tidelake.operators.features import user_dynamic, video_feature
from tidelake.operators.ranking import trending_snapshot

MODEL = "primary-model"
WIDE_SECONDS = 6 * 3600
DAY = date(2024, 1, 10)
WINDOW = (date(2024, 1, 22), date(2024, 1, 28))
FIRST_DAY, LAST_DAY = date(2024, 1, 1), date(2024, 1, 31)
MARKS = (datetime(2024, 1, 15), datetime(2024, 1, 25, 12))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def action_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "view", "impression")
        .when(F.col("event_type") == "click", "click")
        .when(F.col("event_type") == "purchase", "view")
        .when(F.col("event_type") == "signup", "like")
        .otherwise("error")
    )
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").try_cast("long").alias("video_id"),
        F.col("ts").alias("event_timestamp"),
        kind.alias("event_type"),
        F.when(F.col("value") > 300, "fallback-model").otherwise(MODEL).alias("llm_model"),
        "value",
        kst_date(F.col("ts")).alias("dt"),
    )


LOG = """log AS (
  SELECT event_id, user_id, TRY_CAST(props->>'k' AS BIGINT) AS video_id,
    ts AS event_timestamp,
    CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click'
      WHEN 'purchase' THEN 'view' WHEN 'signup' THEN 'like' ELSE 'error' END AS event_type,
    CASE WHEN value > 300 THEN 'fallback-model' ELSE 'primary-model' END AS llm_model,
    value, CAST(ts + INTERVAL 9 HOUR AS DATE) AS dt
  FROM events)"""


def faulty_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log with NULL keys, unknown keys, wrong days and duplicates put in."""
    e = F.col("event_id")
    copies = F.when(e % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return action_log(spark, sf).select(
        "event_id",
        F.when(e % 89 == 3, F.lit(None))
        .when(e % 79 == 2, -1 - F.col("user_id"))
        .otherwise(F.col("user_id"))
        .alias("user_id"),
        F.when(e % 97 == 5, -1 - F.col("video_id")).otherwise(F.col("video_id")).alias("video_id"),
        "event_timestamp",
        "event_type",
        "llm_model",
        "value",
        F.when(e % 83 == 7, F.date_add("dt", 1)).otherwise(F.col("dt")).alias("dt"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


FAULTY = f"""{LOG}, faulty_once AS (
  SELECT event_id,
    CASE WHEN event_id % 89 = 3 THEN NULL WHEN event_id % 79 = 2 THEN -1 - user_id
      ELSE user_id END AS user_id,
    CASE WHEN event_id % 97 = 5 THEN -1 - video_id ELSE video_id END AS video_id,
    event_timestamp, event_type, llm_model, value,
    CASE WHEN event_id % 83 = 7 THEN dt + 1 ELSE dt END AS dt
  FROM log),
faulty AS (
  SELECT * FROM faulty_once
  UNION ALL SELECT * FROM faulty_once WHERE event_id % 101 = 0)"""


def videos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("video_id"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


VIDEOS = """videos AS (
  SELECT p_partkey AS video_id, p_type AS category, p_size AS size, p_retailprice AS price
  FROM part)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def trending(spark: SparkSession, sf: str) -> DataFrame:
    """Daily snapshot: the most shown videos of each day."""
    shown = (
        action_log(spark, sf)
        .where(F.col("event_type") == "impression")
        .groupBy("dt", "video_id")
        .agg(F.count(F.lit(1)).alias("shown"))
    )
    rows = shown.join(videos(spark, sf), "video_id").withColumn("region", F.lit("KR"))
    return trending_snapshot(rows, "KR", [F.desc("shown"), F.col("video_id")])


TRENDING = """trending AS (
  SELECT dt, video_id, shown, category, size, price,
    CAST(row_number() OVER (PARTITION BY dt ORDER BY shown DESC, video_id) AS INTEGER) AS rank
  FROM (SELECT dt, video_id, count(*) AS shown FROM log
        WHERE event_type = 'impression' GROUP BY ALL) JOIN videos USING (video_id)
  QUALIFY rank <= 200)"""


def spine(spark: SparkSession, sf: str) -> DataFrame:
    return attribute_clicks(action_log(spark, sf), ["user_id"], WIDE_SECONDS)


def spine_sql(seconds: int = WIDE_SECONDS, keys: tuple[str, ...] = ("user_id",)) -> str:
    on = " AND ".join(f"i.{k} = c.{k}" for k in keys)
    return f"""hits AS (
  SELECT i.event_id FROM log c JOIN log i ON {on}
    AND i.event_timestamp <= c.event_timestamp
    AND c.event_timestamp <= i.event_timestamp + INTERVAL {seconds} SECOND
  WHERE c.event_type = 'click' AND i.event_type = 'impression'
  QUALIFY row_number() OVER (PARTITION BY c.event_id
    ORDER BY i.event_timestamp DESC, i.event_id DESC) = 1),
spine AS (
  SELECT event_id, user_id, video_id, event_timestamp, dt,
    CAST(event_id IN (SELECT event_id FROM hits) AS INTEGER) AS label
  FROM log WHERE event_type = 'impression')"""


def user_features(spark: SparkSession, sf: str) -> DataFrame:
    return user_dynamic(action_log(spark, sf), videos(spark, sf))


USER_FEATURES = """user_features AS (
  SELECT user_id, dt, CAST(dt + 1 AS TIMESTAMP) - INTERVAL 9 HOUR AS event_timestamp,
    count(*) FILTER (event_type = 'impression') AS impressions,
    count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type = 'view') AS views,
    count(*) FILTER (event_type = 'like') AS likes,
    count(*) FILTER (event_type = 'click')
      / NULLIF(count(*) FILTER (event_type = 'impression'), 0) AS ctr,
    count(DISTINCT video_id) AS distinct_videos,
    max(event_timestamp) AS last_event
  FROM log WHERE event_type <> 'error' GROUP BY user_id, dt),
top_categories AS (
  SELECT user_id, dt, category AS top_category
  FROM log JOIN videos USING (video_id) WHERE event_type <> 'error'
  GROUP BY user_id, dt, category
  QUALIFY row_number() OVER (PARTITION BY user_id, dt ORDER BY count(*) DESC, category DESC) = 1)"""


def video_features(spark: SparkSession, sf: str) -> DataFrame:
    return video_feature(trending(spark, sf))


VIDEO_FEATURES = """video_features AS (
  SELECT video_id, CAST(dt + 1 AS TIMESTAMP) - INTERVAL 9 HOUR AS event_timestamp,
    category, size, rank AS trend_rank,
    CAST(row_number() OVER (PARTITION BY dt ORDER BY price DESC, video_id) AS INTEGER)
      AS price_rank, dt
  FROM trending)"""


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


SCORED = """scored AS (
  SELECT doc_id, lang, source, n_chars, quality FROM documents JOIN labels USING (doc_id))"""
