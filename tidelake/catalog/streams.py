"""Queries that run the streaming jobs over a lake made from the whole log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.ingest import _PER_DAY, ACTION_LOG, _per_day
from tidelake.catalog.registry import query, with_ctes
from tidelake.session import scratch
from tidelake.sources import schemas
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import MANIFEST, partition_path, partitions, read_lake
from tidelake.sources.online import read_online
from tidelake.sources.sink import backfill
from tidelake.streaming import jobs
from tidelake.streaming.source import drain, read_lake_stream


def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark, "stream-lake")
    backfill(s.action_log(spark, sf), base, schema=schemas.ACTION_LOG)
    return read_lake_stream(spark, base, schemas.ACTION_LOG)


@query("stream_ingest", with_ctes(f"{_PER_DAY} FROM log GROUP BY dt", s.LOG))
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    source, target = scratch(spark, "stream-lake"), scratch(spark, "stream-raw")
    ledger = scratch(spark, "stream-ledger")
    backfill(s.action_log(spark, sf), source, schema=schemas.ACTION_LOG)
    job = jobs.stream_ingest(spark, source, target, ACTION_LOG, ledger)
    drain(job, scratch(spark, "checkpoint"))
    return _per_day(read_lake(spark, target, schema=schemas.ACTION_LOG))


@query(
    "stream_ingest_half_day",
    with_ctes(
        f"""SELECT *, dt <> DATE '{s.DAY}' AS early, 1 AS entries
        FROM ({_PER_DAY} FROM log GROUP BY dt)""",
        s.LOG,
    ),
)
def stream_ingest_half_day(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that meets a half-arrived day: it loads the others and fails, and its next
    run, with the same batch, loads all. A batch that runs twice leaves one ledger entry a day."""
    source, target, aside = (scratch(spark, n) for n in ("stream-lake", "stream-raw", "late"))
    ledger, checkpoint = scratch(spark, "stream-ledger"), scratch(spark, "checkpoint")
    backfill(s.action_log(spark, sf), source, schema=schemas.ACTION_LOG)
    fs, folder = SharedFs(spark, source), partition_path(source, s.DAY)
    fs.rename(f"{folder}/{MANIFEST}", f"{aside}/{MANIFEST}")
    early = []
    try:
        drain(jobs.stream_ingest(spark, source, target, ACTION_LOG, ledger), checkpoint)
    except StreamingQueryException:
        early = partitions(spark, target)
    fs.rename(f"{aside}/{MANIFEST}", f"{folder}/{MANIFEST}")
    drain(jobs.stream_ingest(spark, source, target, ACTION_LOG, ledger), checkpoint)
    entries = spark.read.parquet(ledger).groupBy("dt").agg(F.count("*").cast("int").alias("entries"))
    loaded = _per_day(read_lake(spark, target, schema=schemas.ACTION_LOG)).join(entries, "dt")
    return loaded.withColumn("early", F.col("dt").cast("string").isin(early))


@query(
    "stream_attribution",
    with_ctes(
        """SELECT * FROM spine WHERE CAST(dt + 2 AS TIMESTAMP) - INTERVAL 9 HOUR
          <= (SELECT max(event_timestamp) FROM log
              WHERE event_type IN ('impression', 'click')) - INTERVAL 2 HOUR""",
        s.LOG,
        s.spine_sql(),
    ),
)
def stream_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Every day that is final by the end of the log."""
    landing, spine = scratch(spark, "landing"), scratch(spark, "spine")
    job = jobs.stream_attribution(
        _log_stream(spark, sf), landing, spine, ["user_id"], s.WIDE_SECONDS, timedelta(hours=2)
    )
    drain(job, scratch(spark, "checkpoint"))
    return read_lake(spark, spine).select(
        "event_id", "user_id", "video_id", "event_timestamp", "dt", "label"
    )


@query(
    "stream_dedup",
    with_ctes(
        "SELECT dt, event_id, user_id, video_id FROM faulty_once", s.FAULTY
    ),
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The log with duplicates, streamed without them."""
    base, out = scratch(spark, "stream-lake"), scratch(spark, "deduped")
    backfill(s.faulty_log(spark, sf), base, schema=schemas.ACTION_LOG)
    first = jobs.stream_dedup(read_lake_stream(spark, base, schemas.ACTION_LOG))
    drain(first.writeStream.format("parquet").option("path", out), scratch(spark, "checkpoint"))
    return spark.read.parquet(out).select("dt", "event_id", "user_id", "video_id")


@query(
    "stream_online",
    with_ctes(
        """SELECT user_id, event_timestamp, impressions, clicks FROM user_features
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1""",
        s.LOG,
        s.VIDEOS,
        s.USER_FEATURES,
    ),
)
def stream_online(spark: SparkSession, sf: str) -> DataFrame:
    features, base = scratch(spark, "stream-features"), scratch(spark, "online")
    backfill(s.user_features(spark, sf), features, schema=schemas.USER_DYNAMIC_FEATURE)
    rows = read_lake_stream(spark, features, schemas.USER_DYNAMIC_FEATURE)
    job = jobs.stream_online(rows, base, "user_dynamic", ["user_id"])
    drain(job, scratch(spark, "checkpoint"))
    return read_online(spark, base, "user_dynamic").select(
        "user_id", "event_timestamp", "impressions", "clicks"
    )


@query(
    "stream_ctr_daily",
    with_ctes(
        """SELECT dt, clicks, impressions, round(clicks / NULLIF(impressions, 0), 9) AS ctr
        FROM (SELECT dt, count(*) FILTER (event_type = 'click') AS clicks,
                count(*) FILTER (event_type = 'impression') AS impressions
              FROM log GROUP BY dt)""",
        s.LOG,
    ),
)
def stream_ctr_daily(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark, "ctr")
    drain(jobs.stream_ctr(_log_stream(spark, sf), base), scratch(spark, "checkpoint"))
    daily = read_online(spark, base, "ctr_daily")
    return daily.select("dt", "clicks", "impressions", F.round("ctr", 9).alias("ctr"))
