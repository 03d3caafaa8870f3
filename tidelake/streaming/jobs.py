"""The streaming jobs: ingest, attribution, dedup, online snapshot and daily CTR."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidelake.functions.dates import LOCAL_ZONE, instant, kst_date
from tidelake.operators.attribution import CLICK_WINDOW_SECONDS, attribute_clicks
from tidelake.plans.raw_load import RawTable, complete_days, load_days
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import PartitionNotReadyError, days_between, partitions, read_days
from tidelake.sources.online import merge, vacuum
from tidelake.sources.sink import backfill
from tidelake.streaming.source import read_lake_stream


def stream_ingest(
    spark: SparkSession, source: str, target: str, table: RawTable, ledger: str
) -> DataStreamWriter:
    """Load and validate whole days as their files arrive.

    The stream only tells which days have new files. Each of them is then replaced
    from the lake as a whole, by its manifest. A batch that names a day which is not
    complete loads the others and fails; run again, it loads the day once it is complete
    and leaves one ledger entry per load.
    """

    def load(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        days = sorted(r.dt for r in batch.select("dt").distinct().collect())
        complete, lacking = complete_days(session, source, days)
        if complete:
            load_days(session, source, target, complete, table, ledger)
        if lacking:
            raise PartitionNotReadyError("; ".join(lacking))

    return read_lake_stream(spark, source, table.schema).writeStream.foreachBatch(load)


def _end_of_next_day(day: date) -> datetime:
    """UTC wall clock at which the local day after ``day`` ends."""
    local = datetime.combine(day + timedelta(days=2), time(), ZoneInfo(LOCAL_ZONE))
    return local.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def stream_attribution(
    log: DataFrame,
    landing: str,
    spine: str,
    keys: Sequence[str] = ("user_id", "video_id"),
    window_seconds: int = CLICK_WINDOW_SECONDS,
    delay: timedelta = timedelta(hours=2),
) -> DataStreamWriter:
    """Label the impressions of a day once its last possible clicks are in.

    Rows land per day and batch. A day is final when the latest event time less the
    delay has passed the end of the next local day; rows that come later than that
    land too but no longer change a label. Newly final days are labelled in one batch
    job, so no pairs of clicks and impressions are held as state.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fs = SharedFs(session, landing)
        rows = batch.where(F.col("event_type").isin("impression", "click"))
        (
            rows.withColumn("batch", F.lit(batch_id))
            .hint("rebalance", "dt")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch")
            .parquet(landing)
        )
        newest = rows.agg(F.max("event_timestamp").alias("at")).first().at
        marks = f"{landing}/_marks"
        written = [n for n in fs.names(marks) if n.endswith(".json")]
        before = None
        if written:
            before = datetime.fromisoformat(json.loads(fs.read_text(f"{marks}/{written[-1]}")))
            newest = before if newest is None else max(newest, before)
        if newest is None:
            return
        ends = {d: _end_of_next_day(d) for d in map(date.fromisoformat, partitions(session, landing))}
        final = [
            d
            for d, end in ends.items()
            if end <= newest - delay and (before is None or end > before - delay)
        ]
        if final:
            days = days_between(final[0], final[-1] + timedelta(days=1))
            landed = read_days(session, landing, days, "batch=*/part-*.parquet", missing_ok=True)
            labelled = attribute_clicks(landed, keys, window_seconds)
            backfill(labelled.where(F.col("dt").isin(final)), spine)
        # written last: a batch that is lost before this point does its days again
        mark = f"{marks}/{batch_id:010d}.json"
        if not fs.exists(mark):
            fs.create_text(mark, json.dumps(newest.isoformat()))

    return log.writeStream.foreachBatch(advance)


def stream_dedup(
    log: DataFrame, key: str = "event_id", ts: str = "event_timestamp", delay: str = "2 days"
) -> DataFrame:
    """First copy of each event; state older than the delay is dropped."""
    timed = log.withColumn("_at", instant(F.col(ts))).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")


def upsert_stream(
    rows: DataFrame,
    base: str,
    view: str,
    keys: list[str],
    order: str,
    mode: str = "append",
    retain: timedelta = timedelta(days=1),
) -> DataStreamWriter:
    """Keep the newest row of each key; batch N publishes version N+1 from version N.

    Versions stay readable for ``retain`` after they were published, and the last three always.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn(order, F.lit(batch_id)) if order not in batch.columns else batch
        merge(fresh, base, view, batch_id, keys, order, datetime.now())
        vacuum(batch.sparkSession, base, view, older_than=retain)

    return rows.writeStream.outputMode(mode).foreachBatch(advance)


def stream_online(features: DataFrame, base: str, view: str, keys: list[str]) -> DataStreamWriter:
    """Online snapshot kept by a stream; the checkpoint takes the watermark's place."""
    return upsert_stream(features, base, view, keys, "event_timestamp")


def daily_ctr(log: DataFrame, ts: str = "event_timestamp", delay: str = "2 days") -> DataFrame:
    """Clicks, impressions and CTR per local day, as tumbling windows.

    A local day starts at 15:00 UTC of the day before. Rows later than the delay are
    dropped once their window has closed.
    """
    clicks = F.count_if(F.col("event_type") == "click")
    impressions = F.count_if(F.col("event_type") == "impression")
    day = F.window("_at", "1 day", startTime="15 hours")
    return (
        log.withColumn("_at", instant(F.col(ts)))
        .withWatermark("_at", delay)
        .groupBy(day)
        .agg(
            clicks.alias("clicks"),
            impressions.alias("impressions"),
            F.try_divide(clicks, impressions).alias("ctr"),
        )
        .select(
            kst_date(F.col("window.start"), source_zone=None).alias("dt"),
            "clicks",
            "impressions",
            "ctr",
        )
    )


def stream_ctr(log: DataFrame, base: str, view: str = "ctr_daily") -> DataStreamWriter:
    """The daily table kept current: changed days replace their rows."""
    return upsert_stream(daily_ctr(log), base, view, ["dt"], "batch", mode="update")
