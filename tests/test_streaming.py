import random
import shutil
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.operators.attribution import attribute_clicks
from tidelake.operators.quality import ctr
from tidelake.plans.raw_load import RawTable
from tidelake.session import scratch
from tidelake.sources import schemas
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import commit_day, read_lake
from tidelake.sources.online import read_online
from tidelake.sources.sink import backfill
from tidelake.streaming import jobs
from tidelake.streaming.source import drain, read_lake_stream

TABLE = RawTable("log", schemas.ACTION_LOG, ("event_id", "user_id"), "event_id")


@pytest.fixture
def log(make_log):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        at = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(6 * 1440))
        kind = rng.choice(["impression", "impression", "click", "view"])
        rows.append((i, rng.randrange(3), rng.randrange(2), str(at), kind))
    return make_log(rows).cache()


def counts(df):
    return {str(r.dt): r["count"] for r in df.groupBy("dt").count().collect()}


def until(log, day):
    return log.where(F.col("dt") <= F.lit(day))


def test_ingest_reloads_the_days_with_new_files(spark, log):
    source, target, ledger, checkpoint = (scratch(spark, n) for n in ("s", "t", "l", "c"))

    def run():
        drain(jobs.stream_ingest(spark, source, target, TABLE, ledger), checkpoint)

    backfill(until(log, date(2024, 1, 2)), source, schema=schemas.ACTION_LOG)
    run()
    assert counts(read_lake(spark, target)) == counts(until(log, date(2024, 1, 2)))
    # the second day gets another file, a third day arrives, a stray copy lies about
    more = log.where("dt = '2024-01-02'").withColumn("event_id", F.col("event_id") + 10_000)
    more.drop("dt").coalesce(1).write.mode("append").parquet(f"{source}/dt=2024-01-02")
    commit_day(spark, source, "2024-01-02")
    backfill(log.where("dt = '2024-01-03'"), source, schema=schemas.ACTION_LOG)
    fs = SharedFs(spark, source)
    part = next(n for n in fs.names(f"{source}/dt=2024-01-01") if n.startswith("part-"))
    local = source.removeprefix("file:")
    shutil.copy(f"{local}/dt=2024-01-01/{part}", f"{local}/dt=2024-01-01/part-0.parquet.staging-1")
    run()
    want = counts(until(log, date(2024, 1, 3)))
    want["2024-01-02"] *= 2
    assert counts(read_lake(spark, target)) == want
    days = [str(r.dt) for r in spark.read.parquet(ledger).collect()]
    assert sorted(days) == ["2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03"]


def test_attribution_labels_a_day_once_it_is_final(spark, log):
    source, landing, spine, checkpoint = (scratch(spark, n) for n in ("s", "l", "o", "c"))
    final = {}
    for n in range(1, 8):
        day = date(2024, 1, n)
        part = log.where(F.col("dt") == F.lit(day))
        if part.isEmpty():
            continue
        backfill(part, source, schema=schemas.ACTION_LOG)
        stream = read_lake_stream(spark, source, schemas.ACTION_LOG)
        drain(
            jobs.stream_attribution(stream, landing, spine, ["user_id"], 6 * 3600, timedelta(hours=1)),
            checkpoint,
        )
        done = SharedFs(spark, spine).names(spine)
        final[n] = [d for d in done if d.startswith("dt=")]
    assert final[2] == [] and final[3] == ["dt=2024-01-01"]
    got = {r.event_id: (r.dt, r.label) for r in read_lake(spark, spine).collect()}
    last = max(d for d, _ in got.values())
    want = attribute_clicks(until(log, last + timedelta(days=1)), ["user_id"], 6 * 3600)
    assert got == {r.event_id: (r.dt, r.label) for r in until(want, last).collect()}
    assert last >= date(2024, 1, 5)


def test_dedup_holds_over_restarts(spark, log):
    source, out, checkpoint = (scratch(spark, n) for n in ("s", "o", "c"))
    for copy in range(2):
        backfill(log.withColumn("dt", F.date_add("dt", copy * 30)), source, schema=schemas.ACTION_LOG)
        first = jobs.stream_dedup(read_lake_stream(spark, source, schemas.ACTION_LOG), delay="30 days")
        drain(first.writeStream.format("parquet").option("path", out), checkpoint)
    ids = [r.event_id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(600))


def test_online_snapshot_follows_the_stream(spark):
    source, base, checkpoint = (scratch(spark, n) for n in ("s", "o", "c"))
    schema = "user_id long, event_timestamp timestamp_ntz, x long, dt date"
    batches = [
        [(1, datetime(2024, 1, 1), 1, date(2024, 1, 1)), (2, datetime(2024, 1, 1), 2, date(2024, 1, 1))],
        [(1, datetime(2024, 1, 3), 9, date(2024, 1, 3)), (2, datetime(2023, 12, 1), 0, date(2023, 12, 1))],
        [(3, datetime(2024, 1, 2), 3, date(2024, 1, 2))],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        backfill(df, source)
        stream = read_lake_stream(spark, source, df.drop("dt").schema).drop("dt")
        drain(jobs.stream_online(stream, base, "v", ["user_id"]), checkpoint)
    got = {r.user_id: r.x for r in read_online(spark, base, "v").collect()}
    assert got == {1: 9, 2: 2, 3: 3}


def test_daily_ctr_is_updated_by_late_rows(spark, log):
    source, base, checkpoint = (scratch(spark, n) for n in ("s", "o", "c"))
    late = (F.col("dt") == F.lit(date(2024, 1, 4))) & (F.col("event_id") % 2 == 0)
    for part in (until(log, date(2024, 1, 5)).where(~late), log.where(late | (F.col("dt") > F.lit(date(2024, 1, 5))))):
        rows = part.drop("dt")
        for r in part.select("dt").distinct().collect():
            day = part.where(F.col("dt") == F.lit(r.dt)).drop("dt")
            day.coalesce(1).write.mode("append").parquet(f"{source}/dt={r.dt}")
        assert rows.columns == schemas.ACTION_LOG.names
        stream = read_lake_stream(spark, source, schemas.ACTION_LOG)
        drain(jobs.stream_ctr(stream, base), checkpoint)
    got = {r.dt: (r.clicks, r.impressions) for r in read_online(spark, base, "ctr_daily").collect()}
    assert got == {r.dt: (r.clicks, r.impressions) for r in ctr(log).collect()}
