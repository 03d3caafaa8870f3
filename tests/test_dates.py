from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidelake.functions import dates

END = datetime(2024, 1, 10, 15, 30, tzinfo=timezone.utc)  # 00:30 on the 11th, local


def test_local_day_changes_at_fifteen_utc(spark):
    rows = [(datetime(2024, 1, 10, 14, 59, 59),), (datetime(2024, 1, 10, 15, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    days = [r[0] for r in df.select(dates.kst_date(F.col("ts"))).collect()]
    assert days == [date(2024, 1, 10), date(2024, 1, 11)]


def test_summer_time_of_old_years_is_kept(spark):
    """Clocks were ten hours ahead in the summer of 1988."""
    rows = [(datetime(1988, 7, 1, 14, 30),), (datetime(1988, 12, 1, 14, 30),), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    days = [r[0] for r in df.select(dates.kst_date(F.col("ts"))).collect()]
    assert days == [date(1988, 7, 2), date(1988, 12, 1), None]


def test_midnight_is_the_first_instant_of_its_day(spark):
    df = spark.createDataFrame([(date(2024, 1, 11),)], "d date")
    row = df.select(dates.kst_midnight(F.col("d")).alias("m"), dates.dt_compact(F.col("d")).alias("c"))
    got = row.first()
    assert got.m == datetime(2024, 1, 10, 15, 0)
    assert got.c == "20240111"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_and_buckets_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(datetime(2024, 3, 10, 7, 30),)], "ts timestamp_ntz")
        df = df.withColumn("at", dates.instant(F.col("ts")))
        row = df.select(
            F.unix_seconds("at").alias("s"),
            dates.epoch_seconds(df, "ts").alias("ntz"),
            dates.epoch_seconds(df, "at").alias("inst"),
            dates.time_bucket(df, "ts", 600).alias("b"),
            dates.kst_date(F.col("at"), None).alias("d"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want = int(datetime(2024, 3, 10, 7, 30, tzinfo=timezone.utc).timestamp())
    assert (row.s, row.ntz, row.inst, row.b) == (want, want, want, want // 600)
    assert row.d == date(2024, 3, 10)


def test_target_date_prefers_a_named_day_and_never_shifts_it():
    assert dates.target_date(None, END) == date(2024, 1, 11)
    assert dates.target_date({"partition_date": ""}, END, lag_days=1) == date(2024, 1, 10)
    assert dates.target_date({"partition_date": "2024-01-05"}, END, lag_days=1) == date(2024, 1, 5)
    with pytest.raises(ValueError):
        dates.target_date(None, END.replace(tzinfo=None))


def test_training_window_is_seven_days_with_free_ends():
    assert dates.training_window({}, END) == (date(2024, 1, 5), date(2024, 1, 11))
    named = dates.training_window({"events_start_date": "2024-01-01"}, END)
    assert named == (date(2024, 1, 1), date(2024, 1, 11))
    assert dates.training_window({"events_end_date": "2024-01-09"}, END)[1] == date(2024, 1, 9)


def test_window_is_inclusive(spark):
    df = spark.createDataFrame([(date(2024, 1, d),) for d in range(1, 6)], "dt date")
    kept = dates.in_date_window(df, date(2024, 1, 2), date(2024, 1, 4)).collect()
    assert sorted(r.dt.day for r in kept) == [2, 3, 4]
    with pytest.raises(ValueError):
        dates.in_date_window(df, date(2024, 1, 4), date(2024, 1, 2))
