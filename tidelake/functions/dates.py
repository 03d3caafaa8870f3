"""Local-day arithmetic. A partition day is a calendar day in Asia/Seoul."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The zone of the partition days, and its offset since the zone last
# changed its clocks.
LOCAL_ZONE = "Asia/Seoul"
STEADY_SINCE, STEADY_HOURS = "1989-01-01 00:00:00", 9

DAY_SECONDS = 86_400


def kst_date(ts: Column, source_zone: str | None = "UTC") -> Column:
    """Local day of an event time kept as a UTC wall clock (TIMESTAMP_NTZ).

    For an instant (TIMESTAMP) pass ``source_zone=None``: the session zone is
    then the one the wall clock is read in.
    """
    if source_zone != "UTC":
        source = F.lit(source_zone) if source_zone else None
        return F.to_date(F.convert_timezone(source, F.lit(LOCAL_ZONE), ts))
    # adding hours costs a fraction of a zone lookup per row
    shifted = ts + F.make_dt_interval(hours=F.lit(STEADY_HOURS))
    looked_up = F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), ts)
    is_steady = ts >= F.lit(STEADY_SINCE).cast("timestamp_ntz")
    return F.when(is_steady, F.to_date(shifted)).otherwise(F.to_date(looked_up))


def kst_midnight(day: Column) -> Column:
    """UTC wall clock at which a local day starts."""
    return F.convert_timezone(F.lit(LOCAL_ZONE), F.lit("UTC"), day.cast("timestamp_ntz"))


def instant(ts: Column) -> Column:
    """UTC wall clock as an instant, the type watermarks ask for, in any session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def dt_compact(day: Column) -> Column:
    """Partition id ``YYYYMMDD``."""
    return F.date_format(day, "yyyyMMdd")


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    ts = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_seconds(ts)
    return (
        F.unix_date(F.to_date(ts)).cast("long") * DAY_SECONDS
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def time_bucket(df: DataFrame, name: str, seconds: int) -> Column:
    """Number of the fixed-length bucket that holds an event time."""
    return F.floor(epoch_seconds(df, name) / F.lit(seconds)).cast("long")


def in_date_window(df: DataFrame, start: date, end: date, column: str = "dt") -> DataFrame:
    """Rows of the inclusive window; literals, so partitions are pruned."""
    if start > end:
        raise ValueError(f"window starts after it ends: {start} > {end}")
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def _local_day(instant: datetime) -> date:
    if instant.tzinfo is None:
        raise ValueError("the interval end needs a time zone")
    return instant.astimezone(ZoneInfo(LOCAL_ZONE)).date()


def target_date(
    conf: Mapping[str, str] | None,
    interval_end: datetime,
    lag_days: int = 0,
    key: str = "partition_date",
) -> date:
    """Day a run works on: a named day as it is, else the local day of the interval
    end, ``lag_days`` earlier. The lag never shifts a named day."""
    named = (conf or {}).get(key)
    if named:
        return date.fromisoformat(named)
    return _local_day(interval_end) - timedelta(days=lag_days)


def target_day(named: Column, interval_end: Column, lag_days: Column) -> Column:
    """The same for many runs at once, from UTC wall clocks: a named day as it is, else the
    local day of the interval end less the lag. An empty name is none."""
    given = F.when(F.length(named) > 0, named).cast("date")
    return F.coalesce(given, F.date_sub(kst_date(interval_end), lag_days))


def training_window(
    conf: Mapping[str, str] | None, interval_end: datetime, days: int = 7
) -> tuple[date, date]:
    """Inclusive training window; either end may be named on its own."""
    conf = conf or {}
    last = _local_day(interval_end)
    start = conf.get("events_start_date")
    end = conf.get("events_end_date")
    return (
        date.fromisoformat(start) if start else last - timedelta(days=days - 1),
        date.fromisoformat(end) if end else last,
    )
