"""One day from the lake into the raw layer: read, replace, validate, record."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.quality import enforce, validate_raw
from tidelake.session import scratch
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import (
    PartitionNotReadyError,
    day_manifest,
    load_id_of,
    read_days,
    read_partition,
)
from tidelake.sources.sink import backfill, replace_partition


@dataclass(frozen=True)
class RawTable:
    """Name, schema and key contract of a raw table."""

    name: str
    schema: T.StructType
    required: tuple[str, ...]
    key: str


def record(spark: SparkSession, ledger: str, table: str, loads: dict[date, str]) -> None:
    """Append validated loads to the run ledger; a load that is in it already is not repeated."""
    rows = spark.createDataFrame(
        [(table, day, load_id) for day, load_id in loads.items()], "table_name string, dt date, load_id string"
    )
    if SharedFs(spark, ledger).exists(ledger):
        rows = rows.join(read_ledger(spark, ledger), ["table_name", "dt", "load_id"], "left_anti")
    rows = rows.withColumn("validated_at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(ledger)


def load_day(
    spark: SparkSession,
    source: str,
    target: str,
    day: date,
    table: RawTable,
    ledger: str | None = None,
    require_success: bool = False,
    committed: bool = True,
) -> list[dict]:
    """Load and check one day. The checks run on a staged copy: a violated one raises
    while the target and the ledger still hold the load before.

    The day must be complete by its manifest. For a source without manifests pass
    ``committed=False`` and, if it leaves commit markers, ``require_success=True``.
    """
    files = read_partition(
        spark, source, day, schema=table.schema, require_success=require_success, committed=committed
    )
    load_id = load_id_of(spark, source, day, committed)
    staging = scratch(spark, f"staged-{table.name}")
    replace_partition(files, staging, day, schema=table.schema, overwrite=True)
    staged = read_partition(spark, staging, day, schema=table.schema)
    metrics = enforce(validate_raw(staged, files, table.required, table.key, day, content=True))
    replace_partition(staged, target, day, schema=table.schema, overwrite=True, load_id=load_id)
    SharedFs(spark, staging).delete(staging)
    if ledger:
        record(spark, ledger, table.name, {day: load_id})
    return metrics


def load_days(
    spark: SparkSession,
    source: str,
    target: str,
    days: list[date],
    table: RawTable,
    ledger: str,
    committed: bool = True,
) -> list[dict]:
    """The same for several days as one load, one check and one ledger entry set.

    Every requested day must be there and complete; otherwise nothing is loaded.
    """
    files = read_days(spark, source, days, schema=table.schema, committed=committed)
    loads = {day: load_id_of(spark, source, day, committed) for day in days}
    staging = scratch(spark, f"staged-{table.name}")
    backfill(files, staging, schema=table.schema)
    staged = read_days(spark, staging, days, schema=table.schema)
    rows = enforce(validate_raw(staged, files, table.required, table.key, content=True))
    backfill(staged, target, schema=table.schema, load_ids={str(day): load for day, load in loads.items()})
    SharedFs(spark, staging).delete(staging)
    record(spark, ledger, table.name, loads)
    return rows


def complete_days(spark: SparkSession, source: str, days: list[date]) -> tuple[list[date], list[str]]:
    """The days whose manifests and files are there, and why each of the others is not."""
    complete, reasons = [], []
    for day in days:
        try:
            day_manifest(spark, source, day)
            complete.append(day)
        except PartitionNotReadyError as lacking:
            reasons.append(str(lacking))
    return complete, reasons


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.parquet(ledger)
