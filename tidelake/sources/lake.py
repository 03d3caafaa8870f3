"""Canonical scans of ``<base>/dt=YYYY-MM-DD/part-*.parquet``.

Only files matching the canonical pattern directly inside a partition are read:
left-over staging copies and shard folders never reach a result.

A day may carry a commit manifest, written after its files: the id of the load, its rows
and the names and lengths of its files. A committed scan reads exactly these files, and
refuses a day without a manifest or with a file that is missing or has another length.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from datetime import date, timedelta
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.sources.fs import SharedFs

CANONICAL = "part-*.parquet"
SUCCESS = "_SUCCESS"
MANIFEST = "_manifest.json"


class PartitionNotReadyError(FileNotFoundError):
    """The partition has no commit marker or not the files it names, so it may be half written."""


def partition_path(base: str, dt: date | str) -> str:
    return f"{base}/dt={dt}"


def commit_folder(spark: SparkSession, folder: str, rows: int, load_id: str | None = None) -> dict:
    """Name the canonical files that are in a folder now as one load.

    An old manifest goes first, so a reader in between finds the day not ready.
    """
    fs = SharedFs(spark, folder)
    files = {name: size for name, size in sorted(fs.sizes(folder).items()) if fnmatch(name, CANONICAL)}
    found = {"load_id": load_id or uuid.uuid4().hex, "rows": rows, "files": files}
    fs.delete(f"{folder}/{MANIFEST}")
    fs.create_text(f"{folder}/{MANIFEST}", json.dumps(found))
    return found


def commit_day(spark: SparkSession, base: str, dt: date | str, load_id: str | None = None) -> dict:
    """The same for a day whose files another writer has put there."""
    folder = partition_path(base, dt)
    return commit_folder(spark, folder, spark.read.parquet(f"{folder}/{CANONICAL}").count(), load_id)


def day_manifest(spark: SparkSession, base: str, dt: date | str) -> dict:
    """The manifest of a day all of whose files are there."""
    fs, folder = SharedFs(spark, base), partition_path(base, dt)
    if not fs.exists(f"{folder}/{MANIFEST}"):
        raise PartitionNotReadyError(f"no commit manifest in {folder}")
    found = json.loads(fs.read_text(f"{folder}/{MANIFEST}"))
    there = fs.sizes(folder)
    lacking = [name for name, size in found["files"].items() if there.get(name) != size]
    if lacking:
        raise PartitionNotReadyError(f"{folder} lacks {', '.join(lacking)} of load {found['load_id']}")
    return found


def load_id_of(spark: SparkSession, base: str, dt: date | str, committed: bool = True) -> str:
    """What tells one load of a day from another: its manifest's id, or the listing of its files."""
    if committed:
        return day_manifest(spark, base, dt)["load_id"]
    there = SharedFs(spark, base).sizes(partition_path(base, dt))
    named = json.dumps(sorted((n, size) for n, size in there.items() if fnmatch(n, CANONICAL)))
    return hashlib.sha256(named.encode()).hexdigest()[:32]


def _files(spark: SparkSession, base: str, dt: date | str, pattern: str, committed: bool) -> list[str]:
    folder = partition_path(base, dt)
    if not committed:
        return [f"{folder}/{pattern}"]
    return [f"{folder}/{name}" for name in day_manifest(spark, base, dt)["files"]]


def _with_dt(schema: T.StructType) -> T.StructType:
    """The declared columns, all nullable, and the day injected from the path."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields if f.name != "dt"]
    return T.StructType([*fields, T.StructField("dt", T.DateType(), True)])


def _scan(spark: SparkSession, base: str, paths: list[str], schema: T.StructType | None) -> DataFrame:
    reader = spark.read.option("basePath", base)
    if schema is not None:
        reader = reader.schema(_with_dt(schema))
    return reader.parquet(*paths)


def read_partition(
    spark: SparkSession,
    base: str,
    dt: date | str,
    pattern: str = CANONICAL,
    schema: T.StructType | None = None,
    require_success: bool = False,
    committed: bool = False,
) -> DataFrame:
    """One day, with ``dt`` as DATE from the path; ``committed`` reads the files of its manifest."""
    folder = partition_path(base, dt)
    if require_success and not SharedFs(spark, base).exists(f"{folder}/{SUCCESS}"):
        raise PartitionNotReadyError(f"no commit marker in {folder}")
    return _scan(spark, base, _files(spark, base, dt, pattern, committed), schema)


def read_days(
    spark: SparkSession,
    base: str,
    days: Iterable[date],
    pattern: str = CANONICAL,
    schema: T.StructType | None = None,
    missing_ok: bool = False,
    committed: bool = False,
) -> DataFrame:
    """The named days. A day without a partition is an error unless it may be missing;
    with ``committed`` so is a day that is there and not complete."""
    present = set(partitions(spark, base))
    named = sorted(set(map(str, days)))
    wanted = [d for d in named if d in present]
    if not missing_ok and len(wanted) < len(named):
        raise FileNotFoundError(f"not in {base}: {', '.join(d for d in named if d not in present)}")
    if not wanted:
        raise FileNotFoundError(f"none of the days is in {base}")
    return _scan(spark, base, [f for d in wanted for f in _files(spark, base, d, pattern, committed)], schema)


def days_between(start: date, end: date) -> list[date]:
    """All days of an inclusive window."""
    return [start + timedelta(days=n) for n in range((end - start).days + 1)]


def read_lake(
    spark: SparkSession,
    base: str,
    pattern: str = CANONICAL,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Every day of the table; filters on ``dt`` prune partitions."""
    return _scan(spark, base, [f"{base}/dt=*/{pattern}"], schema)


def source_view(
    spark: SparkSession, base: str, dt: date | str, name: str = "source_files", **scan
) -> DataFrame:
    """The same canonical files as a temporary view, for the checks after a load."""
    df = read_partition(spark, base, dt, **scan)
    df.createOrReplaceTempView(name)
    return df


def partitions(spark: SparkSession, base: str) -> list[str]:
    """Days that have a folder, from the directory listing alone."""
    return [n.removeprefix("dt=") for n in SharedFs(spark, base).names(base) if n.startswith("dt=")]


def missing_partitions(inventory: DataFrame, start: date, end: date, column: str = "dt") -> DataFrame:
    """Expected days of the window without an entry in the inventory."""
    spark = inventory.sparkSession
    expected = spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias(column)
    )
    present = inventory.where(F.col(column).between(F.lit(start), F.lit(end)))
    return expected.join(present.select(column).distinct(), column, "left_anti")
