"""Idempotent partition writes.

A day is written beside the table first, gets a manifest of its files and is swapped in as
one folder, so readers see the old day or the new one. Nothing else in the table is touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.predicates import messages
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import CANONICAL, commit_folder, partition_path
from tidelake.sources.schemas import assert_schema


class PartitionExistsError(FileExistsError):
    """The day is there and the caller did not allow replacing it."""


class EmptyPartitionError(ValueError):
    """An empty day would wipe the old one without a trace."""


class ForeignRowsError(ValueError):
    """Rows of another day were about to be filed under this one."""


class LayerError(ValueError):
    """Raw and feature layers must not share a location."""


def assert_layers_apart(raw: str, feature: str) -> None:
    """Reject a job whose feature layer lies in, on or around its raw layer."""
    a, b = raw.rstrip("/") + "/", feature.rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise LayerError(f"raw and feature layers overlap: {raw} and {feature}")


def layers_overlap(raw: Column, feature: Column) -> Column:
    """The same question about many jobs at once, as an expression."""
    a, b = (F.concat(F.rtrim(c, F.lit("/")), F.lit("/")) for c in (raw, feature))
    return F.startswith(a, b) | F.startswith(b, a)


def replace_partition(
    df: DataFrame,
    base: str,
    dt: date | str,
    *,
    schema: T.StructType | None = None,
    overwrite: bool = False,
    rebalance: bool = False,
    load_id: str | None = None,
) -> int:
    """Replace exactly one day and return its row count; running twice equals once.

    ``rebalance`` evens out the files of a day that was filtered from many tasks; a day
    read from its own partition does not need it.
    """
    spark = df.sparkSession
    fs = SharedFs(spark, base)
    target = partition_path(base, dt)
    if fs.exists(target) and not overwrite:
        raise PartitionExistsError(f"{target} exists; pass overwrite=True to replace it")
    if schema is not None:
        df = assert_schema(df, schema)
    foreign = (
        F.count_if(~F.col("dt").eqNullSafe(F.lit(str(dt)).cast("date")))
        if "dt" in df.columns
        else F.lit(0)
    )
    seen = Observation()
    if rebalance:
        df = df.hint("rebalance")
    # counted in the writing tasks themselves, so a repeated shuffle stage adds nothing
    body = df.observe(seen, F.count(F.lit(1)).alias("rows"), foreign.alias("foreign")).drop("dt")
    run = uuid.uuid4().hex
    staged = f"{base}/_staging/{run}"
    body.write.parquet(staged)
    counts = seen.get
    if counts["rows"] == 0 or counts["foreign"]:
        fs.delete(staged)
        if counts["rows"] == 0:
            raise EmptyPartitionError(f"no rows for {target}")
        raise ForeignRowsError(f"{counts['foreign']} rows of other days for {target}")
    commit_folder(spark, staged, counts["rows"], load_id or run)
    _swap(fs, staged, target, f"{base}/_replaced/{run}")
    return counts["rows"]


def _swap(fs: SharedFs, staged: str, target: str, aside: str) -> None:
    had_old = fs.exists(target)
    if had_old:
        fs.rename(target, aside)
    try:
        fs.rename(staged, target)
    except Exception:
        if had_old:
            fs.rename(aside, target)
        raise
    if had_old:
        fs.delete(aside)


def replace_date(
    df: DataFrame, base: str, dt: date | str, *, schema: T.StructType | None = None
) -> int:
    """Delete-and-insert of one target date of a feature table, as one swap."""
    return replace_partition(df, base, dt, schema=schema, overwrite=True)


def backfill(
    df: DataFrame, base: str, *, schema: T.StructType | None = None, load_ids: Mapping[str, str] | None = None
) -> None:
    """Write a many-day source: its days are replaced, days absent from it are kept.

    Rebalancing by day gives few, even files and splits a day too big for one task. All days
    are staged and counted before the first is swapped in; the swap is atomic per day.
    """
    spark = df.sparkSession
    if schema is not None:
        df = assert_schema(df, schema)
    checked = F.when(
        F.col("dt").isNull(), F.raise_error(F.lit("row without a partition day"))
    ).otherwise(F.col("dt"))
    run = uuid.uuid4().hex
    staged = f"{base}/_staging/{run}"
    df.withColumn("dt", checked).hint("rebalance", "dt").write.partitionBy("dt").parquet(staged)
    fs = SharedFs(spark, base)
    days = [n.removeprefix("dt=") for n in fs.names(staged) if n.startswith("dt=")]
    if days:
        paths = [f"{partition_path(staged, d)}/{CANONICAL}" for d in days]
        rows = spark.read.option("basePath", staged).parquet(*paths).groupBy(F.col("dt").cast("string")).count()
        counts = dict(rows.collect())  # one row a day
        for day in days:
            commit_folder(spark, partition_path(staged, day), counts[day], (load_ids or {}).get(day, run))
        for day in days:
            _swap(fs, partition_path(staged, day), partition_path(base, day), f"{base}/_replaced/{run}-{day}")
    fs.delete(staged)


def tag_quarantine(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of the rules a row breaks."""
    return df.withColumn(
        "reasons", messages(*[(F.coalesce(cond, F.lit(True)), n) for n, cond in rules.items()])
    )


def split_quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their reasons."""
    return split_tagged(tag_quarantine(df, rules))


def split_tagged(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two halves of a frame that has its reasons already."""
    good = tagged.where(F.size("reasons") == 0).drop("reasons")
    return good, tagged.where(F.size("reasons") > 0)


def write_quarantine(bad: DataFrame, base: str, day: date | None = None) -> None:
    """Bad rows as JSON lines under their day.

    A named day is written beside the others and swapped in as a whole; if none of its rows
    is bad its quarantine goes.
    """
    rows = bad.hint("rebalance", "dt").write.partitionBy("dt")
    if day is None:
        rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(base)
        return
    fs, run = SharedFs(bad.sparkSession, base), uuid.uuid4().hex
    staged, target = f"{base}/_staging/{run}", f"{base}/dt={day}"
    rows.json(staged)
    if fs.exists(f"{staged}/dt={day}"):
        _swap(fs, f"{staged}/dt={day}", target, f"{base}/_replaced/{run}")
    else:
        fs.delete(target)
    fs.delete(staged)
