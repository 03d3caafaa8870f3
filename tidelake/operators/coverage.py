"""Set questions about tables and days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(produced: DataFrame, required: DataFrame, on: Sequence[str]) -> DataFrame:
    """What is required but not produced, and the other way round.

    Both sides go through one aggregate instead of two set differences.
    """
    sides = produced.select(*on, F.lit("produced").alias("_side")).unionByName(
        required.select(*on, F.lit("required").alias("_side"))
    )
    seen = sides.groupBy(*on).agg(
        F.max(F.col("_side") == "produced").alias("_produced"),
        F.max(F.col("_side") == "required").alias("_required"),
    )
    return seen.where(F.col("_produced") != F.col("_required")).select(
        *on,
        F.when(F.col("_produced"), F.lit("not_required")).otherwise(F.lit("not_produced")).alias("gap"),
    )


def write_conflicts(a: DataFrame, b: DataFrame, on: Sequence[str] = ("table_name", "dt")) -> DataFrame:
    """Tables and days that two jobs would both write; must be empty."""
    return a.select(*on).intersect(b.select(*on))


def ready_dates(ledger: DataFrame, required: Sequence[str]) -> DataFrame:
    """Days on which every required table has a validated update, and since when."""
    needed = ledger.where(F.col("table_name").isin(*required) & F.col("validated_at").isNotNull())
    first = needed.groupBy("dt", "table_name").agg(F.min("validated_at").alias("validated_at"))
    return (
        first.groupBy("dt")
        .agg(F.count(F.lit(1)).alias("_tables"), F.max("validated_at").alias("ready_at"))
        .where(F.col("_tables") == len(set(required)))
        .select("dt", "ready_at")
    )


def window_gaps(inventory: DataFrame, required: Sequence[str], start: date, end: date) -> DataFrame:
    """Days of an inclusive window that a required table lacks.

    What is expected comes from the table names and the calendar, so it is short; the
    inventory shrinks to distinct tables and days first.
    """
    spark = inventory.sparkSession
    names = F.array(*[F.lit(t) for t in required])
    expected = (
        spark.range(1)
        .select(F.explode(names).alias("table_name"))
        .select("table_name", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("dt"))
    )
    present = inventory.where(
        F.col("dt").between(F.lit(start), F.lit(end)) & F.col("table_name").isin(*required)
    )
    return expected.join(present.select("table_name", "dt").distinct(), ["table_name", "dt"], "left_anti")
