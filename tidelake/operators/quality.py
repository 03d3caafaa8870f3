"""Data-quality checks and gates over daily partitions.

Checks come in two forms with one body: of a named day, and of every day at once
with ``dt`` as the group. Distinct counts dedupe inside the map tasks first, so a
key repeated for a third of the rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.dates import kst_date
from tidelake.functions.predicates import any_null, messages, none_null
from tidelake.operators.ranking import ordered_limit

OK = "ok"
# Event kinds a complete log shows, and the quarantine limit.
REQUIRED_EVENTS = ("impression", "click", "view")
MAX_QUARANTINE_RATIO = 0.5
#: Blocks of 32,768 keys whose bitmaps go to all tasks: 8 MB at most.
KNOWN_BLOCKS = 2_048


class ValidationError(ValueError):
    """At least one check of at least one partition failed."""


def row_count() -> Column:
    return F.count(F.lit(1))


def dup_count(*keys: str) -> Column:
    """Surplus rows: rows with a full key minus distinct keys."""
    return F.count_if(none_null(keys)) - F.count_distinct(*keys)


def content_sum(columns: Sequence[str]) -> Column:
    """Order-free checksum of whole rows: the sum of their hashes, as a partial aggregate.

    Which values are NULL goes into a row's hash too, since a hash passes over them.
    """
    gaps = [F.col(c).isNull() for c in columns]
    return F.coalesce(F.sum(F.xxhash64(*columns, *gaps).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def _of_day(df: DataFrame, day: date | None) -> tuple[DataFrame, list[str]]:
    if day is None:
        return df, ["dt"]
    return df.where(F.col("dt") == F.lit(day)), []


def _failed(cond: Column, message: Column) -> Column:
    return F.when(cond, F.concat(F.lit("validation failed: "), message)).otherwise(F.lit(OK))


def validate_raw(
    loaded: DataFrame,
    source: DataFrame,
    required: Sequence[str],
    key: str,
    day: date | None = None,
    content: bool = False,
) -> DataFrame:
    """Four checks of a load: not empty, as many rows as the source, no NULL in a
    required column, no duplicate key. One metrics row per day; one row for a named
    day even if nothing was loaded. ``content`` adds a fifth: the rows of both sides are
    the same, by an order-free checksum of all columns but the day, taken in the same
    aggregates as the counts."""
    loaded, by = _of_day(loaded, day)
    source, _ = _of_day(source, day)
    body = [c for c in loaded.columns if c != "dt"]
    left = loaded.groupBy(*by).agg(
        row_count().alias("row_count"),
        F.count_if(any_null(required)).alias("null_key_count"),
        dup_count(key).alias("duplicate_key_count"),
        *([content_sum(body).alias("_loaded")] if content else []),
    )
    right = source.groupBy(*by).agg(
        row_count().alias("source_row_count"), *([content_sum(body).alias("_source")] if content else [])
    )
    counts = ["row_count", "source_row_count", "null_key_count", "duplicate_key_count"]
    both = left.unionByName(right, allowMissingColumns=True).groupBy(*by)
    sums = [F.max(c).alias(c) for c in ("_loaded", "_source")] if content else []
    metrics = both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], *sums)
    differs = ~F.col("_loaded").eqNullSafe(F.col("_source"))
    extra = [_failed(differs, F.lit("content differs from the source")).alias("content_check")] if content else []
    day_column = F.col("dt") if day is None else F.lit(day).alias("dt")
    n, s, nulls, dups = (F.col(c) for c in counts)
    return metrics.select(
        day_column,
        *counts,
        _failed(n == 0, F.lit("partition is empty")).alias("non_empty_check"),
        _failed(
            n != s, F.format_string("row count mismatch loaded=%d source=%d", n, s)
        ).alias("row_count_check"),
        _failed(
            nulls > 0, F.format_string("%d rows with NULL required columns", nulls)
        ).alias("required_columns_check"),
        _failed(
            dups > 0, F.format_string(f"%d duplicate {key} rows", dups)
        ).alias("unique_key_check"),
        *extra,
    )


def validate_feature(
    df: DataFrame, keys: Sequence[str], ts: str = "event_timestamp", day: date | None = None
) -> DataFrame:
    """Feature checks: not empty, key and time present, (key, time) unique."""
    df, by = _of_day(df, day)
    columns = [*keys, ts]
    metrics = df.groupBy(*by).agg(
        row_count().alias("row_count"),
        F.count_if(any_null(columns)).alias("null_key_count"),
        dup_count(*columns).alias("duplicate_key_count"),
    )
    day_column = F.col("dt") if day is None else F.lit(day).alias("dt")
    n, nulls, dups = F.col("row_count"), F.col("null_key_count"), F.col("duplicate_key_count")
    return metrics.select(
        day_column,
        "row_count",
        "null_key_count",
        "duplicate_key_count",
        _failed(n == 0, F.lit("partition is empty")).alias("non_empty_check"),
        _failed(
            nulls > 0, F.format_string("%d rows with NULL key columns", nulls)
        ).alias("required_columns_check"),
        _failed(
            dups > 0, F.format_string("%d duplicate key rows", dups)
        ).alias("unique_key_check"),
    )


def enforce(metrics: DataFrame) -> list[dict]:
    """Raise with every violated check of every partition; return the metrics rows.

    The frame has one row per validated partition, so collecting it is bounded. The
    decision is taken here and not by an error inside the query, which an optimizer
    may drop together with an unused column.
    """
    rows = [r.asDict() for r in metrics.collect()]
    violations = [
        f"dt={r.get('dt')} {value}"
        for r in rows
        for name, value in r.items()
        if name.endswith("_check") and value != OK
    ]
    violations += [f"dt={r.get('dt')} {e}" for r in rows for e in r.get("errors") or []]
    if violations:
        raise ValidationError("; ".join(violations))
    return rows


def duplicate_keys(df: DataFrame, key: str, by: str = "dt") -> DataFrame:
    """Duplicate count per day; NULL keys are not counted."""
    return df.groupBy(by).agg(dup_count(key).alias("duplicate_key_count"))


def dup_keys_global(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once anywhere in the table."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(row_count().alias("copies"))
    return counted.where(F.col("copies") > 1)


def _known_blocks(dim: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bitmap) of the whole numbers a table has as keys: its fullest blocks of 32,768."""
    number = F.col(key).cast("long")
    keyed = dim.where(F.col(key).isNotNull()).select(
        F.bitmap_bucket_number(number).alias("_block"), F.bitmap_bit_position(number).alias("_bit")
    )
    built = keyed.groupBy("_block").agg(
        F.bitmap_construct_agg("_bit").alias("_bitmap"), F.count(F.lit(1)).alias("_keys")
    )
    return ordered_limit(built, [F.desc("_keys"), F.col("_block")], blocks).select("_block", "_bitmap")


def bit_set(bitmap: Column, position: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.bit_get(octet.cast("int"), F.pmod(position, F.lit(8)).cast("int")) == 1


def suspects(fact: DataFrame, dim: DataFrame, key: str, blocks: int = KNOWN_BLOCKS) -> DataFrame:
    """Rows whose key a bitmap of the dimension's keys does not show to be there.

    Bitmaps of at most ``blocks`` blocks (4 KB each) go to all tasks; a key outside them
    stays a suspect. Only whole numbers have a bitmap; of other keys all rows are suspects.
    """
    rows = fact.where(F.col(key).isNotNull())
    if not all(isinstance(df.schema[key].dataType, T.IntegralType) for df in (fact, dim)):
        return rows
    number = F.col(key).cast("long")
    known = F.broadcast(_known_blocks(dim, key, blocks))
    met = rows.join(known, F.bitmap_bucket_number(number) == F.col("_block"), "left")
    there = F.coalesce(bit_set(F.col("_bitmap"), F.bitmap_bit_position(number)), F.lit(False))
    return met.where(~there).select(*[F.col(c) for c in fact.columns])


def orphans(fact: DataFrame, dim: DataFrame, key: str, by: Sequence[str] = ("dt",)) -> DataFrame:
    """Key values without a dimension row, with their row counts.

    A bitmap screens the rows in their own tasks, so only suspects are shuffled. They are
    counted per key before the exact anti join, so a hot key joins once per group.
    """
    rows = suspects(fact.select(*by, key), dim, key)
    counted = rows.groupBy(*by, key).agg(row_count().alias("rows"))
    return counted.join(dim.select(key), key, "left_anti").select(*by, key, "rows")


def event_type_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("dt", "event_type").agg(row_count().alias("events"))


def ctr(log: DataFrame, by: Sequence[str] = ("dt",)) -> DataFrame:
    """Clicks, impressions and their ratio, NULL without impressions."""
    clicks = F.count_if(F.col("event_type") == "click")
    impressions = F.count_if(F.col("event_type") == "impression")
    return log.groupBy(*by).agg(
        clicks.alias("clicks"),
        impressions.alias("impressions"),
        F.try_divide(clicks, impressions).alias("ctr"),
    )


def outside_partition(ts: str = "event_timestamp", dt: str = "dt") -> Column:
    return kst_date(F.col(ts)) != F.col(dt)


def out_of_partition(df: DataFrame) -> DataFrame:
    """Rows per partition whose event time lies outside its local day."""
    return df.groupBy("dt").agg(F.count_if(outside_partition()).alias("out_of_partition_rows"))


def quarantine_ratio(
    tagged: DataFrame, limit: float = MAX_QUARANTINE_RATIO, by: Sequence[str] = ("dt",)
) -> DataFrame:
    """Share of rows with reasons, and whether it stays within the limit."""
    bad = F.count_if(F.size("reasons") > 0)
    return tagged.groupBy(*by).agg(
        row_count().alias("row_count"),
        bad.alias("bad_rows"),
        (bad / row_count()).alias("bad_ratio"),
        (bad <= row_count() * F.lit(limit)).alias("within_limit"),
    )


def action_log_quality(
    log: DataFrame,
    videos: DataFrame,
    users: DataFrame,
    expected_model: str,
    day: date | None = None,
) -> DataFrame:
    """Quality report with ``errors``; an empty list is a pass."""
    log, by = _of_day(log, day)
    kind = F.col("event_type")
    base = log.groupBy(*by).agg(
        row_count().alias("row_count"),
        F.count_if(kind == "impression").alias("impressions"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "like").alias("likes"),
        F.count_if(~F.col("llm_model").eqNullSafe(expected_model)).alias("model_mismatch_rows"),
        F.count_if(F.col("video_id").isNull()).alias("null_video_rows"),
        F.count_if(F.col("user_id").isNull()).alias("null_user_rows"),
        F.count_if(outside_partition()).alias("out_of_partition_rows"),
    )
    parts = [base]
    for dim, key, name in ((videos, "video_id", "video"), (users, "user_id", "user")):
        missing = orphans(log, dim, key, by)
        parts.append(missing.groupBy(*by).agg(F.sum("rows").alias(f"orphan_{name}_rows")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    counts = [c for c in union.columns if c not in by]
    report = union.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    c = {name: F.col(name) for name in counts}
    seen = {"impression": c["impressions"], "click": c["clicks"], "view": c["views"]}
    errors = messages(
        (c["row_count"] == 0, "partition is empty"),
        *[(seen[t] == 0, f"no {t} event") for t in REQUIRED_EVENTS],
        (c["clicks"] != c["views"], "click and view counts differ"),
        (c["model_mismatch_rows"] > 0, "unexpected model"),
        (c["orphan_video_rows"] + c["null_video_rows"] > 0, "video outside the snapshot"),
        (c["orphan_user_rows"] + c["null_user_rows"] > 0, "user outside the sample"),
        (c["out_of_partition_rows"] > 0, "event time outside the partition"),
    )
    day_column = F.col("dt") if day is None else F.lit(day).alias("dt")
    return report.select(
        day_column,
        *counts,
        F.try_divide(c["clicks"], c["impressions"]).alias("ctr"),
        errors.alias("errors"),
    )
