"""Point-in-time join: for each left row the latest right row at or before it.

No pairs are built. Time is cut into buckets and both sides meet per (key, bucket),
so even a key that holds a third of the rows is spread over as many tasks as it has
buckets. What a bucket needs from earlier ones is a single seed row, found on a
summary with at most one row per key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.dates import epoch_seconds, time_bucket
from tidelake.functions.predicates import any_null, none_null

BUCKET_SECONDS = 10 * 60

_SEED, _RIGHT, _LEFT = 0, 1, 2


def pit_join(
    spine: DataFrame,
    view: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    *,
    ts: str = "event_timestamp",
    view_ts: str = "event_timestamp",
    prefix: str = "",
    bucket_seconds: int = BUCKET_SECONDS,
    span: Span | None = None,
    origin: DataFrame | None = None,
) -> DataFrame:
    """Left as-of join. Adds ``<prefix>event_timestamp`` and the prefixed features.

    The view must be unique in (keys, view_ts). There is no time limit: the latest
    earlier row wins however old it is. Every spine row comes out exactly once.

    With the ``span`` of the spine a long history stays cheap: later rows of the view
    are not read, and earlier ones count as one bucket, which the map tasks reduce to
    the latest row of each key.

    ``origin`` is a frame with the keys and times of the spine, such as the stored one that
    a chain of joins began with; seeds are then found on it, and the spine is used once.
    """
    keys = list(keys)
    # rows without a key match nothing; a hash spreads them over the tasks
    bucket = F.when(any_null(keys), F.xxhash64(ts, *spine.columns)).otherwise(
        time_bucket(spine, ts, bucket_seconds)
    )
    payload = [c for c in spine.columns if c not in keys]
    left = spine.select(
        *keys,
        bucket.alias("_bucket"),
        F.lit(_LEFT).alias("_side"),
        F.col(ts).alias("_at"),
        *[F.col(c).alias(f"_left_{c}") for c in payload],
    )
    found = F.struct(F.col(view_ts).alias("_view_ts"), *features)
    usable = view.where(none_null([*keys, view_ts]))
    view_bucket, near = time_bucket(view, view_ts, bucket_seconds), F.lit(True)
    if span is not None:
        kind = view.schema[view_ts].dataType
        usable = usable.where(F.col(view_ts) <= F.lit(span.last).cast(kind))
        view_bucket = F.greatest(view_bucket, F.lit(span.first_second // bucket_seconds - 1))
        one_bucket = F.make_dt_interval(secs=F.lit(bucket_seconds))
        near = F.col("_at") >= F.lit(span.first).cast(kind) - one_bucket
    right = usable.select(
        *keys,
        view_bucket.alias("_bucket"),
        F.lit(_RIGHT).alias("_side"),
        F.col(view_ts).alias("_at"),
        found.alias("_found"),
    )
    seeds = _seeds(spine if origin is None else origin, right, keys, ts, bucket_seconds)
    merged = left.unionByName(right.where(near), allowMissingColumns=True).unionByName(
        seeds, allowMissingColumns=True
    )
    # a seed is older than anything in its bucket; at equal times a feature row
    # comes before the spine row that may use it
    order = [(F.col("_side") != _SEED), F.col("_at"), F.col("_side")]
    window = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = merged.withColumn("_last", F.last("_found", ignorenulls=True).over(window)).where(
        F.col("_side") == _LEFT
    )
    return matched.select(
        *[F.col(c) if c in keys else F.col(f"_left_{c}").alias(c) for c in spine.columns],
        F.col("_last._view_ts").alias(f"{prefix}event_timestamp" if prefix else "feature_timestamp"),
        *[F.col(f"_last.{c}").alias(f"{prefix}{c}") for c in features],
    )


def _seeds(
    spine: DataFrame, right: DataFrame, keys: list[str], ts: str, bucket_seconds: int
) -> DataFrame:
    """For each (key, bucket) of the spine the last right row of an earlier bucket."""
    wanted = (
        spine.where(none_null(keys))
        .select(*keys, time_bucket(spine, ts, bucket_seconds).alias("_bucket"))
        .distinct()
        .withColumn("_wanted", F.lit(True))
    )
    last = right.groupBy(*keys, "_bucket").agg(F.max_by("_found", "_at").alias("_found"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
    return (
        wanted.unionByName(last, allowMissingColumns=True)
        .withColumn("_seed", F.last("_found", ignorenulls=True).over(earlier))
        .where(F.col("_wanted") & F.col("_seed").isNotNull())
        .select(
            *keys,
            "_bucket",
            F.lit(_SEED).alias("_side"),
            F.col("_seed").alias("_found"),
        )
    )


@dataclass(frozen=True)
class Span:
    """Earliest and latest event time of a spine, as text in the session's zone."""

    first: str
    last: str
    first_second: int


def span_of(spine: DataFrame, ts: str = "event_timestamp") -> Span | None:
    """One scan of the time column; NULL for a spine without rows."""
    row = spine.agg(
        F.min(ts).cast("string").alias("first"),
        F.max(ts).cast("string").alias("last"),
        F.min(epoch_seconds(spine, ts)).alias("first_second"),
    ).first()
    return Span(row.first, row.last, row.first_second) if row.first is not None else None


def with_static(spine: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join with a table that has one row per key, a column or several.

    No hint: Spark broadcasts the table when its size allows, and otherwise shuffles
    and splits hot keys at run time.
    """
    return spine.join(dim, [key] if isinstance(key, str) else list(key), "left")
