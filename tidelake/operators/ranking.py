"""Top-n, latest-row and first-n reports.

Each of them keeps only its survivors per task before the shuffle, so a group that
holds a third of the table costs no task more than its own slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT_LIMIT = 200


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of each group; ``order`` must end in a unique column."""
    if isinstance(n, bool) or n < 1:
        raise ValueError(f"n must be at least 1: {n}")
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def trending_snapshot(
    df: DataFrame, region: str, order: Sequence[Column], max_results: int = SNAPSHOT_LIMIT
) -> DataFrame:
    """One region's daily snapshot, at most 200 rows a day."""
    if isinstance(max_results, bool) or not 1 <= max_results <= SNAPSHOT_LIMIT:
        raise ValueError(f"max_results must be between 1 and {SNAPSHOT_LIMIT}: {max_results}")
    return top_n(df.where(F.col("region") == region), ["region", "dt"], order, max_results)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Newest row of each key, as a partial aggregate rather than a window."""
    row = F.struct(*df.columns)
    newest = F.max_by(row, F.struct(ts, *tiebreak)).alias("_row")
    return df.groupBy(*keys).agg(newest).select("_row.*").select(*df.columns)


def ordered_limit(df: DataFrame, keys: Sequence[str | Column], n: int) -> DataFrame:
    """Global order and limit; each task sends at most ``n`` rows."""
    return df.orderBy(*keys).limit(n)


def first_n_users(users: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest user ids, a repeatable sample for trial runs."""
    if isinstance(n, bool) or n < 1:
        raise ValueError(f"n must be at least 1: {n}")
    return ordered_limit(users.select("user_id").distinct(), ["user_id"], n)
