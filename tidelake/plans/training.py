"""Point-in-time training set from the spine and the feature views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.dates import in_date_window
from tidelake.operators.asof import BUCKET_SECONDS, pit_join, span_of, with_static
from tidelake.session import stored


TIME = "event_timestamp"


@dataclass(frozen=True)
class View:
    """A feature table as the training set sees it."""

    rows: DataFrame
    key: str
    features: Sequence[str]
    prefix: str
    bucket_seconds: int = BUCKET_SECONDS


def training_dataset(
    spine: DataFrame,
    views: Sequence[View],
    dims: Sequence[tuple[DataFrame, str]],
    start: date,
    end: date,
) -> DataFrame:
    """Spine rows of the window with the features known at their time.

    The spine of the window and what each view knew by its end are derived once and stored,
    with the columns that are asked for alone. Every view adds one exchange by its own
    key, and its seeds are found on the stored spine, not on the joins before it; rows never
    multiply. The earliest and latest event time of the window decide which rows of a
    view are read. Check the spine with ``require_positives`` before training on it.
    """
    origin = rows = stored(in_date_window(spine, start, end), "spine")
    span = span_of(origin)
    for view in views:
        known = view.rows.select(view.key, TIME, *view.features)
        if span is not None:
            known = known.where(F.col(TIME) <= F.lit(span.last).cast(known.schema[TIME].dataType))
        rows = pit_join(
            rows,
            stored(known, "view"),
            [view.key],
            view.features,
            prefix=view.prefix,
            bucket_seconds=view.bucket_seconds,
            span=span,
            origin=origin,
        )
    for dim, key in dims:
        rows = with_static(rows, dim, key)
    return rows
