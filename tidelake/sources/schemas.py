"""Declared table schemas and the check that holds writers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaDriftError(ValueError):
    """A frame does not have exactly the declared columns and types."""


def _fields(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


# Raw columns may hold NULLs until the load has been validated.
ACTION_LOG = _fields(
    ("event_id", T.LongType(), True),
    ("user_id", T.LongType(), True),
    ("video_id", T.LongType(), True),
    ("event_timestamp", T.TimestampNTZType(), True),
    ("event_type", T.StringType(), True),
    ("llm_model", T.StringType(), True),
    ("value", T.DoubleType(), True),
)

USER_DYNAMIC_FEATURE = _fields(
    ("user_id", T.LongType(), False),
    ("event_timestamp", T.TimestampNTZType(), False),
    ("impressions", T.LongType(), False),
    ("clicks", T.LongType(), False),
    ("views", T.LongType(), False),
    ("likes", T.LongType(), False),
    ("ctr", T.DoubleType(), True),
    ("distinct_videos", T.LongType(), False),
    ("top_category", T.StringType(), True),
    ("last_event", T.TimestampNTZType(), False),
)

VIDEO_FEATURE = _fields(
    ("video_id", T.LongType(), False),
    ("event_timestamp", T.TimestampNTZType(), False),
    ("category", T.StringType(), True),
    ("size", T.IntegerType(), True),
    ("trend_rank", T.IntegerType(), False),
    ("price_rank", T.IntegerType(), True),
)

TRAINING_ENTITY = _fields(
    ("event_id", T.LongType(), False),
    ("user_id", T.LongType(), False),
    ("video_id", T.LongType(), False),
    ("event_timestamp", T.TimestampNTZType(), False),
    ("label", T.IntegerType(), False),
)


def assert_schema(df: DataFrame, declared: T.StructType, partition: str = "dt") -> DataFrame:
    """The frame in declared column order; drift in names or types is an error.

    Required columns fail the write itself when a NULL turns up in them.
    """
    actual = {f.name: f.dataType for f in df.schema.fields if f.name != partition}
    wanted = {f.name: f.dataType for f in declared.fields}
    problems = [f"missing column {n}" for n in wanted if n not in actual]
    problems += [f"unexpected column {n}" for n in actual if n not in wanted]
    problems += [
        f"{n} is {actual[n].simpleString()}, declared {wanted[n].simpleString()}"
        for n in wanted
        if n in actual and actual[n] != wanted[n]
    ]
    if problems:
        raise SchemaDriftError("; ".join(problems))
    columns = [
        F.col(f.name)
        if f.nullable
        else F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"NULL in required {f.name}")))
        .otherwise(F.col(f.name))
        .alias(f.name)
        for f in declared.fields
    ]
    return df.select(*columns, *[c for c in df.columns if c == partition])
