"""Ingest queries on days of so many rows that the plain sum of the row numbers leaves 64 bits."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelake.catalog import ORACLES, QUERIES

QUERIES_OF_DAYS = (
    "canonical_scan",
    "partition_replace",
    "raw_load",
    "raw_load_gaps",
    "stream_ingest",
    "raw_load_half_day",
)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Two days of 100,000 rows; a row's number averages 2**47."""
    folder = str(tmp_path_factory.mktemp("large-days"))
    n = F.col("id")
    kinds = F.array(*map(F.lit, ("view", "click", "purchase", "signup", "error")))
    spark.range(200_000).select(
        n.alias("event_id"),
        F.timestamp_add("MICROSECOND", n * 700_001, F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")).alias("ts"),
        (n % 1_000).alias("user_id"),
        F.get(kinds, n % 5).alias("event_type"),
        (n % 50_000 / 100).alias("value"),
        F.format_string('{"k": %d}', n % 300).alias("props"),
    ).withColumn("ts", F.col("ts") - F.expr("INTERVAL 9 HOUR")).write.parquet(f"{folder}/events.parquet")
    return folder


def wrapped(number):
    return (number + 2**63) % 2**64 - 2**63


@pytest.mark.parametrize("name", QUERIES_OF_DAYS)
def test_large_days_give_the_rows_of_the_sql_modulo_2_to_the_64(spark, events, name):
    found = QUERIES[name](spark, events)
    # the SQL's own cast to BIGINT is an error at this size, so its sum is left wide here
    wide = ORACLES[name].replace("AS BIGINT) AS content", "AS HUGEINT) AS content")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
        asked = db.sql(wide)
        rows = [dict(zip(asked.columns, r)) for r in asked.fetchall()]
    assert any(r["content"] >= 2**63 for r in rows)
    rows = sorted(tuple((r | {"content": wrapped(r["content"])})[c] for c in found.columns) for r in rows)
    assert sorted(map(tuple, found.collect())) == rows
