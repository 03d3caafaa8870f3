import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.operators.quality import dup_keys_global
from tidelake.operators.repeats import _bits, _holds, blocks_for, day_filters, repeats, take_in
from tidelake.session import scratch
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import read_lake
from tidelake.sources.schemas import ACTION_LOG
from tidelake.sources.sink import backfill

FIRST = date(2024, 1, 1)


def lake_of(spark, rows):
    """(event id, day number) pairs as a lake of daily logs."""
    full = [(i, 1, 1, datetime(2024, 1, 1), "click", "m", 1.0, FIRST + timedelta(days=d)) for i, d in rows]
    df = spark.createDataFrame(
        full, "event_id long, user_id long, video_id long, event_timestamp timestamp_ntz, event_type string, "
        "llm_model string, value double, dt date"
    )
    base = scratch(spark, "lake")
    backfill(df, base, schema=ACTION_LOG)
    return base


def days(*numbers):
    return [FIRST + timedelta(days=n) for n in numbers]


def found(spark, state):
    return {r.event_id: r.copies for r in repeats(spark, state).collect()}


@pytest.mark.parametrize("blocks", [1, 5])
def test_batches_of_days_add_up_to_the_whole_lake(spark, blocks):
    rng = random.Random(blocks)
    rows = [(i, rng.randrange(6)) for i in range(3000)]
    rows += [(rng.randrange(3000), rng.randrange(6)) for _ in range(150)] + [(None, 1), (None, 4)]
    base, state = lake_of(spark, rows), scratch(spark, "state")
    for batch in ((0, 1), (2,), (3, 4), (5,)):
        take_in(spark, base, state, days(*batch), ["event_id"], blocks, schema=ACTION_LOG)
    want = {r.event_id: r.copies for r in dup_keys_global(read_lake(spark, base, schema=ACTION_LOG), "event_id").collect()}
    counted = Counter(i for i, _ in rows if i is not None)
    assert found(spark, state) == want == {i: n for i, n in counted.items() if n > 1}


def test_days_without_a_shared_key_are_not_read(spark):
    rows = [(1000 * d + n, d) for d in range(5) for n in range(200)]
    rows += [(1007, 4), (3009, 4), (3009, 4)]
    base, state = lake_of(spark, rows), scratch(spark, "state")
    for batch in range(4):
        assert take_in(spark, base, state, days(batch), ["event_id"], blocks_for(5000), schema=ACTION_LOG) == []
    fs = SharedFs(spark, base)
    for day in (0, 2):  # reading one of these would fail
        fs.delete(f"{base}/dt={days(day)[0]}")
    assert take_in(spark, base, state, days(4), ["event_id"], blocks_for(5000), schema=ACTION_LOG) == days(1, 3)
    assert found(spark, state) == {1007: 2, 3009: 3}


def test_a_lost_batch_is_run_again(spark):
    base, state = lake_of(spark, [(1, 0), (2, 0), (1, 1), (2, 1), (2, 1)]), scratch(spark, "state")
    take_in(spark, base, state, days(0), ["event_id"], 1, schema=ACTION_LOG)
    # the filters of a lost second batch lie there, its manifest does not
    day_filters(read_lake(spark, base, schema=ACTION_LOG), ["event_id"], 1).write.parquet(f"{state}/filters/batch=1")
    take_in(spark, base, state, days(1), ["event_id"], 1, schema=ACTION_LOG)
    assert found(spark, state) == {1: 2, 2: 3}


def test_a_filter_never_misses_a_key_and_seldom_adds_one(spark):
    keys = spark.range(4000).select(F.lit(FIRST).alias("dt"), F.col("id").alias("k"))
    filters = day_filters(keys, ["k"], blocks_for(4000))
    asked = spark.range(12_000).select("id", F.xxhash64("id").alias("_h"))
    asked = asked.withColumn("b", F.pmod("_h", F.lit(blocks_for(4000))))
    held = asked.join(filters, F.col("b") == F.col("block")).where(_holds(F.col("bitmap"), _bits(F.col("_h"))))
    ids = {r.id for r in held.collect()}
    assert set(range(4000)) <= ids and len(ids) < 4000 + 8000 * 0.02
