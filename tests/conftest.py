from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LOG_SCHEMA = (
    "event_id long, user_id long, video_id long, event_timestamp timestamp_ntz, "
    "event_type string, llm_model string, value double"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    from pyspark.sql import functions as F

    from tidelake.functions.dates import kst_date

    def build(rows):
        """Rows of (id, user, video, 'YYYY-MM-DD HH:MM:SS', type)."""
        full = [
            (i, u, v, datetime.fromisoformat(t), kind, "m", 1.0) for i, u, v, t, kind in rows
        ]
        df = spark.createDataFrame(full, LOG_SCHEMA)
        return df.withColumn("dt", kst_date(F.col("event_timestamp")))

    return build
