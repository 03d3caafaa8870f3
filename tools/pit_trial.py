"""Point-in-time training build over 1.8 million events; prints one JSON line.

The events of the largest tables are repeated under shifted user ids until they reach
the size. Feature tables and spine are stored first, as the daily jobs would; what is
timed is the training set over the whole history, written to the shared folder.

    python tools/pit_trial.py [--copies 18] [--memory 2g] [--cpus 4]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import peak_bytes  # noqa: E402
from tidelake.catalog import standin as s  # noqa: E402
from tidelake.catalog.training import USER_COLUMNS, VIDEO_COLUMNS  # noqa: E402
from tidelake.operators.attribution import attribute_clicks  # noqa: E402
from tidelake.operators.features import user_dynamic  # noqa: E402
from tidelake.plans.training import View, training_dataset  # noqa: E402
from tidelake.session import scratch  # noqa: E402
from tidelake.sources.lake import read_lake  # noqa: E402
from tidelake.sources.sink import backfill  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.1")
    parser.add_argument("--copies", type=int, default=18)
    parser.add_argument("--memory", default="2g")
    parser.add_argument("--cpus", default="4")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master(f"local[{args.cpus}]")
        .config("spark.driver.memory", args.memory)
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    copies = F.explode(F.sequence(F.lit(0), F.lit(args.copies - 1)))
    grown = s.action_log(spark, args.sf).withColumn("_copy", copies).select(
        (F.col("event_id") * args.copies + F.col("_copy")).alias("event_id"),
        (F.col("user_id") + F.col("_copy") * 1_000_000).alias("user_id"),
        "video_id",
        "event_timestamp",
        "event_type",
        "dt",
    )
    raw, users, videos, spine = (scratch(spark, n) for n in ("log", "users", "videos", "spine"))
    started = time.time()
    backfill(grown, raw)
    log = read_lake(spark, raw)
    backfill(user_dynamic(log, s.videos(spark, args.sf)), users)
    backfill(s.video_features(spark, args.sf), videos)
    backfill(attribute_clicks(log, ["user_id"], s.WIDE_SECONDS), spine)
    prepared = time.time()
    rows = training_dataset(
        read_lake(spark, spine),
        [
            View(read_lake(spark, users), "user_id", USER_COLUMNS, "user_"),
            View(read_lake(spark, videos), "video_id", VIDEO_COLUMNS, "video_"),
        ],
        [(s.users(spark, args.sf), "user_id")],
        s.FIRST_DAY,
        s.LAST_DAY,
    )
    out = scratch(spark, "training")
    rows.write.parquet(out)
    done = time.time()
    print(
        json.dumps(
            {
                "events": log.count(),
                "training_rows": spark.read.parquet(out).count(),
                "prepare_sec": round(prepared - started, 1),
                "build_sec": round(done - prepared, 1),
                "peak_jvm_bytes": peak_bytes(spark),
                "memory": args.memory,
                "cpus": args.cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
