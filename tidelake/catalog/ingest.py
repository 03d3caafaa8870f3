"""Queries on reading and writing the partitioned lake."""

from __future__ import annotations

import re
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.registry import query, with_ctes
from tidelake.functions.dates import dt_compact, in_date_window, target_day
from tidelake.operators.coverage import ready_dates
from tidelake.operators.quality import OK, ValidationError, validate_raw
from tidelake.plans.feature_build import publish_features
from tidelake.plans.raw_load import RawTable, load_day, load_days
from tidelake.session import scratch
from tidelake.sources import schemas
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import (
    PartitionNotReadyError,
    day_manifest,
    missing_partitions,
    partition_path,
    partitions,
    read_lake,
    read_partition,
    source_view,
)
from tidelake.sources.online import materialize, read_online, versions
from tidelake.sources.sink import backfill, layers_overlap, replace_date, replace_partition

# The columns a log must fill, and its key.
ACTION_LOG = RawTable(
    name="action_log",
    schema=schemas.ACTION_LOG,
    required=("event_id", "user_id", "video_id", "event_timestamp"),
    key="event_id",
)


def _lake(spark: SparkSession, sf: str, name: str) -> str:
    base = scratch(spark, name)
    backfill(s.action_log(spark, sf), base, schema=schemas.ACTION_LOG)
    return base


_ROW = ("event_id", "user_id", "video_id", "at", "event_type", "llm_model", "cents")


def _check_sum(number: Column) -> Column:
    """The sum as a long: itself while it fits, else modulo 2**64, as a checksum of many rows must."""
    half, whole = (F.lit(Decimal(1 << bits)) for bits in (63, 64))
    return (F.pmod(F.sum(number.cast("decimal(38,0)")) + half, whole) - half).cast("long")


def _per_day(df: DataFrame) -> DataFrame:
    """Rows, ids and an order-free checksum of every column, per day.

    A row's number has 48 bits, so some 65,000 rows a day leave 64. Both sums then wrap,
    where the plain sums of the SQL are an error.
    """
    at = F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    spelt = df.select("dt", "event_id", "user_id", "video_id", at, "event_type", "llm_model", cents)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _ROW])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return spelt.groupBy("dt").agg(
        F.count(F.lit(1)).alias("rows"),
        _check_sum(F.col("event_id")).alias("id_sum"),
        _check_sum(number).alias("content"),
    )


def _per_day_sql(source: str = "log", event_id: str = "event_id") -> str:
    spelt = {"event_id": event_id, "at": "strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f')",
             "cents": "CAST(round(value * 100) AS BIGINT)"}
    text = ", ".join(f"coalesce(CAST({spelt.get(c, c)} AS VARCHAR), '-')" for c in _ROW)
    return f"""SELECT dt, count(*) AS rows, CAST(sum({event_id}) AS BIGINT) AS id_sum,
      CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 12) AS BIGINT)) AS BIGINT) AS content
      FROM {source}"""


_PER_DAY = _per_day_sql().replace(" FROM log", "")


@query("canonical_scan", with_ctes(f"{_PER_DAY} FROM log GROUP BY dt", s.LOG))
def canonical_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every day of a lake in which left-over copies and shard folders lie around."""
    base, twin = _lake(spark, sf, "canonical"), _lake(spark, sf, "twin")
    fs = SharedFs(spark, base)
    strays = ("part-0.parquet.copy-of-last-run", "shard=001/part-0.parquet")
    for n, day in enumerate(partitions(spark, base)):
        copy = next(f for f in fs.names(partition_path(twin, day)) if f.startswith("part-"))
        stray = f"{partition_path(base, day)}/{strays[n % 2]}"
        fs.rename(f"{partition_path(twin, day)}/{copy}", stray)
    return _per_day(read_lake(spark, base, schema=schemas.ACTION_LOG))


@query(
    "partition_replace",
    with_ctes(
        f"{_PER_DAY} FROM log WHERE dt <> DATE '{s.DAY}' OR event_type <> 'error' GROUP BY dt",
        s.LOG,
    ),
)
def partition_replace(spark: SparkSession, sf: str) -> DataFrame:
    """One day replaced twice by its cleaned rows; the other days stay."""
    base = _lake(spark, sf, "replace")
    log = s.action_log(spark, sf)
    clean = log.where((F.col("dt") == F.lit(s.DAY)) & (F.col("event_type") != "error"))
    for _ in range(2):
        replace_partition(clean, base, s.DAY, schema=schemas.ACTION_LOG, overwrite=True)
    return _per_day(read_lake(spark, base, schema=schemas.ACTION_LOG))


@query(
    "backfill_partitions",
    with_ctes(
        _per_day_sql(event_id=f"(CASE WHEN dt >= DATE '{s.DAY}' THEN -event_id ELSE event_id END)")
        + f" WHERE dt < DATE '{s.DAY}' OR event_type <> 'error' GROUP BY dt",
        s.LOG,
    ),
)
def backfill_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """A later source rewrites the days it has; earlier days are kept."""
    base = _lake(spark, sf, "backfill")
    log = s.action_log(spark, sf)
    later = log.where((F.col("dt") >= F.lit(s.DAY)) & (F.col("event_type") != "error"))
    backfill(later.withColumn("event_id", -F.col("event_id")), base, schema=schemas.ACTION_LOG)
    return _per_day(read_lake(spark, base, schema=schemas.ACTION_LOG))


@query(
    "feature_replace_idempotent",
    with_ctes(
        f"""SELECT dt, count(*) AS rows, CAST(sum(impressions) AS BIGINT) AS impressions,
          count(ctr) AS with_ctr
        FROM user_features GROUP BY dt""",
        s.LOG,
        s.VIDEOS,
        s.USER_FEATURES,
    ),
)
def feature_replace_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """The user table of all days, with one day written again twice."""
    base = scratch(spark, "user_dynamic_feature")
    rows = s.user_features(spark, sf)
    backfill(rows, base, schema=schemas.USER_DYNAMIC_FEATURE)
    for _ in range(2):
        replace_date(
            rows.where(F.col("dt") == F.lit(s.DAY)), base, s.DAY, schema=schemas.USER_DYNAMIC_FEATURE
        )
    return (
        read_lake(spark, base, schema=schemas.USER_DYNAMIC_FEATURE)
        .groupBy("dt")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("impressions").alias("impressions"),
            F.count("ctr").alias("with_ctr"),
        )
    )


@query("raw_load", with_ctes(f"{_PER_DAY} FROM log GROUP BY dt", s.LOG))
def raw_load(spark: SparkSession, sf: str) -> DataFrame:
    """Lake to raw layer: every day as one catch-up load, then one day on its own."""
    source = _lake(spark, sf, "lake")
    target, ledger = scratch(spark, "raw"), scratch(spark, "ledger")
    days = [date.fromisoformat(d) for d in partitions(spark, source)]
    load_days(spark, source, target, days, ACTION_LOG, ledger)
    load_day(spark, source, target, s.DAY, ACTION_LOG, ledger)
    loaded = _per_day(read_lake(spark, target, schema=schemas.ACTION_LOG))
    ready = ready_dates(spark.read.parquet(ledger), [ACTION_LOG.name])
    return loaded.join(ready.select("dt"), "dt", "left_semi")


@query(
    "raw_load_gaps",
    with_ctes(f"{_PER_DAY}, TRUE AS refused FROM log WHERE dt <> DATE '{s.DAY}' GROUP BY dt", s.LOG),
)
def raw_load_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """A load that names a day the lake lacks is refused as a whole; the other days then load."""
    source = scratch(spark, "gaps")
    target, ledger = scratch(spark, "raw"), scratch(spark, "ledger")
    log = s.action_log(spark, sf).where(F.col("dt") != F.lit(s.DAY))
    backfill(log, source, schema=schemas.ACTION_LOG)
    days = [date.fromisoformat(d) for d in partitions(spark, source)]
    try:
        load_days(spark, source, target, [*days, s.DAY], ACTION_LOG, ledger)
        refused = False
    except FileNotFoundError:
        refused = not SharedFs(spark, target).exists(target)
    load_days(spark, source, target, days, ACTION_LOG, ledger)
    loaded = _per_day(read_lake(spark, target, schema=schemas.ACTION_LOG))
    ready = ready_dates(spark.read.parquet(ledger), [ACTION_LOG.name])
    return loaded.join(ready.select("dt"), "dt", "left_semi").withColumn("refused", F.lit(refused))


@query(
    "raw_load_half_day",
    with_ctes(
        f"""SELECT *, TRUE AS refused, 1 AS entries FROM ({_PER_DAY} FROM log GROUP BY dt)""",
        s.LOG,
    ),
)
def raw_load_half_day(spark: SparkSession, sf: str) -> DataFrame:
    """A day that has arrived half, and one with a file that its load does not name.

    The load is refused as a whole while a file of the half day is away. Run when it has
    come, and run again, it leaves each day once and one ledger entry for it.
    """
    source, aside = _lake(spark, sf, "half"), scratch(spark, "late")
    target, ledger = scratch(spark, "raw"), scratch(spark, "ledger")
    fs = SharedFs(spark, source)
    days = [date.fromisoformat(d) for d in partitions(spark, source)]
    stray = f"{partition_path(source, days[0])}/part-99999-stray.parquet"
    twin = _lake(spark, sf, "twin")
    copy = next(iter(day_manifest(spark, twin, days[0])["files"]))
    fs.rename(f"{partition_path(twin, days[0])}/{copy}", stray)
    late = next(iter(day_manifest(spark, source, s.DAY)["files"]))
    fs.rename(f"{partition_path(source, s.DAY)}/{late}", f"{aside}/{late}")
    try:
        load_days(spark, source, target, days, ACTION_LOG, ledger)
        refused = False
    except PartitionNotReadyError:
        refused = not fs.exists(target)
    fs.rename(f"{aside}/{late}", f"{partition_path(source, s.DAY)}/{late}")
    for _ in range(2):
        load_days(spark, source, target, days, ACTION_LOG, ledger)
    entries = spark.read.parquet(ledger).groupBy("dt").agg(F.count("*").cast("int").alias("entries"))
    loaded = _per_day(read_lake(spark, target, schema=schemas.ACTION_LOG))
    return loaded.withColumn("refused", F.lit(refused)).join(entries, "dt")


@query(
    "raw_load_refusals",
    with_ctes(
        """SELECT dt, count(*) FILTER (event_type = 'click' AND value > 50) AS doubled,
          bool_or(user_id IS DISTINCT FROM video_id) AS swapped, TRUE AS untouched
        FROM log GROUP BY dt""",
        s.LOG,
    ),
)
def raw_load_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """What the gate says, day by day, of a lake with doubled rows and of a copy in which
    two columns are swapped; a refused load leaves neither target nor ledger."""
    log = s.action_log(spark, sf)
    source, target, ledger = (scratch(spark, n) for n in ("doubled", "raw", "ledger"))
    extra = log.where((F.col("event_type") == "click") & (F.col("value") > 50))
    backfill(log.unionByName(extra), source, schema=schemas.ACTION_LOG)
    days = [date.fromisoformat(d) for d in partitions(spark, source)]
    said = []
    try:
        load_days(spark, source, target, days, ACTION_LOG, ledger)
    except ValidationError as refusal:
        said = re.findall(r"dt=(\S+) validation failed: (\d+) duplicate", str(refusal))
    fs = SharedFs(spark, source)
    untouched = bool(said) and not fs.exists(target) and not fs.exists(ledger)
    counts = spark.createDataFrame([(date.fromisoformat(d), int(n)) for d, n in said], "dt date, doubled long")
    other = {"user_id": "video_id", "video_id": "user_id"}
    swapped = log.select(*[F.col(other.get(c, c)).alias(c) for c in log.columns])
    checks = validate_raw(swapped, log, ACTION_LOG.required, ACTION_LOG.key, content=True)
    return checks.join(counts, "dt", "left").select(
        "dt",
        F.coalesce("doubled", F.lit(0)).alias("doubled"),
        (F.col("content_check") != OK).alias("swapped"),
        F.lit(untouched).alias("untouched"),
    )


@query(
    "feature_gate",
    with_ctes(
        f"""SELECT dt, user_id, impressions, clicks, TRUE AS refused FROM user_features
        WHERE dt = DATE '{s.DAY}'""",
        s.LOG,
        s.VIDEOS,
        s.USER_FEATURES,
    ),
)
def feature_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A day of features, and a later build of it with repeated keys, which must not replace it."""
    base = scratch(spark, "user_dynamic_feature")
    day = s.user_features(spark, sf).where(F.col("dt") == F.lit(s.DAY))
    publish_features(day, base, s.DAY, schemas.USER_DYNAMIC_FEATURE, ["user_id"])
    worse = day.unionByName(day.where("user_id % 10 = 0")).withColumn("clicks", F.col("clicks") + 1)
    try:
        publish_features(worse, base, s.DAY, schemas.USER_DYNAMIC_FEATURE, ["user_id"])
        refused = False
    except ValidationError:
        refused = True
    kept = read_partition(spark, base, s.DAY, schema=schemas.USER_DYNAMIC_FEATURE, committed=True)
    return kept.select("dt", "user_id", "impressions", "clicks", F.lit(refused).alias("refused"))


@query(
    "source_file_view",
    with_ctes(
        f"""SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users
        FROM log WHERE dt = DATE '{s.DAY}' GROUP BY event_type""",
        s.LOG,
    ),
)
def source_file_view(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical files of a day as a view, asked in SQL as the checks after a load are."""
    base = _lake(spark, sf, "view")
    source_view(spark, base, s.DAY, "day_files", schema=schemas.ACTION_LOG, committed=True)
    return spark.sql(
        "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM day_files GROUP BY event_type"
    )


@query(
    "layer_overlaps",
    """SELECT o_orderpriority AS priority, count(*) AS jobs, count(*) FILTER (
          starts_with(raw || '/', feature || '/') OR starts_with(feature || '/', raw || '/')) AS overlapping
    FROM (SELECT o_orderpriority, 'lake/' || o_orderpriority || '/' || (o_custkey % 5) AS raw,
        CASE WHEN o_orderkey % 3 = 0 THEN 'lake/' || o_orderpriority
          WHEN o_orderkey % 3 = 1 THEN 'lake/' || o_orderpriority || '/' || (o_orderkey % 7)
          ELSE 'lake/' || o_orderpriority || '/' || (o_custkey % 5) || '/features' END AS feature
      FROM orders)
    GROUP BY o_orderpriority""",
)
def layer_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs, one per order, whose raw and feature layers would lie in or around each other."""
    priority, customer = F.col("o_orderpriority"), (F.col("o_custkey") % 5).cast("string")
    raw = F.concat_ws("/", F.lit("lake"), priority, customer)
    key = F.col("o_orderkey")
    feature = (
        F.when(key % 3 == 0, F.concat_ws("/", F.lit("lake"), priority))
        .when(key % 3 == 1, F.concat_ws("/", F.lit("lake"), priority, (key % 7).cast("string")))
        .otherwise(F.concat(raw, F.lit("/features/")))
    )
    jobs = s.table(spark, sf, "orders").select(priority.alias("priority"), layers_overlap(raw, feature).alias("_over"))
    return jobs.groupBy("priority").agg(F.count("*").alias("jobs"), F.count_if("_over").alias("overlapping"))


@query(
    "target_days",
    """SELECT day, count(*) AS runs, count(*) FILTER (named IS NOT NULL) AS named FROM (
      SELECT CASE WHEN event_id % 7 = 0 THEN DATE '2024-02-01' + CAST(event_id % 5 AS INTEGER) END AS named,
        coalesce(named, CAST(ts + INTERVAL 9 HOUR AS DATE) - CAST(event_id % 3 AS INTEGER)) AS day
      FROM events)
    GROUP BY day""",
)
def target_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days that runs work on: a named day as it is, an empty name as none, else the local day less a lag."""
    run = F.col("event_id")
    name = F.when(run % 7 == 0, F.date_add(F.lit(date(2024, 2, 1)), (run % 5).cast("int")).cast("string"))
    name = name.when(run % 7 == 1, F.lit(""))
    runs = s.table(spark, sf, "events").select(name.alias("name"), target_day(name, F.col("ts"), (run % 3).cast("int")).alias("day"))
    return runs.groupBy("day").agg(
        F.count("*").alias("runs"), F.count_if(F.col("name") != "").alias("named")
    )


@query(
    "kst_daily_counts",
    with_ctes(
        """SELECT dt, strftime(dt, '%Y%m%d') AS dt_id, count(*) AS events,
          count(*) FILTER (CAST(event_timestamp AS DATE) <> dt) AS moved
        FROM log GROUP BY dt""",
        s.LOG,
    ),
)
def kst_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = s.action_log(spark, sf)
    return log.groupBy("dt", dt_compact(F.col("dt")).alias("dt_id")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.to_date("event_timestamp") != F.col("dt")).alias("moved"),
    )


@query(
    "training_window",
    with_ctes(
        f"""SELECT dt, event_type, count(*) AS events FROM log
        WHERE dt BETWEEN DATE '{s.WINDOW[0]}' AND DATE '{s.WINDOW[1]}' GROUP BY ALL""",
        s.LOG,
    ),
)
def training_window(spark: SparkSession, sf: str) -> DataFrame:
    log = in_date_window(s.action_log(spark, sf), *s.WINDOW)
    return log.groupBy("dt", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "missing_partitions",
    with_ctes(
        f"""SELECT CAST(d AS DATE) AS dt
        FROM generate_series(DATE '{s.FIRST_DAY}', DATE '{s.LAST_DAY}' + 2, INTERVAL 1 DAY) g(d)
        WHERE CAST(d AS DATE) NOT IN
          (SELECT dt FROM log WHERE day(dt) NOT IN (10, 17))""",
        s.LOG,
    ),
)
def missing(spark: SparkSession, sf: str) -> DataFrame:
    """Expected days against an inventory from which two days were taken out."""
    inventory = s.action_log(spark, sf).where(~F.dayofmonth("dt").isin(10, 17))
    last = date.fromordinal(s.LAST_DAY.toordinal() + 2)
    return missing_partitions(inventory, s.FIRST_DAY, last)


@query(
    "ready_dates",
    with_ctes(
        """SELECT dt, max(validated_at) AS ready_at
        FROM (SELECT dt, event_type, min(event_timestamp) AS validated_at FROM log
              WHERE event_type IN ('impression', 'click', 'view') AND value > 200
              GROUP BY dt, event_type)
        GROUP BY dt HAVING count(*) = 3""",
        s.LOG,
    ),
)
def ready(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which each of three tables has an update; events above a value stand
    in for updates, so that some days lack one."""
    ledger = s.action_log(spark, sf).where(F.col("value") > 200)
    ledger = ledger.select(
        F.col("event_type").alias("table_name"), "dt", F.col("event_timestamp").alias("validated_at")
    )
    return ready_dates(ledger, ["impression", "click", "view"])


@query(
    "online_latest",
    with_ctes(
        f"""SELECT user_id, event_timestamp, impressions, clicks, distinct_videos
        FROM user_features WHERE event_timestamp <= TIMESTAMP '{s.MARKS[-1]}'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1""",
        s.LOG,
        s.VIDEOS,
        s.USER_FEATURES,
    ),
)
def online_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Two incremental runs; the second takes in only what lies after the first."""
    base = scratch(spark, "online")
    rows = s.user_features(spark, sf).select(
        "user_id", "event_timestamp", "impressions", "clicks", "distinct_videos"
    )
    for now in s.MARKS:
        snapshot = materialize(rows, base, "user_dynamic", ["user_id"], now)
    return snapshot


@query(
    "online_versions",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT {n} AS version, * FROM (
              SELECT user_id, event_timestamp, impressions, clicks FROM user_features
              WHERE event_timestamp <= TIMESTAMP '{mark}'
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1)"""
            for n, mark in enumerate(s.MARKS, 1)
        ),
        s.LOG,
        s.VIDEOS,
        s.USER_FEATURES,
    ),
)
def online_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every version of a snapshot as its readers see it after all increments."""
    base = scratch(spark, "online")
    rows = s.user_features(spark, sf).select("user_id", "event_timestamp", "impressions", "clicks")
    for now in s.MARKS:
        materialize(rows, base, "user_dynamic", ["user_id"], now)
    found = [
        read_online(spark, base, "user_dynamic", n).select(F.lit(n).alias("version"), "*")
        for n in versions(spark, base, "user_dynamic")
    ]
    return reduce(DataFrame.unionByName, found)
