"""Queries on snapshots, candidate lists and click thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.ingest import ACTION_LOG
from tidelake.catalog.registry import query, with_ctes
from tidelake.functions.predicates import any_null
from tidelake.operators.candidates import (
    PRIME,
    ROUNDS,
    WALK_STEPS,
    decide_click,
    quota_mix,
    threshold_choice,
    threshold_sweep,
)
from tidelake.operators.quality import outside_partition
from tidelake.operators.ranking import first_n_users, top_n
from tidelake.plans.exposure_log import exposure_events, publish_day
from tidelake.plans.raw_load import load_day
from tidelake.session import scratch
from tidelake.sources.lake import read_partition

GRID = [round(0.1 * i, 1) for i in range(1, 21)]
TARGET = 0.02
THRESHOLD = 0.5


@query(
    "first_n_users",
    "SELECT c_custkey AS user_id FROM customer ORDER BY c_custkey LIMIT 100",
)
def first_users(spark: SparkSession, sf: str) -> DataFrame:
    return first_n_users(s.users(spark, sf), 100)


@query(
    "trending_topn",
    with_ctes(
        """SELECT region, dt, video_id, shown,
          CAST(row_number() OVER (PARTITION BY region, dt ORDER BY shown DESC, video_id)
            AS INTEGER) AS rank
        FROM (SELECT r_name AS region, dt, video_id, count(*) AS shown
              FROM log JOIN customer ON user_id = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey
              WHERE event_type = 'impression' GROUP BY ALL)
        QUALIFY rank <= 20""",
        s.LOG,
    ),
)
def trending_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 most shown videos per region and day. Counts per user and video come
    first, so the joins see each pair once a day."""
    shown = (
        s.action_log(spark, sf)
        .where(F.col("event_type") == "impression")
        .groupBy("user_id", "dt", "video_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    homes = (
        s.table(spark, sf, "customer")
        .join(s.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(s.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("region"))
    )
    per_region = shown.join(homes, "user_id").groupBy("region", "dt", "video_id")
    counted = per_region.agg(F.sum("n").alias("shown"))
    return top_n(counted, ["region", "dt"], [F.desc("shown"), F.col("video_id")], 20)


def _mix(spark: SparkSession, sf: str) -> DataFrame:
    videos = s.videos(spark, sf)
    taste = (
        s.action_log(spark, sf)
        .where(F.col("event_type") != "error")
        .groupBy("user_id", "video_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(videos.select("video_id", "category"), "video_id")
        .groupBy("user_id", "category")
        .agg(F.sum("n").alias("n"))
        .groupBy("user_id")
        .agg(F.max_by("category", F.struct("n", "category")).alias("category"))
    )
    people = s.users(spark, sf).select("user_id").join(taste, "user_id", "left")
    return quota_mix(people, videos.withColumnRenamed("price", "score"))


_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"



def _walk_sql() -> str:
    """Every user's first 24 places of their own permutation of the catalog, step by step."""
    keys = ", ".join(
        f"{_HASH.format(f"user_id || '|42|add{r}'")} % {PRIME} AS add{r}, "
        f"{_HASH.format(f"user_id || '|42|times{r}'")} % {PRIME - 1} + 1 AS times{r}"
        for r in range(ROUNDS)
    )
    moves, left, right = [], "l0", "r0"
    for r in range(ROUNDS):
        moved, by, size = (left, right, "height") if r % 2 == 0 else (right, left, "side")
        name = f"{moved[0]}{r + 1}"
        moves.append(f"({moved} + (({by} + add{r}) % {PRIME}) * times{r} % {PRIME}) % {size} AS {name}")
        left, right = (name, right) if r % 2 == 0 else (left, name)
    once = f"place // side AS l0, place % side AS r0, {', '.join(moves)}, {left} * side + {right} AS moved"
    kept = "user_id, i, total, side, height, " + ", ".join(f"add{r}, times{r}" for r in range(ROUNDS))
    steps = [
        f"""grid AS (
  SELECT total, side, (total + side - 1) // side AS height
  FROM (SELECT count(*) AS total, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM videos)),
w_ AS (SELECT {kept}, i AS place FROM (SELECT user_id, {keys} FROM people), grid, range(24) t(i) WHERE i < total),
w0 AS (SELECT {kept}, moved AS place FROM (SELECT *, {once} FROM w_))"""
    ]
    for n in range(WALK_STEPS):
        steps.append(
            f"w{n + 1} AS (SELECT {kept}, CASE WHEN place < total THEN place ELSE moved END AS place "
            f"FROM (SELECT *, {once} FROM w{n}))"
        )
    return ",\n".join(steps)


MIX = f"""taste AS (
  SELECT user_id, category FROM log JOIN videos USING (video_id) WHERE event_type <> 'error'
  GROUP BY user_id, category
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category DESC) = 1),
people AS (SELECT c_custkey AS user_id, category FROM customer LEFT JOIN taste
  ON c_custkey = user_id),
ranked AS (
  SELECT video_id, category,
    row_number() OVER (PARTITION BY category ORDER BY price DESC, video_id) AS in_category,
    row_number() OVER (ORDER BY price DESC, video_id) AS overall,
    row_number() OVER (ORDER BY {_HASH.format("video_id || '|42'")}, video_id) - 1 AS position,
    count(*) OVER () AS total
  FROM videos),
mine AS (
  SELECT user_id, video_id, in_category AS k FROM people JOIN ranked USING (category)
  WHERE in_category <= 17),
shared AS (
  SELECT user_id, video_id, row_number() OVER (PARTITION BY user_id ORDER BY overall) AS k
  FROM people p, ranked r
  WHERE overall <= 22 AND NOT EXISTS
    (SELECT 1 FROM mine m WHERE m.user_id = p.user_id AND m.video_id = r.video_id)
  QUALIFY k <= 5),
taken AS (SELECT user_id, video_id FROM mine UNION ALL SELECT user_id, video_id FROM shared),
{_walk_sql()},
walked AS (
  SELECT w.user_id, r.video_id, row_number() OVER (PARTITION BY w.user_id ORDER BY w.i) AS k
  FROM w{WALK_STEPS} w JOIN ranked r ON w.place = r.position
  WHERE NOT EXISTS
    (SELECT 1 FROM taken t WHERE t.user_id = w.user_id AND t.video_id = r.video_id)),
sizes AS (SELECT user_id, count(*) AS n FROM taken GROUP BY user_id),
mix AS (
  SELECT user_id, video_id, 'personalized' AS strategy, 1 AS part, k FROM mine
  UNION ALL SELECT user_id, video_id, 'popular', 2, k FROM shared
  UNION ALL SELECT user_id, video_id, 'exploration', 3, k
    FROM walked LEFT JOIN sizes USING (user_id) WHERE k <= 24 - coalesce(n, 0))"""


@query(
    "candidate_mix",
    with_ctes(
        """SELECT user_id, video_id, strategy,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, k) AS INTEGER) AS slot
        FROM mix""",
        s.LOG,
        s.VIDEOS,
        MIX,
    ),
)
def candidate_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).select("user_id", "video_id", "strategy", "slot")


_EXPOSED = f"""steps AS (
  SELECT *, unnest(['impression', 'click', 'view']) AS kind, unnest([0, 1, 2]) AS step
  FROM log WHERE event_type = 'impression'),
exposed AS (
  SELECT event_id * 3 + step AS event_id, user_id, video_id, kind AS event_type,
    event_timestamp + to_seconds(step) AS event_timestamp, value / 100 AS value, dt
  FROM steps WHERE step = 0 OR value / 100 >= {THRESHOLD})"""


@query("exposure_log", with_ctes("SELECT * FROM exposed", s.LOG, _EXPOSED))
def exposure_log(spark: SparkSession, sf: str) -> DataFrame:
    """The impressions of all days with their decided clicks; the value of an event
    stands in for the ranking service's score."""
    return _exposed(spark, sf).drop("llm_model")


def _exposed(spark: SparkSession, sf: str) -> DataFrame:
    shown = s.action_log(spark, sf).where(F.col("event_type") == "impression")
    scored = shown.withColumn("score", F.col("value") / 100)
    return exposure_events(scored, "score", THRESHOLD, s.MODEL)


@query(
    "exposure_publish",
    with_ctes(
        f"""SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum,
          CAST(sum(user_id) AS BIGINT) AS users, CAST(sum(video_id) AS BIGINT) AS videos,
          max(event_timestamp) AS last, max(value) AS value
        FROM exposed
        WHERE dt = DATE '{s.DAY}' AND CAST(event_timestamp + INTERVAL 9 HOUR AS DATE) = dt
        GROUP BY event_type""",
        s.LOG,
        _EXPOSED,
    ),
)
def exposure_publish(spark: SparkSession, sf: str) -> DataFrame:
    """A day of that log through quarantine, quality report and partition write, published
    again over itself and then loaded into the raw layer."""
    base, aside = scratch(spark, "published"), scratch(spark, "set-aside")
    rules = {
        "missing key": any_null(["event_id", "user_id", "video_id"]),
        "outside the day": outside_partition(),
    }
    day = _exposed(spark, sf).where(F.col("dt") == F.lit(s.DAY))
    for _ in range(2):
        publish_day(
            day, rules, s.videos(spark, sf), s.users(spark, sf), base, aside, s.DAY, s.MODEL,
            overwrite=True,
        )
    target = scratch(spark, "loaded")
    load_day(spark, base, target, s.DAY, ACTION_LOG)
    stored = read_partition(spark, target, s.DAY, schema=ACTION_LOG.schema)
    return stored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("event_id").alias("id_sum"),
        F.sum("user_id").alias("users"),
        F.sum("video_id").alias("videos"),
        F.max("event_timestamp").alias("last"),
        F.max("value").alias("value"),
    )


def _scored_events(spark: SparkSession, sf: str) -> DataFrame:
    log = s.action_log(spark, sf)
    return log.select("event_id", (F.col("value") / 100).alias("score"))


@query(
    "click_decision",
    "SELECT event_id, value / 100 AS score, value / 100 >= 0.5 AS clicked FROM events",
)
def click_decision(spark: SparkSession, sf: str) -> DataFrame:
    return decide_click(_scored_events(spark, sf), "score", 0.5)


_GRID_SQL = ", ".join(f"({t})" for t in GRID)
_SWEEP = f"""sweep AS (
  SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS exposures,
    count(*) FILTER (value / 100 >= CAST(threshold AS DOUBLE)) AS clicks
  FROM events, (VALUES {_GRID_SQL}) g(threshold) GROUP BY threshold)"""


@query(
    "threshold_sweep",
    with_ctes("SELECT *, round(clicks / exposures, 9) AS ctr FROM sweep", _SWEEP),
)
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_sweep(_scored_events(spark, sf), "score", GRID).withColumn(
        "ctr", F.round("ctr", 9)
    )


@query(
    "threshold_choice",
    with_ctes(
        f"""SELECT *, round(clicks / exposures, 9) AS ctr FROM sweep
        ORDER BY abs(clicks / exposures - {TARGET}), threshold LIMIT 1""",
        _SWEEP,
    ),
)
def choice(spark: SparkSession, sf: str) -> DataFrame:
    swept = threshold_sweep(_scored_events(spark, sf), "score", GRID)
    return threshold_choice(swept, TARGET).withColumn("ctr", F.round("ctr", 9))
