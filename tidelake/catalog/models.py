"""Queries on sampling, calibration, evaluation and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.registry import query, with_ctes
from tidelake.operators.evaluation import (
    METRIC,
    calibrate_scores,
    downsample,
    promotion_decision,
    roc_auc,
)
from tidelake.operators.isotonic import isotonic_scores

RATE = 0.25


@query(
    "negative_downsample",
    with_ctes(
        f"""SELECT doc_id, quality, n_chars FROM scored WHERE quality = 1
          OR CAST('0x' || substr(md5(doc_id || '|42'), 1, 8) AS BIGINT)
            < {int(RATE * 2**32)}""",
        s.SCORED,
    ),
)
def negative_downsample(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.scored_documents(spark, sf).select("doc_id", "quality", "n_chars")
    return downsample(rows, "quality", RATE, 42, "doc_id")


@query(
    "calibrate_scores",
    f"""SELECT doc_id, round(p / (p + (1 - p) / {RATE}), 9) AS calibrated
    FROM (SELECT doc_id, n_chars / (n_chars + 5000.0::DOUBLE) AS p FROM documents)""",
)
def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") / (F.col("n_chars") + F.lit(5000.0))).alias("p")
    )
    return calibrate_scores(docs, "p", RATE).select(
        "doc_id", F.round("calibrated", 9).alias("calibrated")
    )


@query(
    "isotonic_calibration",
    with_ctes(
        """SELECT score, rows, positives, round(max(low), 9) AS fitted FROM (
          SELECT j.i AS j, k.i AS i, min((k.s - j.s + j.p) / (k.n - j.n + j.r)::DOUBLE) OVER (
            PARTITION BY j.i ORDER BY k.i DESC) AS low
          FROM sums j JOIN sums k ON j.i <= k.i) m JOIN sums USING (i)
        GROUP BY score, rows, positives""",
        s.SCORED,
        """counts AS (SELECT n_chars::DOUBLE AS score, count(*) AS rows, sum(quality)::BIGINT AS positives
          FROM scored GROUP BY n_chars)""",
        """sums AS (SELECT *, rows AS r, positives AS p, row_number() OVER (ORDER BY score) AS i,
          sum(rows) OVER (ORDER BY score) AS n, sum(positives) OVER (ORDER BY score) AS s FROM counts)""",
    ),
)
def isotonic_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The non-decreasing fit of the quality label over document length, per length; in SQL
    the largest over starts of the least mean over ends."""
    fitted = isotonic_scores(s.scored_documents(spark, sf), "n_chars", "quality")
    return fitted.select(
        F.col("n_chars").alias("score"), "rows", "positives", F.round("fitted", 9).alias("fitted")
    )


def _auc_sql(rows: str, by: str) -> str:
    """Mean rank of the positives, ties at their average rank."""
    return f"""SELECT {by}, count(*) FILTER (label = 1) AS positives,
        count(*) FILTER (label = 0) AS negatives,
        (sum(mean_rank) FILTER (label = 1)
          - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
          / NULLIF(CAST(count(*) FILTER (label = 1) AS DOUBLE)
            * count(*) FILTER (label = 0), 0) AS auc
      FROM (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY score)
              + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS mean_rank
            FROM ({rows}))
      GROUP BY {by}"""


_DOCS = "SELECT lang, source, quality AS label, n_chars AS score FROM scored"
_EVENTS = """SELECT dt, CAST(event_type = 'click' AS INTEGER) AS label, value AS score FROM log"""


@query(
    "roc_auc",
    with_ctes(
        f"SELECT lang, positives, negatives, round(auc, 9) AS auc FROM ({_auc_sql(_DOCS, 'lang')})",
        s.SCORED,
    ),
)
def auc_by_language(spark: SparkSession, sf: str) -> DataFrame:
    auc = roc_auc(s.scored_documents(spark, sf), "n_chars", "quality", ["lang"])
    return auc.withColumn("auc", F.round("auc", 9))


@query(
    "roc_auc_daily",
    with_ctes(
        f"SELECT dt, positives, negatives, round(auc, 9) AS auc FROM ({_auc_sql(_EVENTS, 'dt')})",
        s.LOG,
    ),
)
def auc_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """How well the value of an event tells clicks from the rest, per day."""
    log = s.action_log(spark, sf)
    rows = log.select("dt", "value", (F.col("event_type") == "click").cast("int").alias("label"))
    return roc_auc(rows, "value", "label", ["dt"]).withColumn("auc", F.round("auc", 9))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """One model per language, one version per source; its metric is the AUC there."""
    auc = roc_auc(s.scored_documents(spark, sf), "n_chars", "quality", ["lang", "source"])
    version = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    champion = (
        F.when(F.col("lang") == "en", 5).when(F.col("lang") == "fr", 19).when(F.col("lang") == "de", 2)
    )
    return auc.select(
        F.col("lang").alias("model_name"),
        version.alias("version"),
        F.coalesce(version == champion, F.lit(False)).alias("is_champion"),
        F.col("auc").alias(METRIC),
        (version % 2 == 0).alias("downsampled"),
        (version % 3 != 0).alias("has_calibration"),
    )


@query(
    "promotion_decision",
    with_ctes(
        """SELECT model_name,
          CASE WHEN reason IS NULL THEN 'no_candidate'
            WHEN reason IN ('first_champion', 'metric_not_degraded') THEN 'promoted'
            ELSE 'rejected' END AS outcome,
          reason AS reason_code, 'val_roc_auc' AS metric_name, candidate_version,
          round(candidate_metric, 9) AS candidate_metric, champion_version,
          round(champion_metric, 9) AS champion_metric
        FROM (SELECT model_name, n.version AS candidate_version, n.auc AS candidate_metric,
            c.version AS champion_version, c.auc AS champion_metric,
            CASE WHEN n.version IS NULL THEN NULL
              WHEN n.auc < c.auc THEN 'metric_below_champion'
              WHEN n.version % 2 = 0 AND n.version % 3 = 0 THEN 'calibration_artifact_missing'
              WHEN n.version % 2 = 0 AND model_name = 'de' THEN 'serving_calibration_not_ready'
              WHEN c.version IS NULL THEN 'first_champion'
              ELSE 'metric_not_degraded' END AS reason
          FROM (SELECT DISTINCT model_name FROM versions)
          LEFT JOIN (SELECT * FROM versions WHERE is_champion) c USING (model_name)
          LEFT JOIN (SELECT v.* FROM versions v
              LEFT JOIN versions o ON o.model_name = v.model_name AND o.is_champion
              WHERE NOT v.is_champion AND v.auc IS NOT NULL
                AND (o.version IS NULL OR v.version > o.version)
              QUALIFY row_number() OVER
                (PARTITION BY v.model_name ORDER BY v.version DESC) = 1) n USING (model_name))""",
        s.SCORED,
        f"""versions AS (
          SELECT lang AS model_name, CAST(substr(source, 4) AS INTEGER) AS version, auc,
            coalesce(version = CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 19 WHEN 'de' THEN 2 END,
              FALSE) AS is_champion
          FROM ({_auc_sql(_DOCS, 'lang, source')}))""",
    ),
)
def promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Serving is not ready for one of the models."""
    decided = promotion_decision(_versions(spark, sf), F.col("model_name") != "de")
    return decided.withColumns(
        {c: F.round(c, 9) for c in ("candidate_metric", "champion_metric")}
    )
