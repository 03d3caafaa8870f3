"""Audit of promotion-result records kept as JSON, one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.predicates import messages
from tidelake.functions.redact import is_blank
from tidelake.operators.evaluation import METRIC
from tidelake.operators.requests import json_type

# The record contract, and the reasons allowed for each outcome.
EVENT = "model_promotion_result"
CONTRACT = "model-promotion-result-v1"
REASONS = {
    "promoted": ("first_champion", "metric_not_degraded"),
    "rejected": (
        "metric_below_champion",
        "calibration_artifact_missing",
        "serving_calibration_not_ready",
    ),
}
IDS = ("model_name", "champion_alias", "candidate_version")


def _text(doc: Column, key: str) -> Column:
    """Value of a key if it is a string."""
    return F.when(json_type(doc, key) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))


def _number(doc: Column, key: str) -> Column:
    """Value of a key if it is a finite number; true and false are not numbers."""
    is_number = F.regexp_like(json_type(doc, key), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    value = F.try_variant_get(doc, f"$.{key}", "double")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(is_number & finite, value)


def _absent(doc: Column, key: str) -> Column:
    return F.coalesce(json_type(doc, key), F.lit("VOID")) == "VOID"


def audit_results(df: DataFrame, column: str = "record") -> DataFrame:
    """Add ``errors``; a record with an empty list may be announced."""
    parsed = df.withColumn("_doc", F.try_parse_json(column))
    doc = F.col("_doc")
    outcome, reason = _text(doc, "outcome"), _text(doc, "reason_code")
    known = F.coalesce(outcome.isin(*REASONS), F.lit(False))
    allowed = F.coalesce(
        F.array_contains(
            F.when(outcome == "promoted", F.array(*map(F.lit, REASONS["promoted"]))).otherwise(
                F.array(*map(F.lit, REASONS["rejected"]))
            ),
            reason,
        ),
        F.lit(False),
    )
    absent = _absent(doc, "champion_version") & _absent(doc, "champion_metric")
    complete = ~is_blank(_text(doc, "champion_version")) & _number(doc, "champion_metric").isNotNull()
    compared = F.coalesce(reason.isin("metric_not_degraded", "metric_below_champion"), F.lit(False))
    first = F.coalesce(reason == "first_champion", F.lit(False))
    is_v1 = (_text(doc, "event") == EVENT) & (_text(doc, "contract_version") == CONTRACT)
    errors = messages(
        (~F.coalesce(is_v1, F.lit(False)), "unknown contract"),
        (~known, "unknown outcome"),
        (known & ~allowed, "reason does not fit the outcome"),
        *[(is_blank(_text(doc, k)), f"{k} is missing") for k in IDS],
        (~F.coalesce(_text(doc, "metric_name") == METRIC, F.lit(False)), "unknown metric"),
        (_number(doc, "candidate_metric").isNull(), "candidate_metric is not a finite number"),
        (first & ~absent, "first champion has a predecessor"),
        (compared & ~complete, "champion is incomplete"),
        (~first & ~compared & ~absent & ~complete, "champion is half given"),
    )
    return parsed.withColumn("errors", errors).drop("_doc")
