"""Isotonic calibration: the non-decreasing fit of labels over scores, without one task for all.

Scores shrink to counts, counts are cut into ranges, and each range pools its own adjacent
violators. Neighbouring ranges are then joined two by two. Two sequences that both rise can
only violate the order with what the left one has above the first of the right one, and
the right one below the last of the left one; just these blocks meet in a task, the
others stay where they are. After as many rounds as doublings the whole sequence rises, and
it is the one that a single pass over all scores gives.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.evaluation import in_ranges
from tidelake.session import cut

BLOCK = "node int, low double, high double, rows long, positives long"


def pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Adjacent blocks merged until their means rise; compared as fractions of whole numbers."""
    blocks = blocks.sort_values("low")
    out: list[list] = []
    for low, high, rows, positives in zip(*(blocks[c].tolist() for c in ("low", "high", "rows", "positives"))):
        out.append([low, high, rows, positives])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, high, rows, positives = out.pop()
            out[-1][1] = high
            out[-1][2] += rows
            out[-1][3] += positives
    found = pd.DataFrame(out, columns=["low", "high", "rows", "positives"])
    found.insert(0, "node", blocks["node"].iloc[0] if len(blocks) else 0)
    return found


def _joined(blocks: DataFrame) -> DataFrame:
    """The blocks of each two neighbouring nodes as one rising sequence under their parent."""
    odd, mean = F.col("node") % 2 == 1, F.col("positives") / F.col("rows")
    rated = blocks.withColumn("odd", odd).withColumn("mean", mean).withColumn("node", F.floor(F.col("node") / 2).cast("int"))
    # one row per parent, and the ends of its two sequences
    ends = rated.groupBy("node").agg(
        F.max(F.when(~F.col("odd"), F.col("mean"))).alias("last"), F.min(F.when(F.col("odd"), F.col("mean"))).alias("first")
    )
    met = rated.join(F.broadcast(ends), "node")
    inside = (F.col("odd") & (F.col("mean") <= F.col("last"))) | (~F.col("odd") & (F.col("mean") >= F.col("first")))
    zone = F.coalesce((F.col("last") >= F.col("first")) & inside, F.lit(False))
    columns = ["node", "low", "high", "rows", "positives"]
    pooled = met.where(zone).select(*columns).groupBy("node").applyInPandas(pool, BLOCK)
    return met.where(~zone).select(*columns).unionByName(pooled)


def isotonic_blocks(df: DataFrame, score: str, label: str, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks (low, high, rows, positives) of rising means, and the counted scores with their range.

    ``ranges`` only spreads the work, by default one per shuffle partition. Rows without a
    score or with another label than 0 and 1 take no part.
    """
    ranges = max(2, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    counted = rows.groupBy(F.col(score).cast("double").alias("_score")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positives")
    )
    counted = cut(in_ranges(counted, [], ranges))
    own = counted.select(
        F.col("_range").alias("node"), F.col("_score").alias("low"), F.col("_score").alias("high"), "rows", "positives"
    )
    blocks = cut(own.groupBy("node").applyInPandas(pool, BLOCK))
    width = 1
    while width < ranges:
        blocks = cut(_joined(blocks))
        width *= 2
    return blocks.drop("node"), counted


def isotonic_scores(df: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """(score, rows, positives, fitted) of every different score.

    A score finds its block inside its own range: a block that spans several ranges starts
    anew in each of them, which adds at most a row per block and a row per range.
    """
    blocks, counted = isotonic_blocks(df, score, label, ranges)
    fitted = F.col("positives") / F.col("rows")
    starts = blocks.select("low", "high", fitted.alias("fitted"))
    # where a block's two ends lie, read from the counted scores they are
    places = counted.select("_score", "_range")
    spans = (
        starts.join(places.select(F.col("_score").alias("low"), F.col("_range").alias("from")), "low")
        .join(places.select(F.col("_score").alias("high"), F.col("_range").alias("to")), "high")
        .select("fitted", "low", "from", F.explode(F.sequence("from", "to")).alias("_range"))
        .select(
            "_range",
            F.when(F.col("_range") == F.col("from"), F.col("low")).otherwise(F.lit(float("-inf"))).alias("_score"),
            "fitted",
        )
    )
    merged = counted.unionByName(spans, allowMissingColumns=True)
    walk = Window.partitionBy("_range").orderBy("_score", F.col("fitted").isNull())
    return (
        merged.withColumn("fitted", F.last("fitted", ignorenulls=True).over(walk))
        .where(F.col("rows").isNotNull())
        .select(F.col("_score").alias(score), "rows", "positives", "fitted")
    )
