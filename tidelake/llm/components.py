"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import drop_path, stored_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours its smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return (
        edges.join(least, "b")
        .select(
            F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")
        )
        .union(least.select(F.col("m").alias("a"), "b"))
        .distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; the root is its smallest reachable node.

    Nodes are longs. Each round is two grouped minima and two joins on a written table,
    so no round depends on the lineage of the one before, and nothing but a row count and
    a checksum reaches the driver. A hub's links are split by skewed-join handling, its
    minimum is reduced in the map tasks. The number of rounds grows with the logarithm of
    the longest chain. Self links, repeated links and links with a null count for nothing.
    """
    spark = links.sparkSession
    edges, path = stored_at(
        links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "links",
    )
    seen = _digest(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after, new_path = stored_at(_small_star(_large_star(edges)), "links")
        now = _digest(after)
        drop_path(spark, path)
        edges, path = after, new_path
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
