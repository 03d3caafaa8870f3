"""Mixing sources to target weights by Pareto order sampling.

A source's target number of words divided by its size is the copies each of its
documents is due. The whole part is allocated to every document; what is left of the
target is filled from the documents in Pareto order: a document with inclusion
probability p and uniform number u ranks by (u / (1 - u)) / (p / (1 - p)), and the sample
is the shortest prefix of that order nearest to the remaining words. The sample has a
fixed size in words, not a random one.

The order is never sorted as a whole. Ranks are counted into ``bins`` bins per source, a
running sum over the bins finds the one in which the words run out, and only that bin
is sorted. ``u`` comes from a digest of the document, so reruns agree.

Everything is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import ROW, packed, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 1 << 16


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(seed: str, id_col: Column, text: Column) -> Column:
    """A number inside (0, 1) from the md5 of seed, id and text."""
    key = F.concat(
        F.lit(f"{seed}|"),
        F.coalesce(id_col.cast("string"), F.lit("")),
        F.lit("|"),
        F.coalesce(text, F.lit("")),
    )
    top = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double")
    return (top + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Targets share the total by weight; none exceeds max_copies times its size, and what a
    full source cannot take is shared again by weight among the others. That is one common
    level L with target = min(limit, L * weight): sources are ordered by limit / weight, and
    L is found at the first that is not full. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    limited = sizes.withColumn(
        "weight", F.element_at(F.array(*(F.lit(w) for w in weights)), nth.cast("int") + 1).cast("long")
    ).withColumn("limit", F.col("source_size") * max_copies)
    ratio = F.col("limit") / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    shares = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = limited.withColumn("level", left / shares).withColumn("open", F.col("level") <= ratio)
    level = F.min(F.when(F.col("open"), F.struct(ratio, F.col("level")))).over(whole)["level"]
    return levelled.withColumn("common", level).select(
        "source",
        "source_size",
        F.least(F.col("limit").cast("double"), F.col("common") * F.col("weight")).alias("target"),
    )


def _due(weight: Column) -> Column:
    return F.least(F.lit(float(MAX_COPIES)), F.col("unit") * weight)


def _rank(copies: Column, u: Column) -> Column:
    """Pareto rank mapped into [0, 1]: r / (1 + r) of the odds ratio; 1 where nothing is due."""
    p = copies - F.floor(copies)
    odds = u * (1 - p)
    return F.when(copies >= MAX_COPIES, F.lit(None).cast("double")).otherwise(odds / (odds + p * (1 - u)))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    seed: str = "mix",
    bins: int = BINS,
) -> DataFrame:
    """One row per source: source, source_size, target, unit, cut.

    A document's due copies are min(3, unit * weight); it takes their whole part, and one
    more if its rank is at most cut. ``weight`` is a positive per-document weight for
    unequal inclusion inside a source (default: equal).
    """
    measured = stored(
        docs.select(
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
            uniform(seed, F.col(id_col), F.col(text_col)).alias("u"),
        ),
        "mix-measured",
    )
    # a source without words still has its place in the order of the weights
    totals = measured.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("weighted")
    )
    aims = targets(totals.select("source", "source_size")).join(
        totals.select(F.col("source").alias("s"), "weighted"), F.col("source").eqNullSafe(F.col("s"))
    )
    aims = stored(
        aims.select("source", "source_size", "target", F.coalesce(F.try_divide("target", "weighted"), F.lit(0.0)).alias("unit")),
        "mix-aims",
    )
    due = _due(F.col("weight"))
    ranked = (
        measured.filter("size > 0")
        .join(aims.select(F.col("source").alias("s"), "unit"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rank", _rank(due, F.col("u")))
        .withColumn("sure", F.floor(due) * F.col("size"))
        .withColumn("bin", F.floor(F.col("rank") * bins))
        .select("source", "size", "rank", "sure", "bin")
    )
    by_bin = ranked.groupBy("source", "bin").agg(
        F.sum("sure").alias("sure"), F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("words")
    )
    in_source = Window.partitionBy("source")
    running = in_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        by_bin.withColumn("sure", F.sum("sure").over(in_source))
        .withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .join(aims.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("wanted", F.col("target") - F.col("sure"))
        .filter(F.col("bin").isNotNull() & (F.col("before") < F.col("wanted")))
    )
    last = edges.groupBy("source").agg(F.max_by(F.struct("bin", "before", "wanted"), "bin").alias("edge"))
    last = last.select(F.col("source").alias("s"), "edge.*")
    inside = ranked.join(
        last.withColumnRenamed("bin", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))
    )
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("total", F.col("before") + upto)
    cuts = reached.groupBy("source").agg(
        # the prefix nearest to what is wanted; the shorter one if two are as near
        F.min_by("rank", F.struct(F.abs(F.col("total") - F.col("wanted")), "rank")).alias("nearest"),
        F.min(F.abs(F.col("total") - F.col("wanted"))).alias("off"),
        F.first(F.col("wanted") - F.col("before")).alias("short"),
        F.first("b").alias("b"),
    )
    # stopping before this bin is nearer when even its first document goes too far over
    cut = F.when(F.col("short") <= F.col("off"), F.col("b") / F.lit(float(bins)) - 1e-12).otherwise(F.col("nearest"))
    cuts = cuts.select(F.col("source").alias("s"), cut.alias("cut"))
    plan = aims.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return stored(
        plan.select("source", "source_size", "target", "unit", F.coalesce("cut", F.lit(-1.0)).alias("cut")),
        "mix-plan",
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    seed: str = "mix",
    bins: int = BINS,
) -> DataFrame:
    """One row per input row: ``row`` (all input columns), doc_id, size, source_size, target, copies, taken.

    copies is how often the mix takes the document, at most 3; taken its words. A null or
    empty text has size 0 and is never taken; a null source is a source of its own, last in
    order. A source without words has size 0 and target 0, and takes its turn in the weights. Rows that repeat id and text share their number and
    so their fate. An empty table gives an empty result.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, weight, seed, bins)
    rows = packed(
        docs,
        doc_id=F.col(id_col),
        name=F.col(source_col).cast("string"),
        size=word_count(F.col(text_col)),
        weight=F.lit(1.0) if weight is None else weight.cast("double"),
        u=uniform(seed, F.col(id_col), F.col(text_col)),
    )
    due = _due(F.col("weight"))
    copies = F.floor(due) + F.when(_rank(due, F.col("u")) <= F.col("cut"), 1).otherwise(0)
    joined = rows.join(plan, F.col("name").eqNullSafe(F.col("source")), "left").withColumn(
        "copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long")
    )
    return joined.select(
        ROW,
        "doc_id",
        "size",
        F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of the input."""
    taken = mixed(docs, **options).filter("copies > 0")
    return taken.select(ROW, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(f"{ROW}.*")
