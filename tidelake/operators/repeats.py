"""Keys that occur more than once in a lake, kept up to date batch by batch.

Every day taken in leaves a filter of its keys: a bitmap per block, in which each key sets
a few bits of the block its hash names. A filter may hold a key that was never put in, and
never misses one that was. New days are asked against all old filters at once, then
against single days, and only days whose filter may hold one of their keys are read, for
those keys alone. The counts are then exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.predicates import none_null
from tidelake.operators.quality import bit_set
from tidelake.session import cut
from tidelake.sources.fs import SharedFs
from tidelake.sources.lake import read_days
from tidelake.sources.online import manifest, merge, read_online

#: Bits of a block: what Spark's bitmap aggregates hold.
BLOCK_BITS = 1 << 15
PROBES = 4
VIEW = "repeats"


def blocks_for(keys_a_day: int, bits_per_key: int = 16) -> int:
    """Blocks of a day's filter; with 16 bits a key about one in 400 foreign keys passes."""
    return max(1, -(-keys_a_day * bits_per_key // BLOCK_BITS))


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(hashed, F.lit(blocks))


def _bits(hashed: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(hashed, F.lit(n)), F.lit(BLOCK_BITS)) for n in range(PROBES)]


def day_filters(df: DataFrame, keys: Sequence[str], blocks: int, day: str = "dt") -> DataFrame:
    """(day, block, bitmap) of the keys of every day; bitmaps are built in the map tasks first."""
    hashed = df.where(none_null(keys)).select(day, _hash(keys).alias("_h"))
    bits = hashed.select(day, _block(F.col("_h"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("_h")))).alias("_bit"))
    return bits.groupBy(day, "block").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def _holds(bitmap: Column, bits: list[Column]) -> Column:
    """True where all bits are set."""
    held = F.lit(True)
    for bit in bits:
        held = held & bit_set(bitmap, bit)
    return held


def repeated_keys(
    new: DataFrame,
    filters: DataFrame | None,
    read: Callable[[list[date]], DataFrame],
    keys: Sequence[str],
    blocks: int,
    day: str = "dt",
) -> tuple[DataFrame, list[date]]:
    """Keys of new days that occur more than once in new and old days together, with their
    copies, and the old days that were read. NULL keys are not counted."""
    fresh = new.where(none_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    if filters is None:
        return fresh.where(F.col("copies") > 1), []
    fresh = cut(fresh.withColumn("_h", _hash(keys)).withColumn("_block", _block(F.col("_h"), blocks)))
    bits = _bits(F.col("_h"))
    whole = filters.groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("_all"))
    somewhere = fresh.join(whole, F.col("_block") == F.col("block")).where(_holds(F.col("_all"), bits)).drop("block", "_all")
    suspects = cut(
        somewhere.join(filters, F.col("_block") == F.col("block"))
        .where(_holds(F.col("bitmap"), bits))
        .select(day, *keys)
    )
    days = sorted(r[0] for r in suspects.select(day).distinct().collect())  # one row a day at most
    fresh = fresh.select(*keys, "copies")
    if not days:
        return fresh.where(F.col("copies") > 1), []
    asked = read(days).select(day, *keys).join(suspects, [day, *keys], "left_semi")
    old = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    both = fresh.unionByName(old).groupBy(*keys).agg(F.sum("copies").alias("copies"))
    return both.where(F.col("copies") > 1), days


def take_in(
    spark: SparkSession, lake: str, state: str, days: Sequence[date], keys: Sequence[str], blocks: int, **scan
) -> list[date]:
    """Take a batch of days of a lake into the record of repeated keys; returns the old days read.

    A day is taken in once. The batch's filters are written first and count from the next
    batch on; the record's manifest is written last, so a lost run is simply run again.
    """
    known = manifest(spark, state, VIEW)
    batch = known["version"] if known else 0
    folders = [f"{state}/filters/batch={n}" for n in range(batch)]
    filters = spark.read.parquet(*folders) if folders else None
    new = read_days(spark, lake, days, **scan)

    def read(old: list[date]) -> DataFrame:
        return read_days(spark, lake, old, **scan)

    found, asked = repeated_keys(new, filters, read, keys, blocks)
    SharedFs(spark, state).delete(f"{state}/filters/batch={batch}")
    day_filters(new, keys, blocks).write.parquet(f"{state}/filters/batch={batch}")
    merge(found, state, VIEW, batch, list(keys), "copies", datetime.now())
    return asked


def repeats(spark: SparkSession, state: str) -> DataFrame:
    """Every key that occurs more than once in the days taken in, with its copies."""
    return read_online(spark, state, VIEW)
