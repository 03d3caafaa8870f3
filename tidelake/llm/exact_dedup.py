"""Exact dedup: a two-pass Bloom filter finds what may repeat; only that is shuffled.

Pass one counts how many rows fall on each slot of a filter of ``bits`` slots, with
``hashes`` slots a row; slots hit by more than one row become the filter's set bits. Pass
two tests every row: one with a slot that nobody else hits is unique for certain and
passes straight through with its columns. The rest, the repeats and a few false
positives, are grouped by digest, which is exact. The filter is broadcast; its size is
``bits / 8`` bytes whatever the input. A filter too small for its input makes more rows
take the grouped way and never changes a result.

Everything is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import ROW, packed, stored

#: Slots a filter block holds: the fixed size of Spark's bitmap aggregate.
BLOCK_BITS = 1 << 15


def _slots(text: str, bits: int, hashes: int) -> list[Column]:
    base = F.xxhash64(text)
    return [F.pmod(F.xxhash64(base, F.lit(j)), F.lit(bits)) for j in range(hashes)]


def block_of(slot: Column) -> Column:
    return F.floor(slot / F.lit(BLOCK_BITS)).cast("long")


def key_bitmaps(slots: DataFrame) -> DataFrame:
    """(block, bitmap) with a set bit for every value of column slot."""
    return (
        slots.select(block_of(F.col("slot")).alias("block"), F.pmod("slot", F.lit(BLOCK_BITS)).alias("bit"))
        .repartition("block")
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def repeat_bitmaps(slots: DataFrame) -> DataFrame:
    """(block, bitmap) with a set bit for every slot that more than one row falls on."""
    return key_bitmaps(slots.groupBy("slot").count().filter("count > 1"))


def test_bit(bitmap: Column, position: Column) -> Column:
    byte = F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))
    return F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(position, F.lit(8)).cast("int")) == 1


def repeat_filter(rows: DataFrame, text: str, bits: int, hashes: int) -> DataFrame:
    return repeat_bitmaps(rows.select(F.explode(F.array(*_slots(text, bits, hashes))).alias("slot")))


def mark_suspects(rows: DataFrame, text: str, bits: int, hashes: int) -> DataFrame:
    """The rows with ``suspect``: false only where no other row has the same text."""
    blocks = F.broadcast(repeat_filter(rows, text, bits, hashes))
    suspect = F.lit(True)
    for j, slot in enumerate(_slots(text, bits, hashes)):
        part = blocks.select(F.col("block").alias(f"block{j}"), F.col("bitmap").alias(f"bitmap{j}"))
        rows = rows.withColumn(f"slot{j}", slot)
        rows = rows.join(part, block_of(F.col(f"slot{j}")) == F.col(f"block{j}"), "left")
        known = test_bit(F.col(f"bitmap{j}"), F.pmod(F.col(f"slot{j}"), F.lit(BLOCK_BITS)))
        suspect = suspect & F.coalesce(known, F.lit(False))
    extra = [f"{n}{j}" for j in range(hashes) for n in ("slot", "block", "bitmap")]
    return rows.withColumn("suspect", suspect).drop(*extra)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 1 << 26, hashes: int = 2
) -> DataFrame:
    """One row per input row: ``row`` (all input columns), doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row
    with the largest id stays. A null id is smaller than any other; a group with null ids
    only has a null keep_id and its rows are kept. Rows that tie on the largest id are
    repeats of one document: each is marked kept, ``dedup_rows`` leaves one of them. An
    empty table gives an empty result.
    """
    rows = packed(docs, id=F.col(id_col), text=F.coalesce(F.col(text_col), F.lit("")))
    marked = mark_suspects(rows, "text", bits, hashes).withColumn("text_sha256", F.sha2("text", 256))
    unique = marked.filter(~F.col("suspect")).select(
        ROW,
        F.col("id").alias("doc_id"),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    suspects = marked.filter("suspect")
    # written, so that both sides of the join are dealt by it and a hot group can be split
    groups = stored(
        suspects.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")),
        "dedup-groups",
    )
    grouped = suspects.join(groups, "text_sha256").select(
        ROW,
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
    return unique.unionByName(grouped)


def dedup_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of the input; one row per distinct text.

    Only groups of several rows meet in an exchange to settle ties on the largest id.
    """
    marked = exact_dedup(docs, **options).filter("kept")
    single = marked.filter("group_size = 1").select(f"{ROW}.*")
    tied = marked.filter("group_size > 1").dropDuplicates(["text_sha256"]).select(f"{ROW}.*")
    return single.union(tied)
