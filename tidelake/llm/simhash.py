"""SimHash near-dedup with pivot distance tables.

Each document gets a 64-bit fingerprint of its word shingles. Two fingerprints within
``radius`` 2 agree on at least two of four 16-bit blocks, so every link meets under one
of six block pairs. There a table of distances to 16 fixed reference fingerprints screens
the pairs: by the triangle inequality a pair whose distances to any reference differ by
more than the radius cannot link, so the largest coordinate difference discards it; the
survivors are verified by their own distance. The screen is part of the join condition,
pairs that fail it are never written.

A block key shared by more than ``dense`` fingerprints does not compare its pairs. Its
members write themselves and their 64 one-bit neighbours; two fingerprints are within 2
bits exactly when they share such a neighbour, and at most 65 fingerprints can. That way
is exact as well and grows with the number of members, not of pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import ROW, packed, stored, text_slices
from tidelake.llm.components import components

RADIUS = 2
PIVOTS = 16
DENSE = 64


def _long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints from a rule: the hash of their number."""
    return [_long(xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42)) for i in range(count)]


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space. Fewer words than the
    width give one shingle of all of them, no word gives none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[s:e] for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))


def fingerprint(text: str, width: int = 3) -> int:
    """The fingerprint of a text's shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray, block: int = 4096) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), block):
        octets = hashes[start : start + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) per row; text_key tells rows of one id apart. Null text: empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values = [_long(fingerprint(t or "", width)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(values, pa.int64())],
                names=["doc_id", "text_key", "fp"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _block_keys(fp: Column) -> Column:
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [
        F.lit(n << 32) + block[i] * F.lit(1 << 16) + block[j]
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ]
    return F.array(*(k.cast("long") for k in keys))


def distance_table(fp: Column, count: int = PIVOTS) -> list[Column]:
    """Distances to the references, eight to a long, one byte each."""
    far = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in pivots(count)]
    packs = []
    for start in range(0, count, 8):
        pack = far[start]
        for i, d in enumerate(far[start + 1 : start + 8], 1):
            pack = pack + F.shiftleft(d, 8 * i)
        packs.append(pack.alias(f"t{start // 8}"))
    return packs


def _screen(left: str, right: str, radius: int) -> Column:
    """True where no coordinate of the two distance tables differs by more than the radius."""
    ok = F.lit(True)
    for i in range(PIVOTS):
        a, b = (
            F.shiftrightunsigned(F.col(f"{side}.t{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(0xFF))
            for side in (left, right)
        )
        ok = ok & (F.abs(a - b) <= radius)
    return ok


def fingerprint_links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links between different fingerprints that span every group of linked ones.

    ``fps`` has distinct values in column fp. Sparse block keys give each of their links,
    dense ones at least a link along every shared one-bit neighbour.
    """
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(keyed.join(shared, "key"), "simhash-met")
    sparse = met.filter(F.col("members") <= dense).select("key", "fp", *distance_table(F.col("fp")))
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    verified = (
        sparse.alias("x")
        .join(
            sparse.alias("y"),
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.fp") < F.col("y.fp"))
            & _screen("x", "y", RADIUS)
            & near,
        )
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_long(1 << i))) for i in range(64)))
    around = met.filter(F.col("members") > dense).select("fp").distinct()
    around = around.select("fp", F.explode(flips).alias("near"))
    crowded = (
        around.groupBy("near")
        .agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    return verified.union(crowded)


def _clustered(marks: DataFrame, dense: int) -> DataFrame:
    """The marks with group: the smallest fingerprint reachable."""
    roots = components(fingerprint_links(marks.select("fp").distinct(), dense))
    return marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "group", F.coalesce("root", "fp")
    )


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, dense: int = DENSE
) -> DataFrame:
    """One row per document: doc_id, text_key, fingerprint (16 hex digits), component_id, keep_key.

    component_id is the smallest id reachable over links of 2 or fewer differing bits, the
    document itself included; exact copies share a fingerprint and so a component. Texts
    without words (null, empty, white space) have fingerprint zero and link like any
    other. A null id is never a component's id unless all its ids are null. Repeated rows
    each give a row. keep_key tells which text of component_id stays, should the id repeat.
    """
    marks = stored(fingerprints(docs, id_col, text_col, width), "simhash-marks")
    rooted = stored(
        _clustered(marks.groupBy("fp").agg(_first("doc_id", "text_key").alias("first")), dense), "simhash-roots"
    )
    named = rooted.groupBy("group").agg(F.min("first").alias("least"))
    ids = rooted.join(named, "group").select("fp", "least")
    return marks.join(ids, "fp").select(
        "doc_id",
        "text_key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        F.col("least.text_key").alias("keep_key"),
    )


def _first(id_col: str, key: str) -> Column:
    """The smallest id, nulls last; ties to the smaller text key."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col), F.col(key)))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of which near_dedup keeps the document, with the columns of the input.

    Rows that repeat both the id and the text of the one that stays are one document and stay.
    """
    stays = (
        near_dedup(docs, id_col, text_col, **options)
        .select(F.col("component_id").alias("id"), F.col("keep_key").alias("key"))
        .distinct()
    )
    return rows_that_stay(docs, stays, id_col, text_col)


def rows_that_stay(docs: DataFrame, stays: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of the documents (id, key) that stay, with the columns of the input."""
    rows = packed(
        docs,
        id=F.col(id_col).cast("long"),
        key=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    )
    same = rows["id"].eqNullSafe(stays["id"]) & (rows["key"] == stays["key"])
    return rows.join(stays, same, "left_semi").select(f"{ROW}.*")
