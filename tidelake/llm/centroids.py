"""Centroid clustering over a VA-file: few-bit cells decide, full vectors where they cannot.

Every vector is kept twice, as whole numbers and as one cell per dimension, two cells of
four bits to a byte. A cell is an interval of its dimension, so a centroid has a least and a
greatest squared difference to it; tables hold these per byte, and a vector's bounds for
all centroids are sums of table rows. A vector whose least upper bound is below every other
lower bound is decided by its cells. Only where intervals overlap its numbers are unpacked
and measured, and only against the centroids whose intervals do.

The numbers themselves are added up per centroid inside the tasks, so a round shuffles
one row per centroid, dimension and task, whatever the sizes of the clusters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import stored
from tidelake.llm.topk import quantised

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
CELLS = 16
SAMPLE = 2048
#: Squared distances of components up to this size fit into 64 bits; larger ones are kept as Python numbers.
EXACT = 1 << 27
LARGEST = (1 << 63) - 1
#: Stands for "no bound" in the tables; 64 of them still fit.
NO_BOUND = 1 << 56


class VaFile:
    """Cell borders per dimension and the packing of vectors into cells."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Borders at the sample's quantiles; low and high are the extremes of all vectors."""
        shares = np.arange(1, CELLS) / CELLS
        self.borders = [np.quantile(column, shares, method="lower").astype(np.int64) for column in sample.T]
        # cell c of a dimension holds the whole numbers from edges[c] to edges[c + 1] - 1
        self.edges = np.array([[lo, *b, hi + 1] for lo, b, hi in zip(low, self.borders, high)])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Two cells to a byte; even dimensions in the low half."""
        found = np.empty(vectors.shape, np.uint8)
        for d, border in enumerate(self.borders):
            found[:, d] = np.searchsorted(border, vectors[:, d], side="right")
        return found[:, 0::2] | found[:, 1::2] << 4

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared differences: [byte place, byte, centroid]."""
        first, last = self.edges[:, :-1, None], self.edges[:, 1:, None] - 1  # [dimension, cell, 1]
        at = centroids.T[:, None, :]
        below, above = at - first, at - last
        inside = (below >= 0) & (above <= 0)
        least = np.where(inside, 0, np.minimum(below * below, above * above))
        most = np.maximum(below * below, above * above)
        empty = np.broadcast_to(last < first, least.shape)  # no vector has such a cell
        least, most = np.where(empty, NO_BOUND, least), np.where(empty, NO_BOUND, most)
        octet = np.arange(256)
        return tuple(t[0::2][:, octet & 15] + t[1::2][:, octet >> 4] for t in (least, most))


def nearest(
    cells: np.ndarray, unpack, tables: tuple[np.ndarray, np.ndarray], centroids: np.ndarray
) -> tuple[np.ndarray, int]:
    """(nearest centroid of each vector, number of vectors whose numbers were needed).

    ``unpack`` gives the full vectors of a mask of rows. Ties go to the smaller number: a
    centroid whose lower bound equals the least upper bound is still measured.
    """
    least = np.zeros((len(cells), len(centroids)), np.int64)
    most = np.zeros_like(least)
    for place in range(cells.shape[1]):
        least += tables[0][place][cells[:, place]]
        most += tables[1][place][cells[:, place]]
    open_ = least <= most.min(axis=1, keepdims=True)
    found = open_.argmax(axis=1)
    unsure = open_.sum(axis=1) > 1
    if unsure.any():
        row, number = np.nonzero(open_[unsure])
        away = unpack(unsure)[row] - centroids[number]
        far = np.full((int(unsure.sum()), len(centroids)), LARGEST)
        far[row, number] = (away * away).sum(axis=1)
        found[unsure] = far.argmin(axis=1)
    return found, int(unsure.sum())


def _large(values: np.ndarray) -> bool:
    return bool(len(values)) and bool(((values >= EXACT) | (values <= -EXACT)).any())


def _measured(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Every squared distance, in Python numbers: for components that 64 bits are too few for."""
    return np.array([[sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids] for v in vectors.tolist()], object)


def _unpacked(column: pa.Array, mask: np.ndarray | None = None) -> np.ndarray:
    kept = column if mask is None else column.filter(pa.array(mask))
    return np.frombuffer(b"".join(kept.to_pylist()), "<i8").reshape(-1, DIMENSIONS)


def _assigned(batch: pa.RecordBatch, file: VaFile | None, tables, centroids: list[list[int]]) -> np.ndarray:
    """The nearest centroid of each row of a batch with columns cells and v."""
    if file is None:
        return _measured(_unpacked(batch.column("v")), centroids).argmin(axis=1)
    cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(-1, DIMENSIONS // 2)
    return nearest(cells, lambda mask: _unpacked(batch.column("v"), mask), tables, np.array(centroids, np.int64))[0]


def _short(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _extremes(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Smallest and largest number of every dimension; tasks send one row a dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = None
        for batch in _short(batches):
            v = _unpacked(batch.column("v"))
            now = np.array([v.min(axis=0), v.max(axis=0)])
            ends = now if ends is None else np.array([np.minimum(ends[0], now[0]), np.maximum(ends[1], now[1])])
        if ends is not None:
            columns = [np.arange(DIMENSIONS), *ends]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["d", "low", "high"])

    rows = vectors.select("v").mapInArrow(run, "d long, low long, high long").groupBy("d")
    ends = sorted(rows.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    return (np.array([e["low"] for e in ends]), np.array([e["high"] for e in ends])) if ends else None


def _with_cells(vectors: DataFrame, file: VaFile | None) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches):
            if file is None:
                cells = [b""] * batch.num_rows
            else:
                cells = [row.tobytes() for row in file.cells(_unpacked(batch.column("v")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=["id", "v", "cells"])

    return vectors.mapInArrow(run, "id long, v binary, cells binary")


def _moved(rows: DataFrame, file: VaFile | None, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of their vectors, empty ones as they were."""
    tables = file.tables(np.array(centroids, np.int64)) if file else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.int64 if file else object
        sums = np.zeros((len(centroids), DIMENSIONS), kind)
        counts = np.zeros(len(centroids), np.int64)
        for batch in _short(batches):
            own = _assigned(batch, file, tables, centroids)
            order = np.argsort(own, kind="stable")
            heads = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
            sums[own[order][heads]] += np.add.reduceat(_unpacked(batch.column("v")).astype(kind)[order], heads, axis=0)
            counts += np.bincount(own, minlength=len(centroids))
        used = np.flatnonzero(counts)
        cluster, d = np.repeat(used, DIMENSIONS), np.tile(np.arange(DIMENSIONS), len(used))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster), pa.array(d), pa.array(np.repeat(counts[used], DIMENSIONS)),
             pa.array([Decimal(int(x)) for x in sums[used].ravel()], pa.decimal128(38, 0))],
            names=["cluster", "d", "n", "total"],
        )

    added = rows.select("v", "cells").mapInArrow(run, "cluster long, d long, n long, total decimal(38,0)")
    after = [list(c) for c in centroids]
    totals = added.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    for r in totals.collect():  # one row per centroid and dimension
        after[r["cluster"]][r["d"]] = int(r["total"]) // r["n"]
    return after


def _placed(rows: DataFrame, file: VaFile | None, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector; distances beyond 63 bits become the largest long."""
    tables = file.tables(np.array(centroids, np.int64)) if file else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches):
            own = _assigned(batch, file, tables, centroids)
            if file:
                away = _unpacked(batch.column("v")) - np.array(centroids, np.int64)[own]
                far = (away * away).sum(axis=1)
            else:
                far = [min(d[c], LARGEST) for d, c in zip(_measured(_unpacked(batch.column("v")), centroids), own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"]
            )

    return rows.mapInArrow(run, "id long, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = 256,
    salt: str = "2:",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly 64 components, none of them null or not finite. They become
    floor(scale * x). The start is the ``centroids`` vectors with the smallest hash of their
    id; equal hashes (repeated ids) go by the vector, rows without an id come last. With
    fewer vectors there are fewer centroids. Repeated rows are vectors of their own. Ties
    go to the smaller number, an empty centroid stays where it is. Components beyond 64
    bits are cut to the largest long; where squares pass 64 bits every distance is taken
    in Python numbers, without cells, and sums above the largest long become it. No kept
    vector gives an empty result. To the driver come the extremes, at most 2,048 vectors
    for the cell borders, and one row per centroid and dimension a round.
    """
    spark = vectors.sparkSession
    numbers = quantised(F.col(vector_col), scale)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), numbers.alias("numbers")).filter(F.size("numbers") == DIMENSIONS)
    kept = stored(_packed_numbers(kept), "cluster-vectors")
    ends = _extremes(kept)
    if ends is None:
        return spark.createDataFrame([], RESULT)
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "v").limit(max(SAMPLE, centroids)).toArrow()
    sample = _unpacked(first["v"].combine_chunks())
    at = [[int(x) for x in row] for row in sample[:centroids]]
    file = None if _large(np.array(ends)) else VaFile(sample, *ends)
    rows = stored(_with_cells(kept, file), "cluster-cells")
    for _ in range(rounds):
        at = _moved(rows, file, at)
    placed = stored(_placed(rows, file, at), "cluster-placed")

    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()
    inertia = {r["cluster"]: int(r["far"]) for r in sums}  # one row per centroid
    whole = min(sum(inertia.values()), LARGEST)
    named = spark.createDataFrame(
        [(c, min(far, LARGEST), whole, ",".join(map(str, at[c]))) for c, far in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, numbers string",
    )
    facts = named.select("cluster", "cluster_inertia", "inertia", F.sha2("numbers", 256).alias("centroid_sha256"))
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _packed_numbers(kept: DataFrame) -> DataFrame:
    """(id, v): the numbers of a vector as little-endian 64-bit integers in one binary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches):
            numbers = np.asarray(batch.column("numbers").flatten()).astype("<i8").reshape(-1, DIMENSIONS)
            packed = pa.array([row.tobytes() for row in numbers], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed], names=["id", "v"])

    return kept.mapInArrow(run, T.StructType([kept.schema["id"], T.StructField("v", T.BinaryType())]))
