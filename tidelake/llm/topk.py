"""Exact top-k search by inner product with pivot-table elimination.

Every vector carries its distances to fixed pivots. By the triangle inequality the
largest difference of two vectors' distances to any pivot is a lower bound of the
distance between them, and with |q|^2 + |c|^2 - d^2 = 2 q.c an upper bound of their inner
product. A query looks at candidates in order of that bound, best first, and stops when
the next bound is below its k-th best score; all others are eliminated without a product.

The pivots are a bounded sample of the vectors; they change how much is eliminated and
never the result. Queries meet all rows in blocks: query and candidate blocks of bounded
size, one pair to a group, each of which returns at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import stored

PIVOTS = 16
QUERY_BLOCK = 2048
ROW_BLOCK = 16384


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null or not finite."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(
        as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(finite, F.transform(as_double, lambda x: F.floor(x * scale)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as one array; a shorter vector continues with zeros."""
    lengths = np.asarray(column.combine_chunks().value_lengths())
    out = np.zeros((len(lengths), width), np.int64)
    flat = np.asarray(column.combine_chunks().flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    at = 0
    for row, n in zip(out, lengths):
        row[:n] = flat[at : at + n]
        at += n
    return out


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    away = vectors[:, None, :].astype(np.float64) - pivots[None, :, :]
    return np.sqrt((away * away).sum(axis=2))


def best_of_block(
    q_ids: np.ndarray, queries: np.ndarray, q_far: np.ndarray,
    c_ids: np.ndarray, rows: np.ndarray, c_far: np.ndarray, k: int, step: int = 512,
) -> tuple[list[int], list[int], list[int]]:
    """(query, candidate, score) of each query's k best of a block; candidates sorted by id."""
    real_q, real_c = queries.astype(np.float64), rows.astype(np.float64)
    q_norm, c_norm = (real_q**2).sum(axis=1), (real_c**2).sum(axis=1)
    columns = np.ascontiguousarray(c_far.T)
    whole = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(rows.shape[1], 1) < 2**53
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for i, me in enumerate(q_ids):
        low = np.abs(columns[0] - q_far[i, 0])
        for p in range(1, len(columns)):
            np.maximum(low, np.abs(columns[p] - q_far[i, p]), out=low)
        bound = (q_norm[i] + c_norm - low * low) / 2
        bound += 1e-6 + 1e-9 * (q_norm[i] + c_norm)  # rounding never eliminates
        bound[c_ids == me] = -np.inf
        scores = np.zeros(0, np.int64)
        ids = np.zeros(0, np.int64)
        left, take = np.arange(len(c_ids)), step
        while len(left):
            if len(left) > take:
                cut = np.argpartition(-bound[left], take - 1)
                now, left = left[cut[:take]], left[cut[take:]]
            else:
                now, left = left, left[:0]
            now = now[bound[now] > -np.inf]
            if not whole:
                got = rows[now] @ queries[i]
            elif 8 * len(now) > len(c_ids):  # most of the block: one pass over it beats gathering rows
                got = (real_c @ real_q[i])[now].astype(np.int64)
            else:
                got = (real_c[now] @ real_q[i]).astype(np.int64)
            scores, ids = np.concatenate((scores, got)), np.concatenate((ids, c_ids[now]))
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            if len(scores) == k:
                left = left[bound[left] >= scores[-1]]
            take *= 8
        out[0].extend([int(me)] * len(ids))
        out[1].extend(ids.tolist())
        out[2].extend(scores.tolist())
    return out


def _blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    pivots: int = PIVOTS,
    query_block: int = QUERY_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query by integer inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows.
    Ties go to the smaller id. Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part. A shorter vector continues with zeros. Rows that
    repeat an id are one row, that with the smallest vector. Scores are exact while they
    fit into 63 bits. A query with fewer than k candidates gets them all; no query, no row.
    """
    whole = stored(
        vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"))
        .filter("id IS NOT NULL AND v IS NOT NULL")
        .groupBy("id")
        .agg(F.min("v").alias("v")),
        "topk-vectors",
    )
    facts = whole.agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col("id") % every == 0, 1)).alias("queries"),
        F.max(F.size("v")).alias("width"),
    ).first()
    width = max(facts["width"] or 1, 1)
    q_blocks, c_blocks = _blocks(facts["queries"], query_block), _blocks(facts["rows"], row_block)
    sample = whole.orderBy(F.xxhash64("id")).limit(pivots).toArrow()
    table = _matrix(sample["v"], width).astype(np.float64) if sample.num_rows else np.zeros((1, width))

    def measure(batches):
        for batch in batches:
            far = pivot_distances(_matrix(pa.chunked_array([batch.column("v")]), width), table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(list(far), pa.list_(pa.float64()))],
                names=["id", "v", "far"],
            )

    def pair(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple = ([], [], [])
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            found = best_of_block(
                np.asarray(left["id"]), _matrix(left["v"], width), np.array(left["far"].to_pylist()),
                np.asarray(right["id"]), _matrix(right["v"], width), np.array(right["far"].to_pylist()), k,
            )
        return pa.table(
            {n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), found)}
        )

    measured = stored(whole.mapInArrow(measure, "id long, v array<long>, far array<double>"), "topk-table")
    cell = [F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int") for salt, n in (("q", q_blocks), ("c", c_blocks))]
    queries = measured.filter(F.col("id") % every == 0).select(
        "id", "v", "far", cell[0].alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb")
    )
    rows = measured.select(
        "id", "v", "far", cell[1].alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")
    )
    met = queries.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb"))
    best = met.applyInArrow(pair, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
