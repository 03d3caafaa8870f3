"""Centroid clustering against plain rounds over whole vectors."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
from tests.llm.helpers import SF

from tidelake.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, id string, cluster string, v string"


def plain(rows, count=40, rounds=5):
    """The rows of cluster() with Python numbers."""
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(
        (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), b"".join(x.to_bytes(8, "little", signed=True) for x in v), v)
        for i, v in kept
    )
    at = [v for *_, v in order[:count]]

    def placed():
        far = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in at] for _, v in kept]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        own = placed()
        for c in range(len(at)):
            mine = [v for (_, v), (o, _) in zip(kept, own) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = placed()
    largest = centroids.LARGEST
    inertia = Counter()
    for c, far in own:
        inertia[c] += min(far, largest)
    return Counter(
        (i, c, min(far, largest), min(inertia[c], largest), min(sum(inertia.values()), largest),
         hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest())
        for (i, _), (c, far) in zip(kept, own)
    )


def clustered(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)
    return Counter(tuple(r) for r in centroids.cluster(frame, **options).collect())


def some(rng, n, spread):
    homes = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    return [[float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(homes)] for _ in range(n)]


def test_the_whole_table_equals_plain_rounds(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert Counter(tuple(r) for r in centroids.cluster(table).collect()) == plain(rows)


def test_awkward_vectors(spark):
    rng = random.Random(4)
    good = some(rng, 60, 0.3)
    rows = [
        *enumerate(good), (0, good[0]), (0, good[0]), (5, good[9]), (None, good[3]), (None, good[4]),
        (900, None), (901, []), (902, good[0][:63]), (903, [*good[0], 0.0]), (904, [None, *good[0][1:]]),
        (905, [float("nan"), *good[0][1:]]), (906, [float("-inf"), *good[0][1:]]),
        *((1000 + i, [0.0] * 64) for i in range(12)),  # ties between equal centroids
    ]
    assert clustered(spark, rows) == plain(rows)


def test_few_vectors_and_none(spark):
    rng = random.Random(6)
    rows = list(enumerate(some(rng, 3, 1.0)))
    assert clustered(spark, rows) == plain(rows)
    assert clustered(spark, rows, centroids=2, rounds=1) == plain(rows, 2, 1)
    assert clustered(spark, [(1, None)]) == Counter() == clustered(spark, [])


def test_numbers_too_large_for_cells(spark):
    rng = random.Random(8)
    rows = [(i, [x * 10.0**rng.choice([0, 5, 9]) for x in v]) for i, v in enumerate(some(rng, 50, 0.5))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert clustered(spark, rows) == plain(rows)
    clustered(spark, [*rows, (99, [3e38] * 64), (98, [-3e38] * 64)])


def test_cells_bound_distances_and_spare_vectors():
    rng = np.random.default_rng(2)
    homes = rng.integers(-200, 200, (10, 64))
    vectors = homes[rng.integers(0, 10, 3000)] + rng.integers(-12, 13, (3000, 64))
    file = centroids.VaFile(vectors[:500], vectors.min(axis=0), vectors.max(axis=0))
    cells, tables = file.cells(vectors), file.tables(homes)
    exact = ((vectors[:, None, :] - homes[None]) ** 2).sum(axis=2)
    for least_most, ok in zip(tables, (np.less_equal, np.greater_equal)):
        bound = sum(least_most[p][cells[:, p]] for p in range(32))
        assert ok(bound, exact).all()
    asked = []

    def unpack(mask):
        asked.append(int(mask.sum()))
        return vectors[mask]

    found, unsure = centroids.nearest(cells, unpack, tables, homes)
    assert (found == exact.argmin(axis=1)).all()
    assert unsure < 300 and sum(asked) == unsure
