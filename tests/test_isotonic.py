import random
from fractions import Fraction

import pandas as pd
import pytest

from tidelake.operators.isotonic import isotonic_blocks, isotonic_scores, pool


def plain(rows):
    """score: fitted mean, by one pass over all counted scores."""
    counts = {}
    for score, label in rows:
        if score is not None and label in (0, 1):
            n, p = counts.get(score, (0, 0))
            counts[score] = n + 1, p + label
    blocks = []
    for score in sorted(counts):
        blocks.append([[score], *counts[score]])
        while len(blocks) > 1 and Fraction(blocks[-2][2], blocks[-2][1]) >= Fraction(blocks[-1][2], blocks[-1][1]):
            scores, n, p = blocks.pop()
            blocks[-1] = [blocks[-1][0] + scores, blocks[-1][1] + n, blocks[-1][2] + p]
    return {s: p / n for scores, n, p in blocks for s in scores}


def cases():
    rng = random.Random(17)
    n = 1500
    yield "signal", [(x := round(rng.random(), 3), int(rng.random() < x)) for _ in range(n)]
    yield "none", [(float(rng.randrange(400)), rng.randrange(2)) for _ in range(n)]
    yield "falling", [(float(i % 300), int(rng.random() > (i % 300) / 300)) for i in range(n)]
    yield "rising", [(float(i), int(i >= 700)) for i in range(n)]
    yield "one score", [(1.0, i % 2) for i in range(50)]
    yield "gaps", [(rng.choice([None, -1e9, 0.0, 1e9]), rng.choice([0, 1, None, 7])) for _ in range(200)]


@pytest.mark.parametrize("ranges", [3, 16])
@pytest.mark.parametrize("name, rows", list(cases()), ids=[n for n, _ in cases()])
def test_equals_a_single_pass(spark, name, rows, ranges):
    df = spark.createDataFrame(rows, "p double, label int")
    got = {r.p: r.fitted for r in isotonic_scores(df, "p", "label", ranges).collect()}
    want = plain(rows)
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-12)


def test_blocks_rise_and_cover_all_rows(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.random(), rng.randrange(2)) for _ in range(800)], "p double, label int")
    blocks, _ = isotonic_blocks(df, "p", "label", 8)
    rows = sorted(blocks.collect())
    means = [r.positives / r.rows for r in rows]
    assert means == sorted(set(means)) and sum(r.rows for r in rows) == 800
    assert all(a.high < b.low for a, b in zip(rows, rows[1:]))


def test_an_empty_table(spark):
    assert isotonic_scores(spark.createDataFrame([], "p double, label int"), "p", "label", 4).count() == 0


def test_pool_compares_whole_numbers():
    big = 10**17
    rows = pd.DataFrame({"node": [0, 0], "low": [1.0, 2.0], "high": [1.0, 2.0], "rows": [big, big], "positives": [big - 1, big - 2]})
    assert len(pool(rows)) == 1
