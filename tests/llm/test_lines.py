"""Substring dedup and licence scans against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, awkward, empty
from tidelake.llm import licences, repeats

VOCABULARY = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("a", "e", "ion", "ing", "ot", "und", "er", "ist")]


def sentence(rng, n=12):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def line(rng, sentences=5):
    return " ".join(sentence(rng) for _ in range(sentences))


def changed(rng, text, at_most=1):
    words = text.split()
    for _ in range(at_most):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
    return " ".join(words)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_components(lines):
    """Groups of lines linked at a Jaccard similarity of 0.8, all pairs compared."""
    sets = [shingles(x) for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for i in range(len(lines)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("sparse", [1, 16])
def test_near_lines_against_all_pairs(spark, sparse):
    rng = random.Random(7)
    bases = [line(rng) for _ in range(25)]
    lines = [changed(rng, rng.choice(bases), rng.choice((0, 1, 1, 2, 4))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    rows = repeats.repeated(docs, sparse=sparse, block=20).filter("kind = 'line'").collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.component].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == plain_components(lines)
    for g in groups.values():
        assert [r.doc_id for r in rows if r.doc_id in g and not r.removed] == [min(g)]


def test_spanning_links_join_what_pairs_join():
    rng = random.Random(9)
    bases = [line(rng, 3) for _ in range(6)]
    lines = [changed(rng, rng.choice(bases), rng.choice((1, 2, 3))) for _ in range(90)]
    links = repeats.spanning_links(list(range(90)), [shingles(x) for x in lines])
    root = list(range(90))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for i in range(90):
        groups[find(i)].add(i)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == plain_components(lines)
    assert len(links) < 90


def test_passages_inside_other_lines_are_found_and_clean_documents_left(spark):
    rng = random.Random(11)
    passage = " ".join(sentence(rng, n) for n in (9, 14, 17, 16))
    texts = []
    for i in range(40):
        own = [line(rng) for _ in range(3)]
        if i % 4 == 0:
            own[1] = f"{sentence(rng)[:-1]} {passage} {sentence(rng).lower()}"
        own.append("Released under the MIT License of this small work here.")
        texts.append("\n".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = repeats.repeated(docs).collect()
    assert {r.doc_id for r in rows} == {i for i in range(40) if i % 4 == 0}
    assert all(texts[r.doc_id][r.start : r.end] in passage and (r.removed == (r.doc_id > 0)) for r in rows)
    assert sum(r.words for r in rows if r.doc_id == 4) >= 40
    clean = {r.row.doc_id: r.cleaned for r in repeats.without_repeats(docs).collect()}
    assert clean[0] == texts[0] and clean[1] == texts[1]
    assert len(clean[4].split()) < len(texts[4].split()) - 40


def test_repeats_edges(spark):
    docs = awkward(spark)
    rows = repeats.repeated(docs).collect()
    assert {r.doc_id for r in rows} == {6, 7}  # the two very long lines
    assert [r.removed for r in sorted(rows, key=lambda r: r.doc_id)] == [False, True]
    assert repeats.repeated(empty(spark)).count() == 0
    assert repeats.without_repeats(docs).count() == 15


# licences

def test_notices_are_named_and_confirmed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    notices = [(10_000 + i, f"intro words here\n{t}\nmore", f) for i, (f, t) in enumerate(
        (f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    added = spark.createDataFrame([(i, t) for i, t, _ in notices], "doc_id long, text string")
    rows = licences.scan(docs.union(added)).collect()
    found = {(r.doc_id, r.paragraph): r for r in rows if r.doc_id >= 10_000}
    assert {k: r.family for k, r in found.items()} == {(i, 1): f for i, _, f in notices}
    wanted = {(d.doc_id, n) for d in docs.collect() for n, x in enumerate(d.text.split("\n")) if "icense" in x}
    assert {(r.doc_id, r.paragraph) for r in rows if r.doc_id < 10_000 and r.confirmed} == wanted
    assert all(0 <= r.score <= 1 for r in rows)


def test_unknown_notices_are_not_given_a_family(spark):
    docs = spark.createDataFrame(
        [(1, "Licensed under the Quuxly Freeware License."), (2, "Nothing of the kind, only words of a story."),
         (3, "Licensed under CC BY-NC 4.0. And a long tail of other words that are no notice at all.")],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert 2 not in rows and rows[3].family == "CC-BY-NC"
    assert 1 not in rows or rows[1].family == licences.UNKNOWN


def test_scores_equal_the_model(spark):
    model = licences.fit(["the story of the work", "under a version of it"])
    lines = spark.createDataFrame([("Licensed under the Apache License, Version 2.0.",)], "line string")
    row = licences.classify(lines, model).first()
    grams = licences._grams(licences._words("Licensed under the Apache License, Version 2.0."))
    z = model["bias"] + sum(model["weights"][model["features"].index(g)] for g in grams if g in model["features"])
    p = licences._softmax(z[None, :].astype(float))[0]
    assert row.score == pytest.approx(p[model["classes"].index("Apache-2.0")], abs=1e-5)


def test_licence_plan_is_native_and_edges(spark):
    docs = awkward(spark)
    plan = licences.scan(docs)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text
    plan.collect()
    assert licences.scan(empty(spark)).count() == 0
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert licences.scan(nothing).count() == 0
