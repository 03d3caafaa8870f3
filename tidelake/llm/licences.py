"""Licence scans: a trained paragraph classifier, calibrated, confirmed against templates.

Paragraphs are lines. Features are the words and word pairs of the licence templates; an
ordinary line has few of them and a licence line many. A multinomial logistic regression
over their presence is fitted on the driver from the templates, noisy variants of them,
and a bounded sample of corpus lines as ordinary text. Its weights are a small table of
at most ``max_features`` rows, which is broadcast; scoring is joins and sums.

A predicted family is confirmed when a template of that family is found in the line by
most of its word pairs. A line that is neither ordinary nor confidently of a family, or
that no template confirms, is ``unknown``: the threshold is set on held-out variants.

The main path is built-in SQL functions only.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import stored

ORDINARY, UNKNOWN = "none", "unknown"

# fixed values: short notices by which licence families are named
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "This software is released under the BSD license.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 License."],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License.",
        "Licensed under the GPL, version 2 or later.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without permission."],
}


def words_of(line: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and dots between digits."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)*)"), F.lit(1))


def _words(line: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", line.lower())


def _grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def grams_of(words: Column) -> Column:
    """Distinct words and neighbouring pairs."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(F.concat(words, pairs))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, paragraph number, text) of the lines of whole texts; a null text has none."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("paragraph", "line")
    )


def _variants(rng: random.Random, line: list[str], filler: list[list[str]], count: int) -> list[list[str]]:
    """The notice with words lost, and with ordinary words around it."""
    out = [line]
    for _ in range(count - 1):
        kept = [w for w in line if rng.random() > 0.08] or line
        around = rng.choice(filler) if filler and rng.random() < 0.6 else []
        cut = rng.randrange(len(around) + 1)
        out.append(around[:cut] + kept + around[cut:])
    return out


def fit(
    ordinary: list[str], max_features: int = 2000, variants: int = 40, steps: int = 600, rate: float = 2.0,
    penalty: float = 1e-4, seed: int = 11, common: float = 0.01,
) -> dict:
    """Weights per n-gram and class, bias, classes and the calibrated threshold.

    Ordinary lines with over half of some template's pairs are left out of the sample,
    since they are notices themselves. An n-gram that more than the share ``common`` of
    the ordinary lines has is no feature.
    """
    rng = random.Random(seed)
    notices = [(f, _words(t)) for f, ts in TEMPLATES.items() for t in ts]
    pairs = [{f"{a} {b}" for a, b in zip(w, w[1:])} for _, w in notices]
    plain = [w for w in map(_words, ordinary) if w]
    plain = [w for w in plain if all(2 * len(p & _grams(w)) <= len(p) for p in pairs)]
    classes = [ORDINARY, *TEMPLATES]
    samples = [(classes.index(f), v) for f, w in notices for v in _variants(rng, w, plain, variants)]
    samples += [(0, w) for w in plain]
    # a few words of notices far apart are ordinary text, whatever the sample holds
    single = sorted({w for _, words in notices for w in words})
    samples += [(0, rng.sample(single, rng.randrange(1, 7))) for _ in range(len(notices) * variants)]
    rng.shuffle(samples)
    seen = Counter(g for w in plain for g in _grams(w))
    wanted = set().union(*(_grams(w) for _, w in notices))
    features = sorted(g for g in wanted if seen[g] <= common * len(plain))[:max_features]
    index = {g: i for i, g in enumerate(features)}
    x = np.zeros((len(samples), len(features)), np.float32)
    for row, (_, words) in zip(x, samples):
        row[[index[g] for g in _grams(words) if g in index]] = 1
    y = np.array([c for c, _ in samples])
    held = np.arange(len(samples)) % 5 == 0
    w = np.zeros((len(features), len(classes)), np.float32)
    b = np.zeros(len(classes), np.float32)
    one = np.eye(len(classes), dtype=np.float32)[y[~held]]
    for _ in range(steps):
        p = _softmax(x[~held] @ w + b) - one
        w -= rate * (x[~held].T @ p / len(one) + penalty * w)
        b -= rate * p.mean(axis=0)
    logits = x[held] @ w + b
    truth = y[held]
    sharp = min((2.0 ** (k / 4) for k in range(-8, 13)), key=lambda t: _loss(logits / t, truth))
    notice = truth > 0
    best = _softmax(logits / sharp)[notice, 1:].max(axis=1) if notice.any() else np.array([0.5])
    threshold = float(min(0.5, np.quantile(best, 0.02)))
    return {"features": features, "classes": classes, "weights": w / sharp, "bias": b / sharp, "threshold": threshold}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(y)), y] + 1e-9).mean()) if len(y) else 0.0


def train(docs: DataFrame, text_col: str = "text", max_ordinary: int = 3000, **options) -> dict:
    """Fit with at most max_ordinary different corpus lines, those with the smallest hash."""
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("line")).filter("length(line) > 0")
    lines = lines.withColumn("order", F.xxhash64(F.lit("ordinary"), "line"))
    # the smallest different hashes first, so that no text but the sample's is shuffled
    least = lines.select("order").distinct().orderBy("order").limit(max_ordinary).agg(F.max("order")).first()[0]
    sample = lines.filter(F.col("order") <= F.lit(least)).distinct().orderBy("order", "line").limit(max_ordinary)
    return fit([r["line"] for r in sample.collect()], **options)


def _weights(spark: SparkSession, model: dict) -> DataFrame:
    rows = [{"gram": g, "w": [float(v) for v in row]} for g, row in zip(model["features"], model["weights"])]
    return _inline(spark, rows, "gram string, w array<double>")


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_typed(schema)}>>")))


def _typed(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in schema.split(", ")))


def _templates(spark: SparkSession) -> DataFrame:
    rows = []
    for family, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            words = _words(text)
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            rows += [{"gram": p, "family": family, "number": number, "pairs": len(pairs)} for p in pairs]
    return _inline(spark, rows, "gram string, family string, number int, pairs int")


def classify(lines: DataFrame, model: dict, confirm_at: float = 0.7) -> DataFrame:
    """(line, family, score, similarity, confirmed) for every different line that is not ordinary.

    A line without any single word that is a feature is ordinary and is left out before
    its pairs are built.
    """
    spark = lines.sparkSession
    single = [g for g in model["features"] if " " not in g]
    bias, classes = model["bias"], model["classes"]
    known = F.array(*(F.lit(g) for g in single)).cast("array<string>")
    grams = (
        lines.select("line")
        .filter(F.arrays_overlap(words_of(F.col("line")), known))
        .distinct()
        .select("line", F.explode(grams_of(words_of(F.col("line")))).alias("gram"))
    )
    sums = [(F.sum(F.col("w")[i]) + F.lit(float(bias[i]))).alias(f"z{i}") for i in range(len(classes))]
    scored = grams.join(F.broadcast(_weights(spark, model)), "gram").groupBy("line").agg(*sums)
    z = [F.col(f"z{i}") for i in range(len(classes))]
    top = F.greatest(*z)
    total = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    ranked = scored.withColumn("total", total).withColumn("p_none", F.exp(z[0] - top) / F.col("total"))
    best = F.greatest(*z[1:])
    family = F.element_at(F.array(*(F.lit(c) for c in classes[1:])), F.array_position(F.array(*z[1:]), best).cast("int"))
    picked = ranked.select(
        "line", family.alias("family"), (F.exp(best - top) / F.col("total")).alias("score"), "p_none"
    ).filter("p_none < 0.5")
    found = (
        grams.join(F.broadcast(_templates(spark)), "gram")
        .groupBy("line", "family", "number")
        .agg((F.count("*") / F.first("pairs")).alias("part"))
        .groupBy("line", "family")
        .agg(F.max("part").alias("similarity"))
    )
    joined = picked.join(found, ["line", "family"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    sure = (F.col("similarity") >= confirm_at) & (F.col("score") >= model["threshold"])
    return joined.select(
        "line",
        F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.col("family").alias("nearest"),
        F.round("score", 6).alias("score"),
        F.round("similarity", 6).alias("similarity"),
        sure.alias("confirmed"),
    )


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None, confirm_at: float = 0.7,
    **options,
) -> DataFrame:
    """One row per line that is not ordinary text: doc_id, paragraph, family, nearest, score, similarity, confirmed.

    paragraph is the number of the line in its whole text, from 0. family is a licence
    family, or unknown where the score is below the calibrated threshold or no template
    confirms it; nearest is the family with the highest score. Null and empty texts have
    no such line. Equal lines are classified once and get equal rows; a line that a large
    share of the documents has is split in the join. Repeated rows each give their rows.
    """
    model = model or train(docs, text_col, **options)
    lines = lines_of(docs, id_col, text_col)
    classes = stored(classify(lines, model, confirm_at), "licence-lines")
    single = F.array(*(F.lit(g) for g in model["features"] if " " not in g)).cast("array<string>")
    likely = lines.filter(F.arrays_overlap(words_of(F.col("line")), single))
    return likely.join(classes, "line").select(
        "doc_id", "paragraph", "family", "nearest", "score", "similarity", "confirmed"
    )
