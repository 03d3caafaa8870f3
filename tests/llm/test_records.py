"""PII, WARC and top-k search against plain Python."""

from __future__ import annotations

import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, awkward, empty
from tidelake.llm import pii, topk, warc

# the contract's patterns as they are written
PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                True,
                all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and sum(
                    sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                9 <= len(digits) <= 15,
            )[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{(*pii.KINDS, pii.TERM)[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_equal_the_written_patterns():
    rng = random.Random(5)
    parts = ["a@b.c", "@", "x.y+z@", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8",
             "+49 (30) 123-45.67", "+1", "..", "-", " ", "é", "_", "0001.2.3.4", "%", "a", "7", "+", "(", ")", "@c.d-e", "1234567890123"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "(" * 300_000, "a@" * 100_000, "1." * 100_000, "1 " * 100_000):
        pii.base_spans(text)
    zeros = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(zeros) == [(0, 1, len(zeros))]
    assert pii.base_spans("1" + zeros) == []
    assert pii.base_spans(".".join(["0" * 300_000] * 4))[0][1] == 1


def test_words_leave_out_those_under_spans():
    rng = random.Random(9)
    parts = ["ann@ex.org", "10.0.0.7", "+49 30 123 45 67", "4111 1111 1111 1111", "Walter", "of", "x", "42", "né", "_id", "İx"]
    for _ in range(500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        spans = plain_spans(text)
        want = {
            (m[0].lower(), *m.span()) for m in re.finditer(r"\w\w+", text)
            if all(m.end() <= a or m.start() >= b for a, _, b in spans)
        }
        assert set(pii.words(text, spans)) == want
        assert pii._terms(text, spans) == {t for t, _, _ in want}


def test_many_mentions_in_one_text():
    text = "ann@ex.org wrote to 10.0.0.7 today. " * 20_000
    assert len(list(pii.words(text, pii.base_spans(text)))) == 60_000


def test_the_filter_knows_its_terms(spark):
    terms = [f"wörd{i}" for i in range(3000)]
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    bitmap = pii.term_filter(frame, 16, 1 << 27)
    assert len(bitmap) * 8 == 1 << 16 and all(pii._in_filter(t, bitmap) for t in terms)
    assert sum(pii._in_filter(f"other{i}", bitmap) for i in range(3000)) < 300
    assert len(pii.term_filter(frame, 16, 1 << 15)) * 8 == 1 << 15


def test_report_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        spans = [s for s in r.spans.split(",") if s and not s.startswith("term")]
        assert spans == [s for s in joined(base).split(",") if s]


def plain_terms(texts, generalise_at=0.8, hidden_at=2.5, remove_at=1.0, z=1.96):
    """(start, end, removed) of disclosing terms per text: every entity with every term, in dictionaries."""
    n = len(texts)
    has, df, held = defaultdict(set), defaultdict(set), []
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        for start, kind, end in spans:
            value = t[start:end].lower() if kind < 2 else re.sub("[^0-9]", "", t[start:end])
            has[kind, value].add(i)
        held.append([
            (m[0].lower(), *m.span()) for m in re.finditer(r"\w\w+", t) if all(m.end() <= a or m.start() >= b for a, _, b in spans)
        ])
        for w, _, _ in held[i]:
            df[w].add(i)
    tells = {}
    for w, rows in df.items():
        for at in has.values():
            co, trials = len(rows & at), len(rows)
            if co and len(at) < n:
                share = co / trials
                low = (share + z * z / (2 * trials) - z * math.sqrt(share * (1 - share) / trials + z * z / (4 * trials**2))) / (1 + z * z / trials)
                hidden = -math.log2(low)
                if hidden <= hidden_at and 1 - hidden / math.log2(n / len(at)) >= generalise_at:
                    tells[w] = tells.get(w, False) or hidden <= remove_at
    return [sorted((s, e, tells[w]) for w, s, e in words if w in tells) for words in held]


def found_terms(docs, **options):
    return {r.row.doc_id: [tuple(t) for t in r.terms] for r in pii.find(docs, **options).collect()}


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(1)
    filler = "the of and to in for with on at by".split()
    texts = [" ".join(rng.choice(filler) for _ in range(40)) for _ in range(400)]
    texts += ["the contact Mister Quimby " + "of the " * 100 + f"x{i % 4} the q@z.org by and" for i in range(6)]
    texts += ["about Quimby the of", "call +49 30 1234567 the of Walther", "Walther the", "only Zwack 10.0.0.1 10.0.0.2", None]
    texts += [f"list {' '.join(f'm{i}@list.org' for i in range(300))} " + " ".join(f"item{i}" for i in range(300))] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    expected = plain_terms([t or "" for t in texts])
    assert found_terms(docs) == dict(enumerate(expected))
    assert found_terms(docs, most_filter_bits=1 << 15) == dict(enumerate(expected))
    loose = dict(generalise_at=0.5, hidden_at=6.0, remove_at=3.0, z=1.0)
    assert found_terms(docs, **loose) == dict(enumerate(plain_terms([t or "" for t in texts], **loose)))
    # Mister is found with the entity alone, Quimby also where none is named: 6 of 7 documents
    assert (12, 18, True) in expected[400] and expected[406] == [(6, 12, False)]
    clean = {r.row.doc_id: r.sanitised for r in pii.sanitise(docs).collect()}
    assert "q@z.org" not in clean[400] and "[EMAIL]" in clean[400] and "Mister" not in clean[400]
    assert clean[406] == "about [NAME] the of" and clean[0] == texts[0] and clean[410] is None


def test_terms_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    expected = plain_terms([t or "" for _, t in rows])
    assert found_terms(docs) == {i: terms for (i, _), terms in zip(rows, expected)}
    assert sum(map(len, expected)) > 0


def test_pii_edges(spark):
    docs = awkward(spark)
    rows = pii.report(docs).collect()
    assert len(rows) == 15 and sum(r.n_email for r in rows) == 1
    assert pii.report(empty(spark)).count() == 0
    assert pii.sanitise(docs).count() == 15


# WARC

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string, first string")


ROWS = [
    (5, "http://a/\r\nX: y", "é" * 60, "p", "d", "f"),
    (3, "http://b/", "é" * 60, "p", "d", "f"),
    (3, "http://b/", "é" * 60, "p", "d", "f"),
    (None, None, "é" * 60, "p", "d", "f"),
    (7, "http://c/", "short", "p", "d", "f"),
    (8, "http://d/", "short", "p", "d", "f"),
    (9, "http://e/", None, "p", "d", "f"),
    (10, "http://f/", "", None, None, None),
    (11, "http://g/", "x\r\n\r\n" * 200_000, "p", "d", "f"),
    (12, "http://h/", "x\r\n\r\n" * 200_000 + "WARC/1.1\r\n", "p", "d", "f"),
]


def test_round_trip_rules(spark):
    found = sorted(map(tuple, warc.round_trip(pages(spark, ROWS)).collect()), key=repr)
    expected = []
    for i, _, html, *_ in ROWS:
        data = (html or "").encode()
        first = min((r[0] for r in ROWS if r[2] == html and r[0] is not None), default=None)
        revisit = len(data) >= 100 and i != first
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert found == sorted(expected, key=repr)
    assert warc.round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_archives_rotate_and_keep_payloads(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/pages.parquet")
    manifest = warc.write_archives(source, str(tmp_path), archive_bytes=20_000)
    named = [r.archive for r in manifest.collect()]
    assert len(named) > 3 and set(named) == set(os.listdir(tmp_path))
    back = warc.read_archives(manifest, str(tmp_path)).filter("record_type = 'response'").collect()
    html = {r.page_id: r.html for r in source.collect()}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in back)
    # any reader of gzip sees the records one after the other
    with open(tmp_path / named[0], "rb") as file:
        first = next(iter(warc.read_records(io.BytesIO(file.read()))))
    assert first["record_type"] == "response"


def test_reader_refuses_damage():
    page = {"page_id": 1, "url": "u", "payload": "hello " * 50, "refers_to": None}
    good = warc.record(page, "2020-01-01T00:00:00Z")
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(good * 3))] == [1, 1, 1]
    plain = zlib.decompress(good, 31)
    for broken in (plain.replace(b"hello", b"hallo", 1), plain.replace(b"Content-Length: ", b"Content-Length: 9", 1),
                   plain + b"x", b"HTTP/1.1" + plain[8:]):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(packer.compress(broken) + packer.flush())))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(io.BytesIO(good[:-20])))


# top-k

def plain_top(rows, every, k):
    ids, vectors = zip(*rows)
    width = max(map(len, vectors))
    table = np.array([list(v) + [0] * (width - len(v)) for v in vectors], object)
    out = set()
    for i, q in zip(ids, table):
        if i % every == 0:
            scored = sorted((-int(sum(a * b for a, b in zip(q, c))), j) for j, c in zip(ids, table) if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def quantise(v):
    return [math.floor(64 * float(x)) for x in v]


@pytest.mark.parametrize("blocks", [(2048, 16384), (3, 17)])
def test_top_k_against_all_products(spark, blocks):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(0, 1, 6).astype(np.float32) for _ in range(150)]
    vectors[40] = vectors[41] = vectors[0]
    vectors[10] = np.zeros(6, np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {tuple(r) for r in topk.top_k(frame, query_block=blocks[0], row_block=blocks[1]).collect()}
    assert found == plain_top([(i, quantise(np.float32(v))) for i, v in rows], 20, 20)


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (40, None), (60, [nan, 1.0]), (80, [None, 1.0]), (100, []), (None, [9.0, 9.0]),
            (1, [float("inf"), 0.0]), (2, [-1.0, 0.5]), (2, [-1.0, 0.5]), (3, [2.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "vec_id long, embedding array<float>, rank int, score string, far string")
    found = {tuple(r) for r in topk.top_k(frame).collect()}
    valid = [(0, [1, 2]), (20, [1]), (100, []), (2, [-1, 0.5]), (3, [2, 2])]
    assert found == plain_top([(i, quantise(v)) for i, v in valid], 20, 20)
    assert topk.top_k(frame.limit(0)).count() == 0
    lone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(lone).count() == 0


def test_elimination_skips_candidates():
    """Far clusters are never multiplied: their bound is below the k-th best score."""
    rng = np.random.default_rng(4)
    near, far = rng.integers(90, 110, (40, 8)), rng.integers(-110, -90, (4000, 8))
    rows = np.concatenate((near, far))
    pivots = rows[[0, 100]].astype(float)

    measure = topk.pivot_distances(rows, pivots)
    found = topk.best_of_block(np.array([0]), rows[:1], measure[:1], np.arange(len(rows)), rows, measure, 20, step=64)
    exact = sorted(((-int(rows[0] @ r), i) for i, r in enumerate(rows) if i), key=lambda x: x)[:20]
    assert list(zip(found[1], found[2])) == [(i, -s) for s, i in exact]
