"""Token alignment against plain tokenization of whole texts."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.llm.helpers import SF, awkward, empty
from tokenizers import Tokenizer

from tidelake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts, ends from decoded bytes alone, every link as it is defined."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = alignment.byte_alphabet()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(False).items() if t != "<|endoftext|>"}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        whole = (" " + text).encode()
        sides = []
        for ids, of in (
            (self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.get),
            (self.b.encode(text), self.b_bytes),
        ):
            parts = [of(i) for i in ids]
            if b"".join(parts) != whole:
                return []
            ends, at = [], 0
            for p in parts:
                at += len(p)
                ends.append(at)
            sides.append((ids, ends))
        (a, a_ends), (b, b_ends) = sides
        common = sorted(set(a_ends) & set(b_ends))
        out = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(sides):
            for i, e in zip(ids, ends):
                out[bisect_left(common, e)][side].append(i)
        return out


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def wanted(plain, texts):
    """The rows of digests() but for the id, by counting every link."""
    cut = [plain.groups(t) for t in texts]
    held = [Counter((x, y) for left, right in g for x in left for y in right) for g in cut]
    count = Counter(pair for links in held for pair in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [
        (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()),
            sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(shown(g).encode()).hexdigest() if g else "",
        )
        for g, links in zip(cut, held)
    ]


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_stretches_and_batches_equal_whole_texts(plain):
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    assert aligner.cuts
    rng = random.Random(3)
    parts = ["the", "Entwicklung", "été", " ", "  ", "\n", " a", "中文", "\U0001f9ff", "é", "'s", "n't", ".", ",", "...", "12", "3.5", "\t", "▁",
             " ", "　", "</s>", "<|endoftext|>", "[INST]", "<0x41>", "\u0000", "x" * 60, "ß", "́", "​", "\r\n", "日", " ，"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(0, 12))) for _ in range(1500)]
    for start in range(0, len(texts), 100):
        batch = texts[start : start + 100]
        for text, found in zip(batch, aligner.texts(batch)):
            groups = plain.groups(text)
            got = alignment._record(found)
            assert got[4] == shown(groups), text
            links = Counter((x, y) for left, right in groups for x in left for y in right)
            pairs = dict(zip(got[5].tolist(), got[6].tolist()))
            assert pairs == {x * alignment.B_IDS + y: n for (x, y), n in links.items()}
            assert got[:4] == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()))


def test_spans_settle_what_they_can():
    import numpy as np

    # h, é (two bytes), an emoji shared by two tokens
    places = np.array([0, 1, 3, 7])
    spans, last = np.array([[0, 1], [1, 2], [2, 3], [2, 3]]), np.array([False, False, False, True])
    assert alignment.byte_ends(spans, last, places, np.array([1, 2, 3, 1])).tolist() == [1, 3, 6, 7]
    assert alignment.byte_ends(spans, last, places, np.array([2, 1, 3, 1])).tolist() == [2, 3, 6, 7]


def test_digests_equal_counting_every_link(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *w) for (i, _), w in zip(texts, wanted(plain, [t for _, t in texts])))
    assert rows_of(alignment.digests(docs, A, B)) == want
    assert rows_of(alignment.digests(docs, A, B, most=50)) == want  # most pairs by the shuffle
    assert rows_of(alignment.digests(docs, A, B, most=0)) == want


def test_awkward_rows(spark, plain):
    docs = awkward(spark).union(awkward(spark).filter("doc_id = 8")).withColumn("pairs", F.lit("p")).withColumn("rid", F.lit(1))
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *w) for (i, _), w in zip(texts, wanted(plain, [t for _, t in texts])))
    assert rows_of(alignment.digests(docs, A, B)) == want
    assert want[(3, 0, 0, 0, 0, 0, 0, "")] == 1
    whole = alignment.aligned(docs, A, B)
    assert whole.select("row.*").columns == docs.columns and whole.count() == docs.count()


def test_a_long_run_without_spaces(spark, plain):
    texts = ["1" * 4000 + "a", "中" * 3000, "ab" * 5000, " " * 999, "\U0001f9ff" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(alignment.digests(docs, A, B)) == Counter((i, *w) for i, w in enumerate(wanted(plain, texts)))


def test_empty_table(spark):
    found = alignment.digests(empty(spark), A, B)
    assert found.count() == 0
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_the_level_of_common_pairs(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 1, 2, 3, 4, 8, 9])], "pair int, n long")
    assert [alignment.common_from(counts, most) for most in (0, 1, 2, 3, 5, 8, 100)] == [16, 16, 8, 4, 2, 1, 1]


def test_runs_of_texts_are_bounded_by_rows_and_bytes_and_lose_none():
    texts = ["ä" * 30, None, "", "x" * 500, "y" * 10, None, *["z" * 40] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    runs = [r.column("text").to_pylist() for r in alignment.together([batch.slice(0, 0), batch], rows=4, size=100)]
    assert [t for run in runs for t in run] == texts
    assert all(len(run) <= 4 and (len(run) == 1 or sum(len((t or "").encode()) for t in run) <= 100) for run in runs)
    assert runs[:2] == [["ä" * 30, None, ""], ["x" * 500]] and len(runs) < len(texts)


def test_stretches_without_times_meet_those_with_them():
    big = "ab" * 300  # one group of more links than are written out
    for texts in (["a b", big, f"a {big} b a"], [big], ["a b a b"]):
        aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
        plain = Plain()
        for text, stretches in zip(texts, aligner.texts(texts)):
            n_a, n_b, n_groups, n_links, _, pairs, times = alignment._record(stretches)
            links = Counter(a * alignment.B_IDS + b for left, right in plain.groups(text) for a in left for b in right)
            assert dict(zip(pairs.tolist(), times.tolist())) == links and n_links == links.total()
            assert n_groups == len(plain.groups(text))


def test_pieces_of_many_texts_equal_the_pattern_text_by_text():
    rng = random.Random(5)
    letters = [*map(chr, range(0x20, 0x190)), *" " * 200, *"\n\t\u00a0\u2581\u3000中日\U0001f9ff"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "é é", " é ", "é"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(3000)] + [f"{c} {d}" for c in letters[:368] for d in ("x", "×", "ſ", c)]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for part, want in ((column, texts), (column.slice(3, 900), texts[3:903]), (column.slice(0, 2), texts[:2])):
            cut = [alignment.CUT.split(t) if t else [] for t in want]
            pieces, held = alignment.pieces_of(part)
            assert pieces.to_pylist() == [p for pieces in cut for p in pieces]
            assert held.tolist() == [len(pieces) for pieces in cut]
            whole, held = alignment.pieces_of(part, cuts=False)
            assert whole.to_pylist() == [t for t in want if t] and held.tolist() == [int(bool(t)) for t in want]


def test_what_is_remembered_is_bounded_and_changes_no_row(monkeypatch):
    def fresh():
        return alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())

    rng = random.Random(7)
    words = ["the", "a", "of", "Entwicklung", "▁", "a▁b", "été", "12", "ab" * 40, *map(str, range(30))]
    runs = [[" ".join(rng.choices(words, k=rng.randrange(9))) for _ in range(20)] for _ in range(12)] + [["", ""], ["▁"], [""]]
    whole = fresh()
    want = [whole.texts(run) for run in runs]
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    monkeypatch.setattr(alignment, "SHORT", 5)
    small = fresh()
    for run, rows in zip(runs, want):
        assert small.texts(run) == rows
        assert len(small.known) == len(small.met) <= 10
        assert all(len(p.encode()) <= 5 for p in small.known["text"].to_pylist())
    assert len(whole.known) > 30 and not all(whole.known["ok"].to_pylist())
