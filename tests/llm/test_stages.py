"""Exact dedup, SimHash, mixing, language ID and SentencePiece against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SF, awkward, empty
from tidelake.llm import components, exact_dedup, langid, mixing, near_copies, pieces, simhash
from tidelake.llm.queries import ORACLES, QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# exact dedup

def test_exact_dedup_rules(spark):
    rows = exact_dedup.exact_dedup(awkward(spark)).drop("row").collect()
    assert len(rows) == 15
    same = [r for r in rows if r.group_size == 4 and r.keep_id == 2]
    assert sorted((r.doc_id or 0, r.kept) for r in same) == [(0, False), (1, False), (2, True), (2, True)]
    blank = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert sorted((r.doc_id or 0, r.keep_id, r.kept) for r in blank) == [(0, 4, False), (3, 4, False), (4, 4, True)]
    lone = [r for r in rows if r.doc_id is None and r.group_size == 1]
    assert [(r.keep_id, r.kept) for r in lone] == [(None, True)]


def test_exact_dedup_rows_leave_one_per_text_and_all_columns(spark):
    docs = awkward(spark)
    left = exact_dedup.dedup_rows(docs)
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 16, 1 << 26])
def test_filter_size_never_changes_the_result(spark, bits):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 3000).cast("string").alias("text"))
    rows = exact_dedup.exact_dedup(docs, bits=bits).drop("row").collect()
    assert Counter(r.group_size for r in rows) == {1: 2000, 2: 2000}
    assert all(r.keep_id == (r.doc_id if r.doc_id >= 1000 and r.group_size == 1 else max(r.doc_id, r.doc_id % 3000 + 3000)) for r in rows)


def test_unique_rows_pass_without_exchange(spark):
    rows = docs_of(spark).select("doc_id", F.col("text"))
    marked = exact_dedup.mark_suspects(rows, "text", 1 << 26, 2)
    repeated = {t for t, n in Counter(r.text for r in rows.collect()).items() if n > 1}
    found = marked.collect()
    assert all(r.suspect for r in found if r.text in repeated)
    assert sum(r.suspect for r in found if r.text not in repeated) <= 2


# components

def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, n) for n in range(200, 260)]
    links += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(220)] + [(7, 7), (9, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = {n: find(n) for link in links for n in link if link[0] != link[1]}
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert dict(map(tuple, found.collect())) == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash

def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_groups(marks):
    """fingerprint -> smallest reachable id, all pairs compared."""
    fps = sorted({f for _, f in marks})
    ids = defaultdict(list)
    for i, f in marks:
        ids[f].append(i)
    group = {f: f for f in fps}
    values = np.array(fps, np.uint64)
    todo = list(fps)
    seen = {}
    for start in todo:
        if start in seen:
            continue
        front, members = [start], {start}
        while front:
            near = values[np.bitwise_count(values ^ np.uint64(front.pop())) <= 2].tolist()
            fresh = [n for n in near if n not in members]
            members.update(fresh)
            front += fresh
        least = min((i for m in members for i in ids[m] if i is not None), default=None)
        seen.update(dict.fromkeys(members, least))
    return seen


@pytest.mark.parametrize("dense", [1, 64])
def test_simhash_against_all_pairs(spark, dense):
    found = simhash.near_dedup(docs_of(spark), dense=dense).collect()
    marks = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in docs_of(spark).collect()]
    groups = plain_groups(marks)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {
        (i, f"{f:016x}", groups[f]) for i, f in marks
    }


@pytest.mark.parametrize("dense", [1, 8, 64])
def test_crowded_fingerprints(spark, dense):
    """Chains and clouds around one value, with links between different fingerprints only."""
    rng = random.Random(dense)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 2, 3, 4)))) for _ in range(400)}
    values |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, (1 << 64) - 1, (1 << 63)}
    fps = spark.createDataFrame([(simhash._long(v),) for v in values], "fp long")
    roots = dict(map(tuple, components.components(simhash.fingerprint_links(fps, dense)).collect()))
    plain = plain_groups([(v, v) for v in values])
    ours, theirs = defaultdict(set), defaultdict(set)
    for v in values:
        ours[roots.get(simhash._long(v), simhash._long(v))].add(v)
        theirs[plain[v]].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_edges(spark):
    found = simhash.near_dedup(awkward(spark)).collect()
    assert len(found) == 15
    zero = [r for r in found if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id or 0) for r in zero) == [0, 3, 4, 5] and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    assert [r.component_id for r in found if r.doc_id is None].count(None) == 1
    assert simhash.near_dedup(empty(spark)).count() == 0
    docs = awkward(spark)
    left = simhash.one_per_group(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 3, 6, 8, 9, 10, 11]


# mixing

def test_mix_meets_targets(spark):
    rows = mixing.mixed(docs_of(spark)).drop("row").collect()
    taken, sizes, aims, longest = Counter(), Counter(), {}, Counter()
    for r, d in zip(rows, docs_of(spark).collect()):
        assert r.size == len([w for w in (d.text or "").encode().split()]) or r.doc_id != d.doc_id
        assert 0 <= r.taken <= 3 * r.size
    source = {d.doc_id: d.source for d in docs_of(spark).collect()}
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        sizes[s] += r.size
        aims[s] = r.target
        longest[s] = max(longest[s], r.size)
        assert r.source_size >= r.size
    assert abs(sum(aims.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(abs(taken[s] - aims[s]) <= longest[s] / 2 + 1 for s in aims)
    again = mixing.mixed(docs_of(spark).repartition(5)).drop("row").collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_mix_targets_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 100)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert found["a"] == 30
    assert sum(found.values()) == pytest.approx(1200)
    # the null source is fourth: weights 5, 2, 1, 5
    assert (found[None], found["c"], found["b"]) == (300, 270, 600)


def test_a_source_without_words_takes_its_turn_in_the_weights(spark):
    words = " ".join(["w"] * 10)
    rows = [(i, words, s) for i, s in enumerate(["a"] * 10 + ["c"] * 90 + [None] * 200)]
    rows += [(900, None, "b"), (901, " ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.row.source: (r.source_size, r.target) for r in mixing.mixed(docs).collect()}
    # weights: a 5, b 2, c 1, null 5; a stops at 300, b at 0, the others share 2,700 as 1 to 5
    assert found["a"] == (100, 300.0) and found["b"] == (0, 0.0)
    assert found["c"] == (900, pytest.approx(450)) and found[None] == (2000, pytest.approx(2250))
    blank = docs.filter("source = 'b'")
    assert [(r.size, r.target, r.taken) for r in mixing.mixed(blank).collect()] == [(0, 0.0, 0)] * 2


def test_the_mix_agrees_with_its_sql_where_a_source_has_no_words(spark):
    rng = random.Random(19)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["a", "c", "c", None])) for i in range(200)]
    rows += [(900, None, "b"), (901, " ", "b"), (902, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.execute(ORACLES["op2_mix_sources"]).fetchall())
    got = sorted(tuple(r) for r in mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [(r[:3], r[4]) for r in got] == [(r[:3], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_weights_make_unequal_inclusion(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 10)).alias("text"),
        F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"),
        F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"),
    )
    rows = mixing.mixed(docs, weight=F.col("quality")).select("doc_id", "copies", "target", "size").collect()
    even = sum(r.copies for r in rows if r.doc_id >= 1000 and r.doc_id % 2 == 0)
    odd = sum(r.copies for r in rows if r.doc_id >= 1000 and r.doc_id % 2)
    assert 3.2 < even / odd < 4.8
    b = [r for r in rows if r.doc_id >= 1000]
    assert abs(10 * (even + odd) - b[0].target) <= 10


def test_mix_edges(spark):
    rows = mixing.mixed(awkward(spark)).drop("row").collect()
    assert len(rows) == 15 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mixed(empty(spark)).count() == 0
    left = mixing.mixed_rows(awkward(spark))
    assert left.columns == awkward(spark).columns
    assert left.count() == sum(r.copies for r in rows)


# language ID

def test_numerals_and_signs_are_no_letters(spark):
    assert not any(map(langid.has_letter, ["²", "½", "Ⅳ", "①", "१२", "_", "\u0301", "😀", ""]))
    assert all(map(langid.has_letter, ["a", "1é", "ʰ", "中", "ª"]))
    docs = docs_of(spark).select("doc_id", "text", "lang", "source")
    signs = spark.createDataFrame([(10**6 + i, t, None, None) for i, t in enumerate(["² ½", "Ⅳ ① 3"])], docs.schema)
    found = langid.language_id(docs.union(signs)).filter("doc_id >= 1000000").collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 2


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_id(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_language_edges(spark):
    docs = awkward(spark)
    rows = langid.language_id(docs).collect()
    assert len(rows) == 15
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (3, 4, 5, 9))
    assert by[6][0].lang_pred in ("de", "en", "fr")
    assert langid.language_id(empty(spark)).count() == 0
    left = langid.accepted_rows(docs)
    assert left.columns == docs.columns
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}
    assert sorted(r.doc_id or 0 for r in langid.accepted_rows(unlabelled).collect()) == [0, 0, 1, 2, 2, 6, 7, 8, 10, 11]


# SentencePiece

def test_pieces_match_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = docs_of(spark).unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    for r in pieces.encode_decode(docs, MODEL, arrays=True).collect():
        text = r.row.text or ""
        assert r.ids == sp.encode(text, add_bos=True, add_eos=True)
        assert r.decoded == sp.decode(r.ids)
        data = text.encode()
        surface = b"".join(data[s:e] for i, (s, e) in enumerate(zip(r.starts, r.ends)) if r.starts[i] >= (r.ends[i - 1] if i else 0))
        assert surface == data
        assert all(0 <= s <= e <= len(data) for s, e in zip(r.starts, r.ends))


def test_spans_agree_with_the_librarys_offsets():
    codec = pieces.Codec(open(MODEL, "rb").read())
    for text in ("Hello  world", " lead", "café au lait", "tab\there", "a"):
        ids = codec.encode([text])[0]
        starts, ends = codec.spans(text, ids)
        offsets = codec.sp.encode(text, out_type="proto").pieces
        inner = list(zip(starts.tolist(), ends.tolist()))[1:-1]
        for (s, e), piece in zip(inner, offsets):
            assert text.encode()[s:e].decode() == piece.surface


def trie(rules):
    """A compiled character map of one- and two-byte rules, built by trying offsets."""
    units, texts = [0] * 4096, b""
    used = {0}

    def place(children, free):
        while any(free ^ c in used for c in children):
            free += 1
        used.update(free ^ c for c in children)
        return free

    def tree(prefix):
        return sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})

    def build(prefix, node):
        nonlocal texts
        leaf = prefix in rules
        offset = place(([0] if leaf else []) + tree(prefix), 256 * (1 + len(used) % 8))
        units[node] |= ((node ^ offset) << 10) | (0x100 if leaf else 0)
        if leaf:
            units[offset] = 0x80000000 | len(texts)
            texts += rules[prefix] + b"\0"
        for c in tree(prefix):
            units[offset ^ c] = c
            build(prefix + bytes([c]), offset ^ c)

    build(b"", 0)
    return len(units * 4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + texts


def test_longest_prefix_map_records_alignment():
    from sentencepiece import sentencepiece_model_pb2 as pb

    rules = {b"a": b"A", b"ab": b"xyz", "é".encode(): b"e", b"q": b""}
    spec = pb.NormalizerSpec(
        precompiled_charsmap=trie(rules), add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True
    )
    normal, starts, ends = pieces.Normalizer(spec)("abaé  qz ".encode())
    assert normal.decode() == "▁xyzAe▁z"
    assert starts.tolist() == [0, 0, 0, 0, 0, 0, 2, 3, 5, 5, 5, 8]
    assert ends.tolist() == [0, 0, 0, 2, 2, 2, 3, 5, 6, 6, 6, 9]


# pipeline

@pytest.mark.parametrize("block", [2, 128])
def test_near_stage_links_edited_copies(spark, block):
    rng = random.Random(23)
    texts = []
    for length in (12, 50, 200, 400) * 6:
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        texts.append(" ".join(base))
        for edits in (1, max(1, length // 60), max(1, length // 25)):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(length)] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    wanted = {find(i) for i in range(len(texts))}
    assert len(wanted) < len(texts) - 24  # one in two edited copies is a near copy
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_copies.one_per_group(docs, block=block).collect()} == wanted
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == wanted


def test_near_stage_on_one_large_group(spark):
    rng = random.Random(29)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(120)] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts[75] = " ".join(base)  # 0.84 from each of the others, which are at 0.72 from one another
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in near_copies.one_per_group(docs, block=16).collect()] == [0]


def near_roots(texts):
    """The smallest number of each group that all pairs at a similarity of 0.8 of five-word shingles form."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if min(len(one), len(sets[j])) >= 0.8 * max(len(one), len(sets[j])):
                both = len(one & sets[j])
                if both >= 0.8 * (len(one) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_near_stage_links_copies_that_repeat_a_line(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(20):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(20)]
        texts += ["\n".join(lines), "\n".join([*lines[:10], *[lines[9]] * 60, *lines[10:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.one_per_group(docs).collect()}
    assert kept == set(range(0, 40, 2)) == near_roots(texts)


def test_near_stage_finds_what_all_pairs_find_on_a_table(spark):
    docs = docs_of(spark)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = {r.doc_id for r in near_copies.one_per_group(docs).collect()}
    assert kept == {rows[i][0] for i in near_roots([t for _, t in rows])}


def test_pipeline_on_the_smallest_tables(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "sentencepiece"]
    docs = docs_of(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
    final = corpus_pipeline.run(spark, SF)
    assert final.count() > 0 and set(docs.columns) <= set(final.columns)


def test_pipeline_takes_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_every_operator_has_a_query():
    assert sorted(QUERIES, key=lambda n: int(n.split("_")[0][2:])) == list(QUERIES)
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_near_stage_asks_the_pivot_tables(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 9, 23, 24, 25, 26]))) for v in values]
    fps = spark.createDataFrame([(simhash._long(v), 50) for v in values], "fp long, size int")
    fps = fps.select("fp", "size", *simhash.distance_table(F.col("fp")))
    for radius in (2, 24):
        pairs = fps.alias("x").crossJoin(fps.alias("y")).filter(near_copies._screen("x", "y", radius, 0.8))
        kept = {(a % 2**64, b % 2**64) for a, b in pairs.select("x.fp", "y.fp").collect()}
        assert kept == {(a, b) for a in values for b in values if (a ^ b).bit_count() <= radius}
    # a distance to a pivot that differs by more than the radius settles it, except for few shingles
    far = fps.limit(1).withColumn("t0", F.lit(0).cast("long")).withColumn("size", F.explode(F.array(F.lit(50), F.lit(8))))
    away = fps.limit(1).withColumn("t0", F.lit(25).cast("long")).withColumn("size", F.lit(50))
    few = away.withColumn("size", F.lit(8))
    met = far.alias("x").crossJoin(away.union(few).alias("y")).filter(near_copies._screen("x", "y", 24, 0.8))
    assert [tuple(r) for r in met.select("x.size", "y.size").collect()] == [(8, 8)]
