"""Substring dedup: repeated paragraphs by MinHash banding, exact check and components.

Paragraphs are the lines of a text with at least ``min_words`` words; they are near
duplicates at a Jaccard similarity of 0.8 or more of their five-word shingles. Their
sentences are paragraphs of their own, equal or not, so that a passage set into the
middle of other lines is found as well. Neighbouring repeats make a run, which counts
from ``min_run`` words on.

Equal paragraphs are one class. The 24 minimum hashes of a class make 8 bands of 3: two
classes at 0.8 collide with probability 1 - (1 - 0.8^3)^8 = 0.997, at 0.3 with 0.20.
Classes that collide are compared by their exact shingle sets. A bucket of up to
``sparse`` classes does so inside a join, which writes only verified links. A larger one
is cut into blocks, and each pair of blocks is clustered by itself: a class is compared
only with clusters it does not belong to yet, and the links written are those that hold
the clusters together. So no bucket writes its pairs, and none is skipped. Links join to
components; in a component the first paragraph, by document and place, stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import ROW, packed, stored, text_slices
from tidelake.llm.components import components
from tidelake.llm.exact_dedup import BLOCK_BITS, block_of, key_bitmaps, repeat_bitmaps, test_bit
from tidelake.llm.simhash import shingle_hashes

WIDTH = 5
BANDS, BAND_ROWS = 8, 3
SIMILARITY = 0.8
LINE, SENTENCE, DOCUMENT = 0, 1, 2
FILTER_BITS = 1 << 27

_SENTENCE = re.compile(r"[^.!?]+[.!?]*")
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def minhashes(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """A row per non-empty array of shingle hashes: the smallest value of each hash function.

    Arrays are worked on together, up to block shingles at once; a longer one in pieces.
    """
    out = np.full((len(sets), len(_FACTORS)), np.iinfo(np.uint64).max, np.uint64)
    pieces = [(i, s[at : at + block]) for i, s in enumerate(sets) for at in range(0, len(s), block)]
    first = 0
    while first < len(pieces):
        last, total = first, 0
        while last < len(pieces) and (last == first or total + len(pieces[last][1]) <= block):
            total += len(pieces[last][1])
            last += 1
        rows = [i for i, _ in pieces[first:last]]
        lengths = np.array([len(s) for _, s in pieces[first:last]])
        h = np.concatenate([s for _, s in pieces[first:last]])[:, None] * _FACTORS
        h += _SHIFTS
        h ^= h >> np.uint64(31)
        np.minimum.at(out, rows, np.minimum.reduceat(h, np.cumsum(lengths) - lengths, axis=0))
        first = last
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row per set with one number per band; the number of the band is part of it."""
    rows = minhashes(sets).reshape(-1, BANDS, BAND_ROWS)
    mixed = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(BAND_ROWS):
        mixed = (mixed ^ rows[:, :, r]) * _FACTORS[r]
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _key(text: str, kind: int) -> int:
    """Equal paragraphs share it; that of a line is what Spark's xxhash64 gives."""
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42 + kind))


def paragraphs(text: str, min_words: int) -> Iterator[tuple[int, int, int, int, int, int, str]]:
    """(kind, line number, start, end, words, key, text) of lines and of the sentences of lines with several."""
    at = 0
    for number, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if len(words) >= min_words:
            yield LINE, number, at, at + len(line), len(words), _key(line, LINE), line
            parts = list(_SENTENCE.finditer(line))
            for m in parts if len(parts) > 1 else ():
                inner = m[0].lower().split()
                if len(inner) >= min_words:
                    start = at + m.start() + len(m[0]) - len(m[0].lstrip())
                    yield SENTENCE, number, start, at + m.end(), len(inner), _key(" ".join(inner), SENTENCE), m[0]
        at += len(line) + 1


def _units(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    schema = pa.schema(
        [("rid", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("line", pa.int32()), ("start", pa.int32()),
         ("end", pa.int32()), ("words", pa.int32()), ("key", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches, 64):
            columns: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                rid += 1
                rows = [(DOCUMENT, -1, 0, len(text), 0, _signed(xxhash.xxh64_intdigest(text.encode(), 42)), None)]
                rows += paragraphs(text, min_words)
                marks = iter(bands([shingle_hashes(r[-1], WIDTH) for r in rows if r[0] == LINE]))
                for kind, line, start, end, words, key, _ in rows:
                    mark = next(marks) if kind == LINE else None
                    for column, value in zip(columns, (rid, doc_id, kind, line, start, end, words, key, mark)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run, "rid long, doc_id long, kind int, line int, start int, end int, words int, key long, bands array<long>"
    )


def _shingle_sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted lines; a filter of fixed size keeps the others out of the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [np.unique(shingle_hashes(t, WIDTH)).view(np.int64) for t in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"]
            )

    lines = docs.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("line"))
    lines = lines.withColumn("key", F.xxhash64("line"))
    slot = F.pmod("key", F.lit(FILTER_BITS))
    maps = key_bitmaps(wanted.select(slot.alias("slot")))
    near = lines.withColumn("slot", slot)
    near = near.join(F.broadcast(maps), block_of(F.col("slot")) == F.col("block"))
    near = near.filter(test_bit(F.col("bitmap"), F.pmod("slot", F.lit(BLOCK_BITS))))
    once = near.groupBy("key").agg(F.first("line").alias("line")).join(wanted, "key", "left_semi")
    return once.mapInArrow(run, "key long, shingles array<long>")


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def spanning_links(keys: list[int], sets: list[set]) -> list[tuple[int, int]]:
    """Links that join exactly what all similar pairs would join; pairs inside one cluster are not compared."""
    clusters: list[list[int]] = []
    links = []
    for i in range(len(keys)):
        joined = [i]
        apart = []
        for cluster in clusters:
            at = next((j for j in cluster if similar(sets[i], sets[j])), None)
            if at is None:
                apart.append(cluster)
            else:
                links.append((keys[i], keys[at]))
                joined += cluster
        clusters = [*apart, joined]
    return links


def _links(met: DataFrame, sets: DataFrame, sparse: int, block: int) -> DataFrame:
    members = stored(met.join(sets, "key"), "repeats-members")
    few = members.filter(F.col("members") <= sparse)
    both = F.size(F.array_intersect("x.shingles", "y.shingles"))
    sizes = F.size("x.shingles") + F.size("y.shingles")
    within = (
        few.alias("x")
        .join(
            few.alias("y"),
            (F.col("x.band") == F.col("y.band"))
            & (F.col("x.key") < F.col("y.key"))
            & (F.least(F.size("x.shingles"), F.size("y.shingles")) >= SIMILARITY * F.greatest(F.size("x.shingles"), F.size("y.shingles")))
            & (both >= SIMILARITY * (sizes - both)),
        )
        .select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    )

    def cluster(key, group):
        rows = sorted(zip(group["key"].to_pylist(), group["shingles"].to_pylist()))
        links = spanning_links([k for k, _ in rows], [set(s) for _, s in rows])
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    many = members.filter(F.col("members") > sparse)
    parts = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    crowded = (
        many.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "shingles")
        .groupBy("band", "i", "j")
        .applyInArrow(cluster, "a long, b long")
    )
    return within.union(crowded)


def repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 8,
    min_run: int = 20,
    bridge: int = 80,
    sparse: int = 16,
    block: int = 128,
) -> DataFrame:
    """One row per repeated paragraph: doc_id, text_key, kind, start, end, words, component, copies, removed.

    Spans are code points of the whole text; kind is line, or sentence for one in a line
    that does not repeat as a whole. Repeated paragraphs at most ``bridge`` characters
    apart make a run, and a run of fewer than ``min_run`` words is left alone. Of a
    component the first paragraph by doc_id (nulls last) and place stays, all others are
    removed. Repeats inside one document count. Null and empty texts have no paragraph.
    Repeated rows are documents that repeat each other. An empty table gives an empty result.
    """
    units = stored(_units(docs, id_col, text_col, min_words), "repeats-units")
    lines = units.filter(F.col("kind") == LINE)
    classes = lines.groupBy("key").agg(F.first("bands").alias("bands"))
    banded = classes.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(banded.join(shared, "band"), "repeats-met")
    sets = _shingle_sets(docs, text_col, stored(met.select("key").distinct(), "repeats-wanted"))
    roots = stored(components(_links(met, sets, sparse, block)), "repeats-roots")

    paragraphs_ = units.filter(F.col("kind") != DOCUMENT).drop("bands")
    maps = repeat_bitmaps(paragraphs_.select(F.pmod("key", F.lit(FILTER_BITS)).alias("slot")))
    slot = F.pmod("key", F.lit(FILTER_BITS))
    marked = paragraphs_.withColumn("slot", slot).join(
        F.broadcast(maps), block_of(F.col("slot")) == F.col("block"), "left"
    )
    marked = marked.withColumn(
        "hit", F.coalesce(test_bit(F.col("bitmap"), F.pmod("slot", F.lit(BLOCK_BITS))), F.lit(False))
    ).drop("slot", "block", "bitmap")
    linked = marked.filter((F.col("kind") == LINE)).join(roots.withColumnRenamed("node", "key"), "key", "left")
    lines_in = linked.filter("hit OR root IS NOT NULL").withColumn("component", F.coalesce("root", "key")).drop("root")
    sentences_in = marked.filter((F.col("kind") == SENTENCE) & F.col("hit")).withColumn("component", F.col("key"))
    inside = stored(lines_in.unionByName(sentences_in).drop("hit", "key"), "repeats-inside")

    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "start")
    groups = (
        inside.groupBy("kind", "component")
        .agg(F.count("*").alias("copies"), F.min(place).alias("first"))
        .filter("copies > 1")
        .select("kind", "component", "copies", F.col("first.rid").alias("f_rid"), F.col("first.start").alias("f_start"))
    )
    found = (
        inside.join(stored(groups, "repeats-groups"), ["kind", "component"])
        .withColumn("removed", ~((F.col("rid") == F.col("f_rid")) & (F.col("start") == F.col("f_start"))))
        .drop("f_rid", "f_start")
    )
    keys = units.filter(F.col("kind") == DOCUMENT).select("rid", F.col("key").alias("text_key"))
    return _long_enough(found, min_run, bridge).join(keys, "rid").select(
        "doc_id", "text_key", F.when(F.col("kind") == LINE, "line").otherwise("sentence").alias("kind"),
        "start", "end", "words", "component", "copies", "removed",
    )


def _long_enough(found: DataFrame, min_run: int, bridge: int) -> DataFrame:
    """Repeated lines, and repeated sentences of other lines, in runs of at least min_run words.

    Every window stays within one document.
    """
    in_line = Window.partitionBy("rid", "line")
    covered = found.withColumn("covered", F.max((F.col("kind") == LINE).cast("int")).over(in_line))
    rest = covered.filter((F.col("kind") == LINE) | (F.col("covered") == 0))
    by_place = Window.partitionBy("rid").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("end").over(by_place) > bridge, F.lit(True))
    runs = rest.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_place))
    whole = F.sum("words").over(Window.partitionBy("rid", "run"))
    return runs.withColumn("in_run", whole).filter(F.col("in_run") >= min_run)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``row`` (all input columns), removed spans and the cleaned text; null stays null.

    Rows that repeat both id and text share their spans, and lose what any of them loses.
    """
    cuts = (
        repeated(docs, id_col, text_col, **options)
        .filter("removed")
        .groupBy(F.col("doc_id").alias("cut_id"), "text_key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    )
    rows = packed(
        docs, id=F.col(id_col).cast("long"), text=F.col(text_col),
        own_key=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    )
    same = F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("own_key") == F.col("text_key"))
    joined = rows.join(cuts, same, "left").select(ROW, "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            clean = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                out, at = [], 0
                for span in spans or []:
                    if span["end"] > at:
                        out.append(text[at : max(at, span["start"])])
                        at = span["end"]
                clean.append(None if text is None else "".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("spans"), pa.array(clean, pa.string())], names=[ROW, "spans", "cleaned"]
            )

    schema = T.StructType([joined.schema[ROW], joined.schema["spans"], T.StructField("cleaned", T.StringType())])
    return joined.mapInArrow(run, schema)
