"""Alignment of two tokenizers' tokens over the bytes of each text, with corpus-wide counts of linked ids.

A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model. A's
character offsets and the spans of B's encoding are the coarse cuts: where a token's span
is not empty and the next one starts at its end, that character ends the token's bytes.
Spans say nothing inside a character that several tokens share, nor about a byte piece;
there the decoded bytes refine the cut. Byte offsets where both sides end a token cut the
text into groups, and every A token of a group is linked with every B token of it.

A text is read in stretches that end where both tokenizers must end a token: before a
single space between two characters that neither takes for white space. A task aligns each
different short stretch once and many at a time, remembers them as Arrow rows, and puts the
stretches of a run of texts together by whole columns. A model with a piece that crosses
such a place gets whole texts.

The installed sentencepiece has no immutable proto any more; its offset mapping holds the
same spans.
"""

from __future__ import annotations

import hashlib
import gc
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tidelake.llm.common import ROW, packed, stored

#: A single space between two such characters; the space comes first, so that it is searched for as it stands.
CUT = re.compile(" (?=[!-~À-ÖØ-öø-ſ])(?<=[!-~À-ÖØ-öø-ſ] )")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
SPACE = "▁"
#: Ids of B stay below this and those of A below twice this, so a pair fits into 31 bits.
B_IDS = 32_768
#: Stretches up to so many bytes are remembered; beyond so many stretches the more frequent half stays.
SHORT, REMEMBERED = 48, 300_000
#: Texts are read together up to so many rows and bytes, longer ones on their own.
ROWS, TEXT_BYTES = 10_000, 2_000_000
#: So many stretches are aligned at a time, as larger arrays leave the processor's caches.
AT_ONCE = 8_000
#: Groups up to so many links are written out as they stand, larger ones by different ids.
SMALL_GROUP = 64
#: Counts of so many most frequent pairs at most go to all executors; other pairs meet theirs by a shuffle.
COMMON_PAIRS = 200_000
_SEPARATORS = (",", "|", ";", "")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: Aligned stretches: whether both sides give the bytes, counts, the groups as text, linked id pairs and how often each.
STRETCHES = pa.schema([
    ("text", pa.large_string()), ("ok", pa.bool_()), *((n, pa.int64()) for n in COUNTS),
    ("groups", pa.large_string()), ("pairs", pa.large_list(pa.int32())), ("times", pa.large_list(pa.int64())),
])


def _beside_cuts() -> tuple[np.ndarray, np.ndarray]:
    """Which two bytes after a space, and which two before it, let ``CUT`` cut there."""
    after, before = np.zeros((2, 256, 256), bool)
    for octets in (c.encode() for c in map(chr, range(0x800)) if CUT.search(f"! {c}")):
        if len(octets) == 1:
            after[octets[0], :] = before[:, octets[0]] = True
        else:
            after[octets[0], octets[1]] = before[octets[0], octets[1]] = True
    return after, before


_AFTER, _BEFORE = _beside_cuts()


def pieces_of(texts: pa.Array, cuts: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The pieces ``CUT`` leaves of all texts, and how many each text has; empty and null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    octets = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    begins, ends = bounds[:-1], bounds[1:]
    filled = ends > begins
    at = np.flatnonzero(octets == 0x20) if cuts else np.zeros(0, np.int64)
    edge = np.zeros(len(octets), bool)
    edge[begins[filled]] = edge[ends[filled] - 1] = True
    at = at[~edge[at]]  # both neighbours are of the same text
    far = np.minimum(at + 2, len(octets) - 1)  # decides only where a character has two bytes, which are then there
    at = at[_AFTER[octets[at + 1], octets[far]] & _BEFORE[octets[at - 2], octets[at - 1]]]
    kept = np.ones(len(octets), bool)
    kept[at] = False
    sizes = np.sort(np.append(ends[filled], at)) - np.sort(np.append(begins[filled], at + 1))
    pieces = _strings(np.append(0, np.cumsum(sizes)), octets[kept])
    return pieces, np.diff(np.searchsorted(at, bounds)) + filled


def _strings(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))


def _taken(values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen strings as one run of bytes, and where each begins and the last ends."""
    found = values.take(pa.array(at))
    _, offsets, data = found.buffers()
    bounds = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1]
    return bounds - bounds[0], np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def byte_ends(spans: np.ndarray, last: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes.

    ``spans`` are starts and ends in characters, ``last`` marks the last token of a stretch,
    ``places`` is the byte offset of every character. A span settles its token's end if it is
    not empty and the next one starts there; the decoded bytes' lengths settle the others.
    """
    start, end = spans[:, 0], spans[:, 1]
    settled = (end > start) & (last | (np.append(start[1:], -1) == end))
    decoded = np.cumsum(lengths)
    ends = np.where(settled, places[end], decoded)
    return ends if (ends == decoded).all() else decoded


def _pairs(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


class Aligner:
    def __init__(self, byte_level: str, proto: bytes):
        self.a = tokenizers.Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        model = model_pb2.ModelProto.FromString(proto)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in json.loads(byte_level)["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet.get(c, 0) for c in token)
        self.b_bytes = [self._piece(i, p.piece) for i, p in enumerate(model.pieces)]
        if len(self.b_bytes) > B_IDS or len(self.a_bytes) > 2 * B_IDS:
            raise ValueError(f"more than {2 * B_IDS} ids of A or {B_IDS} of B")
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        self.a_spelt, self.b_spelt = (pa.array(side, pa.large_binary()) for side in (self.a_bytes, self.b_bytes))
        ids = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = pa.array([f"{i}{mark}" for mark in _SEPARATORS for i in range(ids)], pa.large_string())
        self.ids = ids
        spec = model.normalizer_spec
        self.cuts = (
            spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
            and not spec.precompiled_charsmap and not any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        )
        self.known = STRETCHES.empty_table()
        self.met = np.zeros(0, np.int64)  # how often each known stretch was met

    def _piece(self, number: int, piece: str) -> bytes:
        octet = BYTE_PIECE.fullmatch(piece) if self.b.is_byte(number) else None
        return bytes([int(octet[1], 16)]) if octet else piece.replace(SPACE, " ").encode()

    def align(self, stretches: list[str]) -> list[pa.RecordBatch]:
        """Each stretch, read after a space; not ok where a side does not give its bytes."""
        found = self._together(stretches)
        if found is not None:
            return [found]
        if len(stretches) == 1:
            nothing = dict(text=stretches[0], ok=False, **dict.fromkeys(COUNTS, 0), groups="", pairs=[], times=[])
            return [pa.RecordBatch.from_pylist([nothing], STRETCHES)]
        half = len(stretches) // 2
        return self.align(stretches[:half]) + self.align(stretches[half:])

    def _together(self, stretches: list[str]) -> pa.RecordBatch | None:
        """All stretches as one text in which each begins with its space; None if any bytes differ."""
        spaced = [" " + s for s in stretches]
        data = "".join(spaced).encode()
        octets = np.frombuffer(data, np.uint8)
        places = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(data))
        sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
        close = np.cumsum(sizes)  # in characters
        begin = close - sizes

        coded = self.a.encode(spaced, is_pretokenized=True, add_special_tokens=False)
        a_of = np.array(coded.word_ids, np.int64)
        a, a_spans = np.array(coded.ids, np.int64), _pairs(coded.offsets) + begin[a_of, None]
        parts = self.b.encode(
            stretches, return_type="offset_mapping", return_bytes=False, num_threads=1,
            add_bos=False, add_eos=False, enable_sampling=False,
        )
        ids_of = [p["ids"] for p in parts]
        b_of = np.repeat(np.arange(len(parts)), np.fromiter(map(len, ids_of), np.int64, len(parts)))
        b = np.fromiter(chain.from_iterable(ids_of), np.int64, len(b_of))
        b_spans = _pairs(list(chain.from_iterable([p["offsets"] for p in parts]))) + (begin + 1)[b_of, None]
        if not all(np.array_equal(_taken(spelt, ids)[1], octets) for spelt, ids in ((self.a_spelt, a), (self.b_spelt, b))):
            return None
        a_last, b_last = (np.append(of[1:] != of[:-1], True) for of in (a_of, b_of))
        a_ends = byte_ends(a_spans, a_last, places, self.a_lengths[a])
        b_ends = byte_ends(b_spans, b_last, places, self.b_lengths[b])
        if not (np.array_equal(a_ends[a_last], places[close]) and np.array_equal(b_ends[b_last], places[close])):
            return None
        columns = self._cut(a, a_ends, b, b_ends, places[close])
        return pa.RecordBatch.from_arrays([pa.array(stretches, pa.large_string()), *columns], schema=STRETCHES)

    def _cut(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, close: np.ndarray) -> list[pa.Array]:
        """The columns of ``STRETCHES`` after the text."""
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        m, n = np.bincount(a_group), np.bincount(b_group)
        a_from, b_from = np.cumsum(m) - m, np.cumsum(n) - n
        owner = np.searchsorted(close, common)  # the stretch of each group
        final = np.append(owner[1:] != owner[:-1], True)  # groups that end a stretch

        # every token in the order of the text form, with the mark that follows it
        mark = np.zeros(len(a) + len(b), np.int64)
        order = np.empty(len(mark), np.int64)
        a_at, b_at = np.arange(len(a)) + b_from[a_group], np.arange(len(b)) + (a_from + m)[b_group]
        order[a_at], order[b_at] = a, b
        mark[a_from + m + b_from - 1] = 1
        mark[a_from + m + b_from + n - 1] = np.where(final, 3, 2)
        bounds, text = _taken(self.shown, order + mark * self.ids)
        groups = _strings(bounds[np.append(0, (a_from + m + b_from + n)[final])], text)

        small = np.flatnonzero(m * n <= SMALL_GROUP)
        links = (m * n)[small]
        of = np.repeat(small, links)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(links) - links, links)
        pairs = a[a_from[of] + inside // n[of]] * B_IDS + b[b_from[of] + inside % n[of]]
        owners = owner[of]
        times = np.ones(len(pairs), np.int64)
        for g in np.flatnonzero(m * n > SMALL_GROUP).tolist():
            (left, l_times), (right, r_times) = (
                np.unique(ids[start : start + size], return_counts=True)
                for ids, start, size in ((a, a_from[g], m[g]), (b, b_from[g], n[g]))
            )
            pairs = np.append(pairs, (left[:, None] * B_IDS + right).ravel())
            times = np.append(times, (l_times[:, None] * r_times).ravel())
            owners = np.append(owners, np.full(len(left) * len(right), owner[g]))
        if len(small) < len(m):
            by = np.argsort(owners, kind="stable")
            pairs, times, owners = pairs[by], times[by], owners[by]
        upto = np.append(0, np.searchsorted(owners, np.arange(len(close)), side="right"))
        n_a = np.diff(np.searchsorted(a_ends, close, side="right"), prepend=0)
        n_b = np.diff(np.searchsorted(b_ends, close, side="right"), prepend=0)
        n_groups = np.diff(np.flatnonzero(final), prepend=-1)
        n_links = np.diff(np.cumsum(m * n)[final], prepend=0)
        return [
            pa.array(np.ones(len(close), bool)), *map(pa.array, (n_a, n_b, n_groups, n_links)), groups,
            pa.LargeListArray.from_arrays(pa.array(upto), pa.array(pairs.astype(np.int32))),
            pa.LargeListArray.from_arrays(pa.array(upto), pa.array(times)),
        ]

    def _rows(self, different: pa.Array) -> tuple[pa.Table, np.ndarray]:
        """A table of aligned stretches, known ones first, and the row of each different one."""
        at = pc.index_in(different, value_set=self.known["text"].combine_chunks())
        missing = at.is_null().to_numpy(zero_copy_only=False)
        unknown = different.filter(pa.array(missing)).to_pylist()
        rows = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        rows[missing] = len(self.known) + np.arange(len(unknown))
        new = [b for start in range(0, len(unknown), AT_ONCE) for b in self.align(unknown[start : start + AT_ONCE])]
        return pa.concat_tables([self.known, pa.Table.from_batches(new, STRETCHES)]).combine_chunks(), rows

    def _remember(self, table: pa.Table, met: np.ndarray) -> None:
        """Keep the short stretches, and of too many the half that was met most; older meetings count less."""
        keep = np.flatnonzero(pc.less_equal(pc.binary_length(table["text"]), SHORT).to_numpy())
        if len(keep) > REMEMBERED:
            most = np.argpartition(met[keep], len(keep) - REMEMBERED // 2)[len(keep) - REMEMBERED // 2 :]
            keep = np.sort(keep[most])
            met = met // 2
        if len(keep) < len(table):
            table, met = table.take(pa.array(keep)).combine_chunks(), met[keep]
        self.known, self.met = table, met

    def aligned(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of ``FIELDS`` for texts of a few megabytes together, or one long text."""
        pieces, held = pieces_of(texts, self.cuts)
        coded = pieces.dictionary_encode()
        table, rows = self._rows(coded.dictionary)
        of = rows[coded.indices.to_numpy()]  # the table's row of every piece
        met = np.bincount(of, minlength=len(table))
        met[: len(self.met)] += self.met
        self._remember(table, met)

        text = np.repeat(np.arange(len(held)), held)
        wrong = np.zeros(len(held), bool)
        wrong[text[~table["ok"].to_numpy()[of]]] = True
        if wrong.any():
            of, text, held = of[~wrong[text]], text[~wrong[text]], np.where(wrong, 0, held)
        upto = np.append(0, np.cumsum(held))
        counts = [np.diff(np.append(0, np.cumsum(table[n].to_numpy()[of]))[upto]) for n in COUNTS]
        groups = pa.LargeListArray.from_arrays(pa.array(upto), table["groups"].combine_chunks().take(pa.array(of)))
        pairs, times, bounds = self._linked(table, of, text, len(held))
        return [
            *map(pa.array, counts), pc.binary_join(groups, pa.scalar(";", pa.large_string())).cast(pa.string()),
            *(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (pairs, times)),
        ]

    def _linked(self, table: pa.Table, of: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of each text in order, how many links each has, and where each text's begin."""
        lists = table["pairs"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()[of]
        every = (np.repeat(text, sizes) << 31) + lists.take(pa.array(of)).flatten().to_numpy()
        times = table["times"].combine_chunks()
        often = None
        if (times.flatten().to_numpy() == 1).all():
            every.sort()
        else:
            order = np.argsort(every)
            every, often = every[order], times.take(pa.array(of)).flatten().to_numpy()[order]
        heads = np.flatnonzero(np.diff(every, prepend=-1))
        links = np.diff(heads, append=len(every)) if often is None or not len(heads) else np.add.reduceat(often, heads)
        every = every[heads]
        return (every & 0x7FFFFFFF).astype(np.int32), links, np.searchsorted(every, np.arange(texts + 1) << 31)

    def texts(self, texts: list[str]) -> list[tuple]:
        """The values of ``FIELDS`` for each text."""
        return list(zip(*(column.to_pylist() for column in self.aligned(pa.array(texts, pa.large_string())))))


@lru_cache(maxsize=2)
def _aligner(byte_level: str, proto: bytes) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work, one task a core
    return Aligner(byte_level, proto)


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<long>"


def _record(values: tuple) -> tuple:
    """One text's values with the lists as arrays."""
    return *values[:5], np.array(values[5], np.int32), np.array(values[6], np.int64)


def together(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of at most so many rows and bytes of text, and at least one row.

    The more texts a run holds, the more often its stretches repeat in it; the bytes bound what
    is held of it at once.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = before = 0
        while start < batch.num_rows:
            end = min(max(int(np.searchsorted(ends, before + size, side="right")), start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])


def aligned(docs: DataFrame, byte_level: str, model: str, text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """One row per input row: ``row`` (all input or the carried columns), counts, groups, pairs and times.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the different linked id pairs of the
    text in order (``a * B_IDS + b``) and ``times`` how many links each has. A text that is
    null or empty, or whose bytes a side does not give back, has no tokens: zeros, an empty
    string and empty lists. Long texts take time and memory in proportion; a group with very
    many tokens costs one entry per pair of different ids, not one per link.
    """
    with open(byte_level, encoding="utf-8") as file:
        vocabulary = file.read()
    with open(model, "rb") as file:
        proto = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, proto))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        collecting = gc.isenabled()
        gc.disable()  # the encoders' lists hold no cycles, and walking them takes time
        try:
            for batch in together(batches):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW), *aligner.aligned(batch.column("text"))],
                    names=[ROW, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )
        finally:
            if collecting:
                gc.enable()

    rows = packed(docs, carry, text=F.col(text_col))
    return rows.mapInArrow(run, T.StructType([rows.schema[ROW], *T._parse_datatype_string(FIELDS).fields]))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows each id pair is linked, and if that is its A id's highest.

    Rows list a pair once, so a hot pair is a sum of map-side counts. An A id has at most
    one row here per id of B.
    """
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / B_IDS))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def common_from(counts: DataFrame, most: int) -> int:
    """The lowest power of two that at most ``most`` pairs reach with their count."""
    step = F.floor(F.log2("n")).cast("int")
    sizes = {r["step"]: r["pairs"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect()}
    level, kept = 63, 0
    while level > 0 and kept + sizes.get(level - 1, 0) <= most:
        level -= 1
        kept += sizes.get(level, 0)
    return 1 << level


def scored(found: DataFrame, most: int = COMMON_PAIRS) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum over their links.

    Counts of frequent pairs, at most ``most`` of them, go to the rows; the remaining pairs,
    none of which can then be in a large part of the rows unless there are fewer than
    ``most`` pairs, go to their counts. A row id made on the written rows ties the parts together.
    """
    rows = stored(found.withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(rows), "pair-counts")
    level = common_from(counts, most)
    pairs = rows.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "rid", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")
    )
    common = F.broadcast(counts.filter(F.col("n") >= level))
    rare = counts.filter(F.col("n") < level)
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"),
    ]
    met = [pairs.join(common, "pair").groupBy("rid").agg(*sums)]
    if not rare.isEmpty():
        met.append(pairs.join(common, "pair", "left_anti").join(rare, "pair").groupBy("rid").agg(*sums))
    total = met[0] if len(met) == 1 else met[0].union(met[1]).groupBy("rid").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    return rows.join(total, "rid", "left").drop("rid").fillna(0, ["n_best", "count_sum"])


def digests(docs: DataFrame, byte_level: str, model: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Repeated rows each count as a document; a null id stays null. Without tokens
    groups_sha256 is the empty string. An empty table gives an empty result.
    """
    found = aligned(docs, byte_level, model, text_col, carry=[F.col(id_col).cast("long").alias("doc_id")])
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    slim = found.withColumn("groups_sha256", hashed).drop("groups")
    return scored(slim, **options).select(
        f"{ROW}.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
