"""PII: base patterns, and terms that the corpus shows to reveal a protected entity.

Protected entities are the values the base patterns find. What a term tells of an entity is
read from how many documents hold the term (df_t), the entity (df_e) and both (co), over
whole documents. The chance of the entity given the term is not taken as co / df_t, which
is 1 for every word seen once, but as the lower end of its Wilson interval, L. With
N documents the term discloses log2(L N / df_e) of the entity's log2(N / df_e) bits and
leaves -log2(L) hidden. A term that discloses the share ``generalise_at`` of an entity and
leaves at most ``hidden_at`` bits is generalised to its kind wherever it occurs in the
corpus; one that leaves at most ``remove_at`` bits is removed.

No pair is left out of this for being rare, and none is written that cannot count: a
term's documents with any entity bound co, so common words fall out before they meet an
entity, and entities found in the same documents, like terms found in the same
documents, are judged as one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import ROW, packed, stored, text_slices
from tidelake.llm.exact_dedup import BLOCK_BITS, key_bitmaps

# fixed values of the contract: kinds in listed order, and what each accepts
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WORD = re.compile(r"\w\w+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each @ is looked at once, so a long run without one costs nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted; leftmost non-overlapping per kind."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _entity(kind: int, value: str) -> int:
    """One number for all spellings of a value: case for emails, digits alone for numbers."""
    plain = value.lower() if kind < 2 else re.sub("[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}", 7) - (1 << 63)


def _covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that sorted spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words of two letters or more that no span overlaps.

    A word looks up the one stretch that could overlap it, so a text with very many
    mentions costs no more per word than one with few.
    """
    starts, ends = _covered(spans)
    for m in _WORD.finditer(text):
        s, e = m.span()
        before = bisect_left(starts, e) - 1
        if before < 0 or ends[before] <= s:
            yield m[0].lower(), s, e


def _terms(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    if spans:
        return {term for term, _, _ in words(text, spans)}
    return {w.lower() for w in set(_WORD.findall(text))}


def term_documents(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """(term, documents, naming): rows with the term, and those of them that name an entity.

    Whole texts; tasks add up terms before anything is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        naming: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64()),
                       pa.array([naming[t] for t in counts], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["term", "n", "naming"])

        for batch in text_slices(batches):
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                terms = _terms(text, spans)
                counts.update(terms)
                if spans:
                    naming.update(terms)
                if len(counts) > flush:
                    yield out()
                    counts.clear()
                    naming.clear()
        yield out()

    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    found = texts.mapInArrow(run, "term string, n long, naming long")
    return found.groupBy("term").agg(F.sum("n").alias("documents"), F.sum("naming").alias("naming"))


def lower_bound(hits: Column, trials: Column, z: float) -> Column:
    """The lower end of the Wilson interval of a share; it grows with the hits."""
    p, z2 = hits / trials, z * z
    spread = F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))
    return (p + z2 / (2 * trials) - z * spread) / (1 + z2 / trials)


def term_filter(terms: DataFrame, bits_per_term: int, most_bits: int) -> bytes:
    """A bitmap over the terms' hashes, of a size that follows their number up to ``most_bits``."""
    wanted = max(terms.count(), 1) * bits_per_term
    bits = min(max(1 << (wanted - 1).bit_length(), BLOCK_BITS), most_bits)
    blocks = key_bitmaps(terms.select(F.pmod(F.xxhash64("term"), F.lit(bits)).alias("slot"))).collect()
    out = bytearray(bits // 8)
    for b in blocks:
        out[b["block"] * BLOCK_BITS // 8 : (b["block"] + 1) * BLOCK_BITS // 8] = b["bitmap"]
    return bytes(out)


def _in_filter(term: str, bitmap: bytes) -> bool:
    slot = xxhash.xxh64_intdigest(term.encode(), 42) & (len(bitmap) * 8 - 1)
    return bool(bitmap[slot >> 3] >> (slot & 7) & 1)


SPAN = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]
)
HIT = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
)
_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))
_ARROW_HITS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(rows: DataFrame, bitmap: bytes) -> DataFrame:
    """Base spans, entities and the places of words that the filter knows, per row."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def hits(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
        known = {t for t in _terms(text, spans) if _in_filter(t, shared.value)}
        return [{"term": t, "start": s, "end": e} for t, s, e in words(text, spans) if t in known] if known else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ROW),
                    pa.array([[dict(zip(("start", "kind", "end"), x)) for x in s] for s in spans], _ARROW_SPANS),
                    pa.array([sorted({_entity(k, t[a:b]) for a, k, b in s}) for t, s in zip(texts, spans)], pa.list_(pa.int64())),
                    pa.array([hits(t, s) for t, s in zip(texts, spans)], _ARROW_HITS),
                ],
                names=[ROW, "base", "entities", "hits"],
            )

    fields = [
        rows.schema[ROW],
        T.StructField("base", T.ArrayType(SPAN)),
        T.StructField("entities", T.ArrayType(T.LongType())),
        T.StructField("hits", T.ArrayType(HIT)),
    ]
    return rows.mapInArrow(run, T.StructType(fields))


def _classes(members: DataFrame, key: str, df: str) -> DataFrame:
    """(key, class, df): members of the same rows get the same class.

    ``members`` is distinct (rid, key). The class is a 128-bit sum over the rows' hashes,
    which map tasks add up, so a member of very many rows is one sum.
    """
    marks = [F.sum(F.xxhash64(F.lit(salt), "rid").cast("decimal(38,0)")) for salt in (1, 2)]
    return members.groupBy(key).agg(F.count("*").alias(df), marks[0].alias("m1"), marks[1].alias("m2")).select(
        key, F.xxhash64(F.lit(3), "m1", "m2", df).alias("c1"), F.xxhash64(F.lit(4), "m1", "m2", df).alias("c2"), df
    )


def disclosures(
    rows: int, entities: DataFrame, terms: DataFrame, generalise_at: float, hidden_at: float, remove_at: float, z: float
) -> DataFrame:
    """(term, removed): the terms that disclose some entity.

    ``entities`` is distinct (rid, entity), ``terms`` distinct (rid, term, documents), both over
    the same rows. Per row, different classes of entities meet different classes of terms.
    """
    n = F.lit(float(rows))
    entity_class = _classes(entities, "entity", "df_e").filter(F.col("df_e") < n)
    term_class = stored(_classes(terms.select("rid", "term"), "term", "held"), "pii-classes")
    of_entity = entities.join(entity_class, "entity").select("rid", F.struct("c1", "c2").alias("e"), "df_e").distinct()
    of_term = terms.join(term_class, "term").select("rid", F.struct("c1", "c2").alias("t"), "documents").distinct()
    joint = of_entity.join(of_term, "rid").groupBy("e", "t").agg(
        F.count("*").alias("co"), F.first("df_e").alias("df_e"), F.first("documents").alias("documents")
    )
    left = -F.log2(lower_bound(F.col("co"), F.col("documents"), z))
    telling = (
        joint.withColumn("hidden", left)
        .filter((F.col("hidden") <= hidden_at) & (1 - F.col("hidden") / F.log2(n / F.col("df_e")) >= generalise_at))
        .groupBy("t").agg((F.min("hidden") <= remove_at).alias("removed"))
    )
    named = term_class.select("term", F.struct("c1", "c2").alias("t"))
    return named.join(telling, "t").select("term", "removed")


def find(
    docs: DataFrame,
    text_col: str = "text",
    carry: list[Column] | None = None,
    generalise_at: float = 0.8,
    hidden_at: float = 2.5,
    remove_at: float = 1.0,
    z: float = 1.96,
    bits_per_term: int = 16,
    most_filter_bits: int = 1 << 27,
) -> DataFrame:
    """One row per input row: ``row`` (all input or the carried columns), base, terms.

    base are the spans of the patterns, terms those of disclosing terms (start, end,
    removed), both sorted. A null text counts as empty. Repeated rows each count as a
    document. An empty table gives an empty result; a corpus in which every document names
    an entity has nothing to learn about it. Texts of any length are read whole, in time
    in proportion.

    Two passes read the texts: one counts terms, one marks base spans and the words of
    terms that could disclose anything. Those are known to the second pass by a bitmap of at
    most ``most_filter_bits`` (16 MB); where there are more terms than it can tell apart, more
    words go to the exact join behind it. A hot entity or term is reduced in the map tasks
    and its rows are split in the joins.
    """
    terms = term_documents(docs, text_col)
    suspects = stored(
        terms.filter((F.col("naming") > 0) & (-F.log2(lower_bound(F.col("naming"), F.col("documents"), z)) <= hidden_at))
        .select("term", "documents"),
        "pii-suspects",
    )
    bitmap = term_filter(suspects, bits_per_term, most_filter_bits)
    rows = packed(docs, carry, text=F.col(text_col))
    scanned = stored(_scan(rows, bitmap).withColumn("rid", F.monotonically_increasing_id()), "pii-scan")
    places = stored(
        scanned.select("rid", F.explode("hits").alias("h")).select("rid", "h.*").join(suspects, "term"), "pii-places"
    )
    telling = disclosures(
        scanned.count(),
        scanned.select("rid", F.explode("entities").alias("entity")),
        places.select("rid", "term", "documents").distinct(),
        generalise_at, hidden_at, remove_at, z,
    )
    flagged = (
        places.join(stored(telling, "pii-telling"), "term")
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))
    )
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    return scanned.select(ROW, "base", "rid").join(flagged, "rid", "left").select(
        ROW, "base", F.coalesce("terms", none).alias("terms")
    )


def span_list(spans: Column) -> Column:
    """kind:start:end of sorted (start, kind, end), comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )


def all_spans(base: Column, terms: Column) -> Column:
    extra = F.transform(
        terms,
        lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")),
    )
    return F.array_sort(F.concat(base, extra))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, a count per kind, base_sha256, spans and n_term for every row."""
    found = find(docs, text_col, carry=[F.col(id_col).alias("doc_id")], **options)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return found.select(
        f"{ROW}.doc_id",
        *counts,
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(all_spans(F.col("base"), F.col("terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def masked(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with spans replaced by their kind; removed terms by nothing but a mark."""
    marks = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base]
    for s, e, removed in terms:
        general = "[NUMBER]" if text[s:e].isdigit() else "[NAME]" if text[s].isupper() else "[WORD]"
        marks.append((s, e, "[REMOVED]" if removed else general))
    out, at = [], 0
    for s, e, mark in sorted(marks):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``row`` (all input columns), base, terms and the sanitised text; null stays null."""
    found = find(docs, text_col, **options)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            clean = [
                None if r["text"] is None else masked(
                    r["text"],
                    [(s["start"], s["kind"], s["end"]) for s in r["base"]],
                    [(t["start"], t["end"], t["removed"]) for t in r["terms"]],
                )
                for r in batch.select(["text", "base", "terms"]).to_pylist()
            ]
            columns = [batch.column(n) for n in (ROW, "base", "terms")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(clean, pa.string())], names=[ROW, "base", "terms", "sanitised"])

    rows = found.select(ROW, "base", "terms", F.col(ROW)[text_col].alias("text"))
    schema = T.StructType([*(rows.schema[n] for n in (ROW, "base", "terms")), T.StructField("sanitised", T.StringType())])
    return rows.mapInArrow(run, schema)
