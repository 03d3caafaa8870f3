"""SentencePiece encoding and decoding that keeps the place of every piece in the source.

The model's compiled character map (a double-array trie followed by its replacement
texts) is applied by longest prefix, and every normalised byte remembers the source byte
it came from. Pieces then tile the normalised text, so the running sum of their lengths,
read through that alignment, gives each piece's span of original bytes. A map without
rules leaves characters as they are and the alignment is computed on whole arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tidelake.llm.common import ROW, packed, text_slices

SPACE = "▁".encode()
# fixed values of the model format: piece kinds, and the bits of a trie unit
BYTE_PIECE, CONTROL_PIECE = 6, 3
LABEL, VALUE = 0x800000FF, 0x7FFFFFFF


class CharMap:
    """Longest-prefix lookups in a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :] if size else b""

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(length of the longest rule that starts here, its replacement), or None."""
        if not self.units:
            return None
        found = None
        node = self._offset(self.units[0])
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(self.units) or self.units[node] & LABEL != data[at]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & VALUE
                found = at + 1 - start, self.texts[value : self.texts.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """The model's normalisation with, for each normalised byte, where its source starts."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = (
            spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        )
        self.suffix = suffix

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Replaced bytes with the start and end of the source characters behind each."""
        if not self.map.units:
            octets = np.frombuffer(data, np.uint8)
            heads = np.flatnonzero((octets & 0xC0) != 0x80)
            ends = np.append(heads, len(data))[1:]
            lengths = ends - heads
            return data, np.repeat(heads, lengths), np.repeat(ends, lengths)
        out, starts, ends, at = bytearray(), [], [], 0
        while at < len(data):
            rule = self.map.longest(data, at)
            if rule:
                length, text = rule
            else:
                lead = data[at]
                length = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                text = data[at : at + length]
            out += text
            starts += [at] * len(text)
            ends += [at + length] * len(text)
            at += length
        return bytes(out), np.array(starts, np.int64), np.array(ends, np.int64)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised bytes, source start and source end of each of them)."""
        text, starts, ends = self._mapped(data)
        octets = np.frombuffer(text, np.uint8)
        if self.squeeze and len(octets):
            blank = octets == 32
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            if keep.any() and blank[np.flatnonzero(keep)[-1]]:
                keep[np.flatnonzero(keep)[-1]] = False
            octets, starts, ends = octets[keep], starts[keep], ends[keep]
        if len(octets) and self.prefix:
            octets, starts, ends = (
                (np.append(octets, 32).astype(np.uint8), np.append(starts, len(data)), np.append(ends, len(data)))
                if self.suffix
                else (np.insert(octets, 0, 32), np.insert(starts, 0, 0), np.insert(ends, 0, 0))
            )
        if not self.escape:
            return octets.tobytes(), starts, ends
        wide = np.where(octets == 32, len(SPACE), 1)
        return octets.tobytes().replace(b" ", SPACE), np.repeat(starts, wide), np.repeat(ends, wide)


class Codec:
    """Encode, project and decode with one model."""

    def __init__(self, proto: bytes):
        model = model_pb2.ModelProto.FromString(proto)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.normalize = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.width = np.array(
            [1 if p.type == BYTE_PIECE else 0 if p.type == CONTROL_PIECE else len(p.piece.encode()) for p in model.pieces]
        )
        self.unknown = model.trainer_spec.unk_id

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.sp.encode(texts, out_type=int, add_bos=True, add_eos=True, num_threads=1)
        return [np.array(ids, "<u4") for ids in found]

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end source byte of each piece; begin and end marks are empty spans.

        The pieces of one character (byte fallback) share its span.
        """
        data = text.encode("utf-8")
        normal, first, past = self.normalize(data)
        ends = np.cumsum(self._widths(ids, text))
        if ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        starts = np.concatenate(([0], ends[:-1]))
        edge = np.append(first, len(data))
        upto = np.insert(past, 0, 0)
        empty = starts == ends
        return edge[starts], np.where(empty, edge[starts], upto[ends])

    def _widths(self, ids: np.ndarray, text: str) -> np.ndarray:
        if not (ids == self.unknown).any():
            return self.width[ids]
        pieces = self.sp.encode(text, out_type=str, add_bos=True, add_eos=True)
        widths = self.width[ids].copy()
        for i in np.flatnonzero(ids == self.unknown):
            widths[i] = len(pieces[i].encode())
        return widths


@lru_cache(maxsize=4)
def _codec(proto: bytes) -> Codec:
    return Codec(proto)


def encode_decode(
    docs: DataFrame,
    model_path: str,
    text_col: str = "text",
    arrays: bool = False,
    carry: list[Column] | None = None,
) -> DataFrame:
    """One row per input row: ``row`` (all input or the carried columns), ids, starts, ends, decoded.

    ids are exactly those of the model with begin and end marks; starts and ends are the
    source bytes of each piece; decoded is the text of the ids. The three lists are packed
    little-endian 32-bit numbers, or with ``arrays`` Spark arrays. A null text counts as
    empty and gives the two marks alone. The model is read once on the driver, so
    executors need no file. Memory is that of one Arrow batch and one long text.
    """
    with open(model_path, "rb") as file:
        proto = file.read()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(proto)
        for batch in text_slices(batches, 128):
            texts = batch.column("text").to_pylist()
            ids = codec.encode(texts)
            spans = [codec.spans(t, i) for t, i in zip(texts, ids)]
            lists = [ids, [s.astype("<u4") for s, _ in spans], [e.astype("<u4") for _, e in spans]]
            if arrays:
                columns = [pa.array([x.astype(np.int32) for x in v], pa.list_(pa.int32())) for v in lists]
            else:
                columns = [pa.array([x.tobytes() for x in v], pa.binary()) for v in lists]
            decoded = pa.array([codec.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), *columns, decoded], names=[ROW, "ids", "starts", "ends", "decoded"]
            )

    rows = packed(docs, carry, text=F.coalesce(F.col(text_col), F.lit("")))
    kind = T.ArrayType(T.IntegerType()) if arrays else T.BinaryType()
    fields = [rows.schema[ROW], *(T.StructField(n, kind) for n in ("ids", "starts", "ends"))]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 of packed encode_decode rows."""
    coded = encode_decode(docs, model_path, text_col, carry=[F.col(id_col).alias("doc_id")])
    return coded.select(
        f"{ROW}.doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"),
    )
