"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD.

A text's subwords are the 3- and 4-byte windows of its lower-cased words, with word
borders, hashed into ``2**BITS`` buckets. Their embeddings are averaged and a linear
layer with softmax gives the languages. Training is plain minibatch SGD in numpy on a
bounded sample: at most ``per_language`` texts of a language and ``max_sample`` in all,
those with the smallest hash. Executors turn whole texts into sparse bucket counts, only
these reach the driver. A part of the sample that SGD never sees calibrates the scores
(one temperature) and the rejection threshold.

As nothing stands between averaging and the linear layer, a trained model is applied as a
table of one row of language scores per bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import ROW, packed, stored, text_slices

UNDECIDED = "und"
BITS = 14
DIM = 16
#: The sample is cut by 2**SAMPLE_BITS hash bins per language; a bin is what a task may sort beyond it.
SAMPLE_BITS = 16
#: Every ASCII byte that is no letter becomes a space; other bytes stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Any character of the Unicode categories L*; numerals, marks and signs are none."""
    return any(map(str.isalpha, text))


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all subwords of a whole text, repeats included."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    three = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    four = three[:-1] | data[3:] << np.uint32(24)
    shift = np.uint32(32 - BITS)
    return np.concatenate(
        ((three * np.uint32(2654435761)) >> shift, ((four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift)
    )


@dataclass
class Model:
    """languages in code-point order; table: scores per bucket; a score below reject_below is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not has_letter(text):
            return UNDECIDED, 0.0
        buckets = subwords(text)
        mean = self.table[buckets].mean(axis=0, dtype=np.float64) if len(buckets) else 0.0
        p = _softmax(((mean + self.bias) / self.temperature)[None, :])[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bucket shares of a minibatch of sparse counts."""
    x = np.zeros((len(docs), 1 << BITS), np.float32)
    for row, (buckets, counts) in zip(x, docs):
        row[buckets] = counts / max(counts.sum(), 1)
    return x


def fit(
    docs: list[tuple[np.ndarray, np.ndarray]],
    langs: list[str],
    epochs: int = 12,
    batch: int = 16,
    rate: float = 0.5,
    reject_share: float = 0.001,
    seed: int = 7,
) -> Model:
    """Train on four fifths of the sample, calibrate on the rest.

    The embedding step is scaled by the bucket count, since a text's average touches each
    embedding with a share of about one in thousands. The threshold rejects at most
    ``reject_share`` of the calibration texts and never a score above one half.
    """
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in langs])
    held = np.arange(len(docs)) % 5 == 4
    train, check = np.flatnonzero(~held), np.flatnonzero(held)
    emb = rng.uniform(-1, 1, (1 << BITS, DIM)).astype(np.float32) / DIM
    out = rng.normal(0, 1 / DIM, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x = _dense([docs[i] for i in rows])
            mean = x @ emb
            grad = _softmax(mean @ out + bias)
            grad[np.arange(len(rows)), target[rows]] -= 1
            grad /= len(rows)
            now = rate * (1 - step / steps)
            back = grad @ out.T
            out -= now * (mean.T @ grad)
            bias -= now * 0.1 * grad.sum(axis=0)
            emb -= now * 400 * (x.T @ back)
            step += 1
    table = emb @ out
    at = check if len(check) else train
    logits = np.concatenate([_dense([docs[i]]) @ table for i in at]) + bias
    truth = target[at]

    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / t)[np.arange(len(at)), truth] + 1e-12).mean())

    temperature = min((2.0 ** (k / 4) for k in range(-16, 17)), key=loss)
    best = _softmax(logits / temperature).max(axis=1)
    reject_below = min(0.5, float(np.quantile(best, reject_share, method="lower")))
    return Model(languages, table.astype(np.float32), bias, float(temperature), reject_below)


def held_out(id_col: str) -> Column:
    """True where the id's crc32 is 0 modulo 5; a null id counts as the empty text, which is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 300,
    max_sample: int = 6000,
    **options,
) -> Model:
    """Fit on a bounded sample of the rows that are not held out and have a language and a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 64):
            pairs = [np.unique(subwords(t), return_counts=True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("order"),
                    pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                    pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32())),
                ],
                names=["lang", "order", "buckets", "counts"],
            )

    labelled = docs.filter(~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)).alias("order"),
    )
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # counts per hash bin say how far the sample reaches, so that no other text is shuffled
    bins = labelled.withColumn("bin", F.shiftright("order", 64 - SAMPLE_BITS))
    running = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        bins.groupBy("lang", "bin").count()
        .withColumn("before", F.coalesce(F.sum("count").over(running), F.lit(0)))
        .filter(F.col("before") < per_language)
        .groupBy("lang").agg(F.max("bin").alias("last"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    sample = (
        bins.join(stored(reach, "langid-reach"), "lang")
        .filter(F.col("bin") <= F.col("last"))
        .withColumn("place", place)
        .filter(F.col("place") <= per_language)
        .orderBy("place", "lang")
        .limit(max_sample)
        .select("lang", "order", "text")
    )
    found = sample.mapInArrow(run, "lang string, order long, buckets array<int>, counts array<int>").toArrow()
    found = found.sort_by([("order", "ascending"), ("lang", "ascending")])
    sparse = [
        (np.asarray(b.values), np.asarray(c.values)) for b, c in zip(found["buckets"], found["counts"])
    ]
    return fit(sparse, found["lang"].to_pylist(), **options)


def _predictor(model: Model, carried: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(carried),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                    pa.array(
                        [lang == UNDECIDED or score < model.reject_below for lang, score in found], pa.bool_()
                    ),
                ],
                names=[carried, "lang_pred", "score", "rejected"],
            )

    return run


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", carry: list[Column] | None = None
) -> DataFrame:
    """One row per input row: ``row`` (all input or the carried columns), lang_pred, score, rejected.

    Whole texts are read; a null text or one without a letter is ``und`` with score 0 and
    rejected, as is every text when there was nothing to learn from. Otherwise the score is
    the calibrated probability of the predicted language and rejected means it is below the
    calibrated threshold. Very long texts cost memory in proportion to one text.
    """
    rows = packed(docs, carry, text=F.col(text_col))
    fields = [
        rows.schema[ROW],
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return rows.mapInArrow(_predictor(model, ROW), T.StructType(fields))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, by a model of the rows not held out."""
    model = train(docs, id_col, text_col, **options)
    carry = [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")]
    return identify(docs, model, text_col, carry).select(f"{ROW}.*", "lang_pred", "score", "rejected")


def accepted_rows(docs: DataFrame, text_col: str = "text", model: Model | None = None, **options) -> DataFrame:
    """The rows whose language is not rejected, with the columns of the input.

    With no labelled row there is no model and only texts without a letter go.
    """
    model = model or train(docs, text_col=text_col, **options)
    if not model.languages:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    return identify(docs, model, text_col).filter(~F.col("rejected")).select(f"{ROW}.*")
