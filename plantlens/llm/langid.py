"""Language identification by string kernels.

A text is its set of byte n-grams of 1 to MAX_GRAM bytes (letters folded, everything else one space), hashed to SLOTS places; the blended-spectrum
presence kernel of two texts is the cosine of their sets. LANDMARKS texts of each language span a Nyström approximation, in which one
ridge regression for each language against the rest is solved. As the kernel is linear in the presence vectors, the solved model is one SLOTS
x languages matrix, and a batch is scored by one matrix product.

Training reads a bounded sample: at most SAMPLE labelled texts of each language (LANDMARKS of them as landmarks), those with the smallest hashes of id
and text among rows that are not held out, so null ids and copies keep the bound. Held out are rows whose crc32 of the id as text is 2 modulo 4. A prediction sees the text alone.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is every text when no row is labelled; a null doc_id
counts as empty text for the held-out rule; repeated rows get equal results; ties go to the first language by name. Other columns
travel inside a struct, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .words import flat, slices, text_of

MAX_GRAM = 4
SLOTS = 1 << 15
SAMPLE = 1000
LANDMARKS = 64
RIDGE = 1e-2
ROWS_AT_ONCE = 256
SLICE = 1 << 20
LEAST = 0.4  # score below which no classifier claims a text
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, other ASCII as spaces."""
    table = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
    out = table[data]
    second = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    out[second] += 0x20
    return out


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x SLOTS, 1 where a text has an n-gram of that place."""
    out = np.zeros((len(offsets) - 1, SLOTS), np.float32)
    letters = _folded(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    edge = np.zeros(len(letters), bool)
    edge[offsets[:-1][offsets[:-1] < len(letters)]] = True
    keep = np.ones(len(letters), bool)  # one space for a run of them
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | edge[1:]
    letters, doc = letters[keep].astype(np.uint32), doc[keep]
    code = np.zeros(len(letters), np.uint32)
    for n in range(1, MAX_GRAM + 1):
        m = len(letters) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | letters[n - 1 :]
        place = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17)
        inside = doc[:m] == doc[n - 1 :]
        out[doc[:m][inside], place[inside]] = 1
    return out


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; empty rows stay."""
    return matrix / np.maximum(np.sqrt(matrix.sum(axis=1, keepdims=True)), 1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Few rows at once, with their kernel vectors."""
    for batch in slices(batches, SLICE):
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            yield part, unit(presence(*flat(text_of(part))))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, vectors in _parts(batches):
        bits = np.packbits(vectors > 0, axis=1)
        yield pa.record_batch([part.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "bits"])


def _kernel(landmarks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = landmarks.value.T
        for part, vectors in _parts(batches):
            row = [k.tobytes() for k in (vectors @ others).astype(np.float32)]
            yield pa.record_batch([part.column("lang"), pa.array(row, pa.binary())], names=["lang", "kernel"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def _draw() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)


def different(rows: DataFrame) -> dict[str, int]:
    """About how many different rows each language has."""
    return {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct(_draw()).alias("n")).collect()}


def drawn(rows: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """(text, lang) of the rows with the smallest draws, ``most`` of a language; copies share a draw, so their number is cut too."""
    draw = _draw()
    share = F.element_at(F.create_map(*(F.lit(x) for n, c in counts.items() for x in (n, min(1.0, 2 * most / c)))), F.col("lang"))
    few = rows.where(has_letter(F.col("text")) & (draw < share)).select("text", "lang", draw.alias("draw"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    return few.withColumn("place", place).where(F.col("place") <= most).select("text", "lang")


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """``docs`` has doc_id, text and lang; at most ``sample`` texts of each language are learned from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = different(rows)
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    bits = drawn(rows, counts, landmarks).mapInArrow(_bits, "lang string, bits binary").orderBy("lang", "bits").collect()
    if not bits:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    marks = unit(np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in bits]).reshape(-1, SLOTS // 8), axis=1).astype(np.float32))
    sent = spark.sparkContext.broadcast(marks)
    found = drawn(rows, counts, sample).mapInArrow(_kernel(sent), "lang string, kernel binary").orderBy("lang", "kernel").collect()
    kernel = np.array([np.frombuffer(r.kernel, np.float32) for r in found], np.float64).reshape(-1, len(marks))
    target = np.array([[1.0 if r.lang == n else -1.0 for n in names] for r in found]).reshape(-1, len(names))
    square = (marks @ marks.T).astype(np.float64)
    solved = np.linalg.solve(kernel.T @ kernel + RIDGE * len(found) * square + 1e-6 * np.eye(len(marks)), kernel.T @ target)
    return Model(names, (marks.T @ solved).astype(np.float32))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = model.value
        for part, vectors in _parts(batches):
            known = part.column("letters").to_numpy(zero_copy_only=False)
            scores = vectors @ weights if names else np.zeros((part.num_rows, 1), np.float32)
            best = scores.argmax(axis=1)
            top = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)
            sure = known & bool(names)
            lang = [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), sure.tolist())]
            row = part.column("row")
            yield pa.record_batch([row, part.column("held"), pa.array(lang, pa.string()), pa.array(np.where(sure, top, 0.0))], names=["row", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of a document), held_out, lang_pred and score."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), held_out(F.col("doc_id")).alias("held"), has_letter(F.col("text")).alias("letters"))
    schema = StructType([
        StructField("row", docs.schema), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()),
    ])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema)


def keep_known(docs: DataFrame, wanted: Sequence[str] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose text is in a ``wanted`` language (any that the labelled rows teach, if null), with all their columns.

    A text whose best language scores below ``least`` belongs to none: every one-versus-rest classifier is far from claiming it.
    """
    known = F.col("lang_pred") != UNKNOWN if wanted is None else F.col("lang_pred").isin(*wanted)
    return predict(docs, train(docs)).where(known & (F.col("score") >= least)).select("row.*")
