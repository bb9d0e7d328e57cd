"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits (A-Z folded) and non-ASCII bytes. A benchmark item gives windows of SPAN consecutive words;
a shorter item is one window of all its words. Of every SPAN - GRAM + 1 consecutive GRAM-word hashes the smallest (leftmost of
equals) is a fingerprint. Two equal windows choose the same position, so every shared window shares a fingerprint; fingerprints
of documents are looked up among those of the benchmark and each hit is extended word by word to the windows around it. Items
shorter than SPAN are looked up by the hash of all their words, one length at a time. Word identity is a 64-bit hash per word.

The benchmark goes to the tasks as broadcast blocks of at most BLOCK_WORDS words; documents stream past one block after another
and carry the found ranges and items along, so any benchmark works with bounded memory and nothing of the documents is shuffled.

Defined results: null or empty text has no words, no hits and is not contaminated; items without words match nothing; a null
item_id counts as the item 'null'; repeated items count once per item_id; repeated documents each give a row. Other columns
travel inside a struct, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .words import ALNUM, Words, flat, slices, sliding_min, text_of

SPAN = 13
GRAM = 5
BLOCK_WORDS = 1_000_000


class Block(NamedTuple):
    """Some items: ids, their words with SPAN empty places around each, sorted fingerprints with item and word place."""

    ids: list[str]
    words: np.ndarray
    print_: np.ndarray
    place: np.ndarray
    item: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted hashes, items


def block_of(ids: list[str], texts: pa.Array) -> Block:
    data, offsets = flat(texts)
    words = Words(data, offsets, ALNUM)
    counts = words.counts()
    padded = np.zeros(len(words) + SPAN * (2 * len(ids) + 1), np.uint64)
    shift = SPAN * (2 * words.doc() + 1)
    padded[np.arange(len(words)) + shift] = words.hash
    long_word = counts[words.doc()] >= SPAN
    at = chosen(words) if len(words) else np.zeros(0, np.int64)
    at = at[long_word[at]]
    prints = words.grams(GRAM)[at]
    order = np.argsort(prints, kind="stable")
    short = {}
    for length in {int(c) for c in counts if 0 < c < SPAN}:
        which = np.flatnonzero(counts == length)
        hashes = words.grams(length)[words.first[which]]
        turn = np.argsort(hashes, kind="stable")
        short[length] = (hashes[turn], which[turn])
    return Block(ids, padded, prints[order], (at + shift[at])[order], words.doc()[at][order], short)


def chosen(words: Words) -> np.ndarray:
    """Word positions of the fingerprints of all texts: the minimum of each full window inside a text."""
    least = sliding_min(words.grams(GRAM), SPAN - GRAM + 1)
    return np.unique(least[words.whole(SPAN)])


def pairs(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index into values, index into sorted table) with equal entries."""
    low, high = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    size = high - low
    left = np.repeat(np.arange(len(values)), size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return left, np.repeat(low, size) + within


def windows(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, length, item) of every occurrence of a window of the block."""
    starts, sizes, items = [], [], []
    at = chosen(words)
    if len(at) and len(block.print_):
        hit, entry = pairs(words.grams(GRAM)[at], block.print_)
        place, other = at[hit], block.place[entry]
        doc = np.searchsorted(words.first, place, "right") - 1
        reach = np.arange(-(SPAN - GRAM), SPAN)
        for cut in range(0, len(place), 200_000):
            part = slice(cut, cut + 200_000)
            mine = place[part, None] + reach
            inside = (mine >= words.first[doc[part]][:, None]) & (mine < words.first[doc[part] + 1][:, None])
            same = inside & (words.hash[np.clip(mine, 0, len(words) - 1)] == block.words[other[part, None] + reach])
            run = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            full = run[:, SPAN:] - run[:, :-SPAN] == SPAN
            row, first = np.nonzero(full)
            starts.append(place[part][row] + reach[first])
            items.append(block.item[entry[part]][row])
            sizes.append(np.full(len(row), SPAN))
    for length, (hashes, which) in block.short.items():
        value = words.grams(length)
        spot = np.flatnonzero(words.whole(length))
        hit, entry = pairs(value[spot], hashes)
        starts.append(spot[hit])
        items.append(which[entry])
        sizes.append(np.full(len(hit), length))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (starts, sizes, items))


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(new[1:], True)] if len(new) else ends


def _scan(block, names: list[str]):
    """Adds what one block finds to the columns that ride along; of each row the fields ``names`` go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        for batch in slices(batches):
            words = Words(*flat(text_of(batch)), ALNUM)
            start, size, item = windows(words, index)
            doc = np.searchsorted(words.first, start, "right") - 1
            order = np.argsort(doc, kind="stable")
            start, size, item, doc = start[order], size[order], item[order], doc[order]
            columns = [batch.column(c).to_pylist() for c in ("starts", "ends", "items")]
            for d, low, high in zip(*_runs(doc)):
                first = start[low:high] - words.first[d]
                held = np.array(columns[0][d], np.int64), np.array(columns[1][d], np.int64)
                a, b = _merge(np.concatenate([held[0], first]), np.concatenate([held[1], first + size[low:high]]))
                columns[0][d], columns[1][d] = a.tolist(), b.tolist()
                columns[2][d] = sorted({*columns[2][d], *(index.ids[i] for i in np.unique(item[low:high]))})
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            row = pa.StructArray.from_arrays([pc.struct_field(batch.column("row"), n) for n in names], names)
            yield pa.record_batch(
                [row, pa.array(words.counts(), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["row", "n_words", "starts", "ends", "items"],
            )

    return run


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, from, to) of each run of equal values."""
    if not len(sorted_):
        return sorted_, sorted_, sorted_
    low = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return sorted_[low], low, np.append(low[1:], len(sorted_))


def blocks(bench: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of at most BLOCK_WORDS words (a longer item alone)."""
    ids, texts, size = [], [], 0
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        words = len(row.t) // 2 + 1  # no more words than this
        if ids and size + words > BLOCK_WORDS:
            yield block_of(ids, pa.array(texts, pa.large_string()))
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += words
    yield block_of(ids, pa.array(texts, pa.large_string()))


def hits(docs: DataFrame, bench: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each document: ``row`` (its columns ``keep``, by default all), n_words, starts / ends (ranges of words inside
    benchmark windows) and items (ids of those that occur)."""
    none = F.array().cast("array<int>")
    found = docs.select(
        F.struct(*docs.columns).alias("row"), F.lit(0).cast("bigint").alias("n_words"),
        none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"),
    )
    parts = list(blocks(bench))
    for number, block in enumerate(parts):
        names = (keep or docs.columns) if number == len(parts) - 1 else docs.columns
        schema = StructType([
            StructField("row", StructType([docs.schema[n] for n in names])), StructField("n_words", LongType()),
            StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("items", ArrayType(StringType())),
        ])
        found = found.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), names), schema)
    return found


def n_hit() -> Column:
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def contaminated(hit: Column, words: Column) -> Column:
    """At least one word in twenty lies inside a window of the benchmark."""
    return (hit > 0) & (20 * hit >= words)


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each document."""
    found = hits(docs.select("doc_id", "text"), bench, ["doc_id"]).withColumn("n_hit", n_hit())
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    return hits(docs, bench).where(~contaminated(n_hit(), F.col("n_words"))).select("row.*")
