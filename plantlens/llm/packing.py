"""Packing of documents into sequences of at most ``capacity`` tokens.

A document longer than a sequence is cut into full sequences and a rest. Rests are packed by first-fit decreasing inside randomised groups of
about GROUP_ROWS documents: a tournament tree over the free room of the bins finds the first bin that takes a piece in logarithmic
time. Groups come from a hash of id and content, so they are the same when a task runs again, and only ids, lengths and check sums
(or the ids, when sequences are wanted) travel. A group beyond GROUP_MOST rows (repeated rows) is packed in parts of that size.

Defined results: null or empty text is the end id alone; null doc_ids and repeated documents are packed like others, one document
each; an empty table gives no pieces. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import LEADING, encoder
from .words import slices

CAPACITY = 2048
END = 1
GROUP_ROWS = 2000
GROUP_MOST = 50_000
MEASURED = "doc_id bigint, doc_tokens bigint, crcs array<bigint>, parts array<binary>"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class FirstFit:
    """Tournament tree over the free room of bins; the winner of a node is its larger child."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """(first bin with room, offset in it); a bin for each piece is always there."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        free = room[node]
        room[node] = free - size
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return leaf, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; larger pieces are placed first, equal ones in the given order."""
    tree = FirstFit(capacity, len(sizes))
    places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        leaf, free = tree.put(sizes[i])
        places[i] = (leaf, capacity - free)
    return places


def _measure(path: str, capacity: int, end: int, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, LEADING)
        for batch in slices(batches):
            ids, size = encode.column(batch.column("text"), end)
            raw, ends = ids.tobytes(), (4 * np.cumsum(size)).tolist()
            docs = [raw[a:b] for a, b in zip([0, *ends], ends)]
            parts = [[d[i : i + 4 * capacity] for i in range(0, len(d), 4 * capacity)] for d in docs]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array([len(d) // 4 for d in docs], pa.int64()),
                    pa.array([[zlib.crc32(x) for x in p] for p in parts], pa.list_(pa.int64())),
                    pa.array(parts if carry else [None] * len(parts), pa.list_(pa.binary())),
                ],
                names=["doc_id", "doc_tokens", "crcs", "parts"],
            )

    return run


def _place(capacity: int):
    def placed(group: int, first: int, rows: list[tuple]) -> tuple[int, pa.RecordBatch]:
        rests = [n % capacity or capacity for _, n, _, _ in rows]
        bins = first_fit_decreasing(rests, capacity)
        used = first + 1 + max(b for b, _ in bins)
        out: list[list] = [[] for _ in range(8)]
        for (doc, tokens, crcs, parts), rest, (leaf, offset) in zip(rows, rests, bins):
            for i, crc in enumerate(crcs):
                last = i == len(crcs) - 1
                if not last:
                    used += 1
                at = first + leaf if last else used - 1
                row = (doc, i * capacity, rest if last else capacity, crc, tokens, group << 32 | at, offset if last else 0, parts and parts[i])
                for column, value in zip(out, row):
                    column.append(value)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return used, pa.record_batch([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(out, names)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, used = [], None, 0
        for batch in batches:
            for group, *row in zip(*(batch.column(c).to_pylist() for c in ("pack", "doc_id", "doc_tokens", "crcs", "parts"))):
                if held and (group != at or len(held) >= GROUP_MOST):
                    used, out = placed(at, used, held)
                    yield out
                    held = []
                if group != at:
                    at, used = group, 0
                held.append(row)
        if held:
            yield placed(at, used, held)[1]

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, carry: bool = False, seed: int = 17) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if ``carry``, its ids."""
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = text.mapInArrow(_measure(path, capacity, end, carry), MEASURED)
    group = F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs", F.lit(seed)), F.lit(groups)).cast("bigint")
    dealt = measured.withColumn("pack", group).repartition("pack").sortWithinPartitions("pack", "doc_id", "crcs")
    return dealt.mapInArrow(_place(capacity), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, docs (pieces in order) and the ids of each sequence, from pieces that carry their ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(rows.alias("docs"))
    ids = F.aggregate("docs", F.lit(b"").cast("binary"), lambda held, d: F.concat(held, d["ids"]))
    return whole.select("sequence_id", "docs", ids.alias("ids"))
