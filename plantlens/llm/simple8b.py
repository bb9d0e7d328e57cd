"""Token files in Simple-8b: word-aligned coding of unsigned integers.

Each 64-bit word holds a selector in its top four bits and as many equally wide values as fit below: the first selector of PACKINGS
whose count of following values fits its width (and the run) wins. Selector 15 is an escape: the word holds the place of a raw
64-bit value in the block's escape list, so every word can be decoded on its own and a block decodes in one vector pass per selector.

A file is a Parquet table of blocks, in ascending doc_id order by (part, block): a block has about BLOCK_IDS ids of consecutive
documents, ``ids_before`` (ids of its part before it) as its offset and one payload: counts, document ids (null ids first, then the
first id and the gaps), document lengths, words, escapes, all Simple-8b but the first id and the escapes.

Order: parts are ranges of doc_id whose borders Spark's range partitioner draws from the id column alone; texts are encoded before they travel.
Defined results: null or empty text is the end id alone; null doc_ids come first; equal doc_ids are ordered by length and content;
an empty table gives an empty file. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import fresh_path
from .tokens import BARE, encoder
from .words import slices

# fixed values: values per word and their bits, by selector 1 to 14
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
JUMPS = np.array([0, *(count for count, _ in PACKINGS), 1])
SHIFT = np.uint64(60)
LOW = np.uint64((1 << 60) - 1)
BLOCK_IDS = 1 << 16
END = 1
CODED = "part int, doc_id bigint, n bigint, words binary, escapes binary"
BLOCKS = "part int, block int, ids_before bigint, n_ids bigint, n_docs int, payload binary"
DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def encode(values: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, number of words before each run end). Runs of ``values`` end at ``ends`` and share no word."""
    values = values.astype(np.uint64)
    n = len(values)
    ends = np.array([n], np.int64) if ends is None else ends
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    # binary exponents; rounding of huge values can only ask for a wider place
    bits = np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    remaining = np.minimum(np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n), 255).astype(np.uint8)
    selector = np.full(n, ESCAPE, np.uint8)
    most = {1: bits}
    for width in (2, 4, 8, 16, 32):
        half, keep = most[width // 2], max(0, n - width // 2)
        most[width] = half.copy()
        np.maximum(half[:keep], half[n - keep :], out=most[width][:keep])
    for number in range(len(PACKINGS), 0, -1):
        count, width = PACKINGS[number - 1]
        if count > n:
            continue
        power = 1 << (count.bit_length() - 1)
        tops = most[power][: n - count + 1]
        if count > power:
            tops = np.maximum(tops, most[power][count - power : n - power + 1])
        fits = tops <= width
        fits &= remaining[: len(tops)] >= count
        np.copyto(selector[: len(tops)], number, where=fits)
    steps, starts, at = JUMPS[selector].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << SHIFT
    for number, (count, width) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero(chosen == number)
        for j in range(count if len(mine) else 0):
            words[mine] |= values[starts[mine] + j] << np.uint64(j * width)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, values[starts[escaped]], np.searchsorted(starts, ends)


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All values of the words."""
    chosen = (words >> SHIFT).astype(np.int64)
    counts = JUMPS[chosen]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for number, (count, width) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero(chosen == number)
        mask = np.uint64((1 << width) - 1)
        for j in range(count if len(mine) else 0):
            out[first[mine] + j] = (words[mine] >> np.uint64(j * width)) & mask
    mine = np.flatnonzero(chosen == ESCAPE)
    out[first[mine]] = escapes[(words[mine] & LOW).astype(np.int64)]
    return out


def _code(path: str, end: int, borders: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, BARE)
        for batch in slices(batches):
            tokened, size = tokens.column(batch.column("text"), end)
            words, escapes, ends = encode(tokened, np.cumsum(size))
            raw, cut = words.tobytes(), [0, *(8 * ends).tolist()]
            escaped = np.cumsum(np.append(0, (words >> SHIFT) == ESCAPE))[np.append(0, ends)]
            ids = batch.column("doc_id")
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(borders, known, "right"), 0)
            yield pa.record_batch(
                [
                    pa.array(part, pa.int32()), ids, pa.array(size), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([escapes[a:b].tobytes() for a, b in zip(escaped[:-1], escaped[1:])], pa.binary()),
                ],
                names=["part", "doc_id", "n", "words", "escapes"],
            )

    return run


def block_payload(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """Documents (id, number of ids, words, escapes) as one block; escape places are moved to the block's list."""
    ids = np.array([d for d, *_ in docs if d is not None], np.int64)
    gaps, gap_escapes, _ = encode(np.diff(ids).astype(np.uint64))
    sizes, _, _ = encode(np.array([n for _, n, _, _ in docs], np.uint64))
    words, escapes, seen = [], [], 0
    for _, _, raw, extra in docs:
        some = np.frombuffer(raw, "<u8").copy()
        mine = np.flatnonzero((some >> SHIFT) == ESCAPE)
        some[mine] = (np.uint64(ESCAPE) << SHIFT) | np.arange(seen, seen + len(mine), dtype=np.uint64)
        seen += len(mine)
        words.append(some)
        escapes.append(np.frombuffer(extra, "<u8"))
    words, escapes = np.concatenate(words), np.concatenate(escapes)
    lists = (gaps, gap_escapes, sizes, words, escapes)
    head = struct.pack("<IIqIIIII", len(docs), len(docs) - len(ids), int(ids[0]) if len(ids) else 0, *map(len, lists))
    return head + b"".join(x.astype("<u8").tobytes() for x in lists)


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids)."""
    size = struct.calcsize("<IIqIIIII")
    docs, nulls, first, *counts = struct.unpack("<IIqIIIII", payload[:size])
    cut = size + 8 * np.cumsum([0, *counts])
    gaps, gap_escapes, sizes, words, escapes = (np.frombuffer(payload[a:b], "<u8") for a, b in zip(cut[:-1], cut[1:]))
    ids = np.cumsum(np.append(first, decode(gaps, gap_escapes).astype(np.int64)))[: docs - nulls]
    return [None] * nulls + ids.tolist(), decode(sizes, escapes).astype(np.int64), decode(words, escapes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents sorted by (part, doc_id), as blocks."""
    held, size, part, block, before = [], 0, None, 0, 0

    def out() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), [before], [size], pa.array([len(held)], pa.int32()), [block_payload(held)]],
            names=["part", "block", "ids_before", "n_ids", "n_docs", "payload"],
        )

    for batch in batches:
        for at, *doc in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "words", "escapes"))):
            if held and (at != part or size >= BLOCK_IDS):
                yield out()
                held, block, before, size = [], block + 1, before + size, 0
            if at != part:
                part, block, before = at, 0, 0
            held.append(tuple(doc))
            size += doc[1]
    if held:
        yield out()


def write_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Ids of all documents as a table of blocks under ``path``."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.where("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).select("first").collect()
    borders = np.sort(np.array([r.first for r in firsts], np.int64))[1:]  # one number for each part
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = text.mapInArrow(_code(tokenizer, end, borders), CODED)
    placed = coded.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n", "words")
    placed.mapInArrow(_blocks, BLOCKS).write.option("compression", "none").mode("overwrite").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload")):
            docs, sizes, ids = read_block(payload.as_py())
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
            crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(base + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_files(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the blocks.

    The ids before a part are summed over one row for each part.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_before"))
    placed = blocks.join(F.broadcast(parts), "part")  # a part for each range of the writer
    return placed.select((F.col("part_before") + F.col("ids_before")).alias("base"), "payload").mapInArrow(_read, DOCS)


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_files(docs, path, tokenizer, end)
    return read_files(docs.sparkSession.read.schema(BLOCKS).parquet(path))
