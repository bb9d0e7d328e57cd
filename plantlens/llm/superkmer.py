"""Removal of repeated word windows by super-k-mer partitioning.

Words are runs without ASCII white space, unchanged. A window is SPAN consecutive words of one document. A word is removed when it
lies in a window whose word sequence also starts in a document with a smaller id (judged on the input).

The minimiser of a window is the smallest hash among its MINI-word runs (leftmost of equals). Consecutive windows with one
minimiser travel as one packed string (a super-k-mer) to the bucket of the minimiser's hash, so equal windows meet there. A chunk of about
CHUNK_BYTES of text sends each different super-k-mer once, with the smallest and largest document id that have it, so a passage that many
documents share travels once a chunk. A bucket names the words of its strings by dense numbers, sorts windows by ranks of ever longer
word runs (exact, no hash decides) and answers each chunk with the smallest document id of its shared windows. Chunks then
mark their words. Strings of one chunk and bucket are one
zstd-compressed row; chunks and answers meet by chunk number.

Defined results: null or empty text has no words; documents below SPAN words keep all; a null doc_id is larger than any other and
rows with equal ids never remove each other's windows. Other columns travel along by chunk, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .words import GRAM, PLAIN, Words, flat, gather, mix, run_hash, sliding_min, text_of

SPAN = 13
MINI = 3
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20
NEVER = (1 << 63) - 1
MINI_BITS = 0xFFFFFF
ROW = pa.schema([("place", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])
ROWS = "place bigint, chunk bigint, body binary"


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed Arrow record."""
    sink = pa.BufferOutputStream()
    columns = {k: pa.array([v]) if isinstance(v, bytes) else pa.array([v.tobytes()]) for k, v in arrays.items()}
    batch = pa.record_batch(list(columns.values()), names=list(columns))
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=6).compress(sink.getvalue())


def unpack(body: bytes) -> dict[str, bytes]:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)) as stream:
        return {k: v[0] for k, v in stream.read_next_batch().to_pydict().items()}


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in chunks of about CHUNK_BYTES of text; borders depend on the rows alone, not on the batches."""
    held, done, current = [], 0, 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(text_of(batch)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (done + np.cumsum(size) - size) // CHUNK_BYTES
        done += int(size.sum())
        cut = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
        for a, b in zip(cut, np.append(cut[1:], len(number)).astype(int)):
            if held and number[a] != current:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            current = number[a]
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    field = batch.column("doc_id") if "doc_id" in batch.schema.names else pc.struct_field(batch.column("row"), "doc_id")
    return pc.fill_null(field.cast(pa.int64()), NEVER).to_numpy(zero_copy_only=False)


class SuperKmers:
    """Super-k-mers of a chunk: first ``window`` and ``count`` of windows, end word, minimiser, document; ``which`` numbers their
    contents and ``sample`` holds one super-k-mer of each content."""

    def __init__(self, words: Words):
        grams = words.grams(MINI)
        least = sliding_min(grams, SPAN - MINI + 1)
        whole = np.flatnonzero(words.whole(SPAN))
        at = least[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)
        first = np.flatnonzero(new)
        self.window = whole[first]
        self.count = np.diff(np.append(first, len(whole)))
        self.end = self.window + self.count + SPAN - 1
        self.mini = grams[at[first]]
        self.doc = np.searchsorted(words.first, self.window, "right") - 1
        a, b = (run_hash(v, self.window, self.end) for v in (words.hash, mix(words.hash ^ GRAM)))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.sample = order[fresh]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(fresh) - 1


def _send(buckets: int):
    """Super-k-mers of the chunks of this task, addressed to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _opened(batches):
            words = Words(*flat(text_of(batch)), PLAIN)
            if len(words) < SPAN:
                continue
            kmers = SuperKmers(words)
            if not len(kmers.window):
                continue
            ids = ids_of(batch)[kmers.doc]
            low, high = np.full(len(kmers.sample), NEVER), np.full(len(kmers.sample), -NEVER - 1)
            np.minimum.at(low, kmers.which, ids)
            np.maximum.at(high, kmers.which, ids)
            mini = kmers.mini[kmers.sample]
            bucket = (mini >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
            places, bodies = [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                mine = order[a:b]
                first = kmers.window[kmers.sample[mine]]
                last = kmers.end[kmers.sample[mine]]
                text, offsets = gather(words.data, words.start[first], words.end[last - 1])
                places.append(int(bucket[mine[0]]))
                bodies.append(pack(
                    text=text, size=np.diff(offsets).astype(np.int32), name=np.diff(mine, prepend=0).astype(np.int32),
                    low=low[mine], more=high[mine] - low[mine], mini=(mini[mine] & np.uint64(MINI_BITS)).astype(np.uint32),
                ))
            yield pa.record_batch([places, [number] * len(places), bodies], schema=ROW)

    return run


def _ranks(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of dense numbers."""
    return np.unique(low * (int(high.max(initial=0)) + 1) + high, return_inverse=True)[1]


def answers_of(parts: list[tuple[int, dict[str, bytes]]]) -> Iterator[tuple[int, bytes]]:
    """(chunk, answer) of one bucket: super-k-mer name, run of windows inside it, smallest document id, where that may remove something."""
    size = [np.frombuffer(p["size"], np.int32) for _, p in parts]
    chunk = np.repeat([c for c, _ in parts], [len(s) for s in size])
    name = np.concatenate([np.cumsum(np.frombuffer(p["name"], np.int32), dtype=np.int64) for _, p in parts])
    low, high, mini = (np.concatenate([np.frombuffer(p[k], t) for _, p in parts]) for k, t in (("low", np.int64), ("more", np.int64), ("mini", np.uint32)))
    high = low + high
    # a minimiser (its low bits) that one document alone sent has no shared window
    order = np.argsort(mini, kind="stable")
    cut = np.flatnonzero(np.append(True, mini[order][1:] != mini[order][:-1]))
    least, most = np.minimum.reduceat(low[order], cut), np.maximum.reduceat(high[order], cut)
    alive = np.empty(len(mini), bool)
    alive[order] = np.repeat(least < most, np.diff(np.append(cut, len(order))))
    if not alive.any():
        return
    data = np.concatenate([np.frombuffer(p["text"], np.uint8) for _, p in parts])
    ends = np.cumsum(np.concatenate(size), dtype=np.int64)
    data, offsets = gather(data, (ends - np.concatenate(size))[alive], ends[alive])
    chunk, name, low, high = chunk[alive], name[alive], low[alive], high[alive]
    words = Words(data, offsets, PLAIN)
    raw, spans = gather(data, words.start, words.end)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(spans), pa.py_buffer(raw)])
    one = pc.dictionary_encode(strings).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    two = _ranks(one[:-1], one[1:])
    four = _ranks(two[:-2], two[2:])
    eight = _ranks(four[:-4], four[4:])
    spot = np.flatnonzero(words.whole(SPAN))
    rank = _ranks(eight[spot], eight[spot + SPAN - 8])
    owner = np.searchsorted(words.first, spot, "right") - 1
    least = np.full(rank.max(initial=0) + 1, NEVER)
    np.minimum.at(least, rank, low[owner])
    told = np.flatnonzero(least[rank] < high[owner])
    owner, place, least = owner[told], spot[told] - words.first[owner[told]], least[rank[told]]
    # runs of windows of one super-k-mer with one answer
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    owner, place, least, count = owner[first], place[first], least[first], np.diff(np.append(first, len(new)))
    to = chunk[owner]
    turn = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.append(True, to[turn][1:] != to[turn][:-1])) if len(to) else []
    for a, b in zip(cut, np.append(cut[1:], len(to))):
        mine = turn[a:b]
        yield int(to[mine[0]]), pack(
            name=name[owner[mine]].astype(np.int32), window=place[mine].astype(np.int32), count=count[mine].astype(np.int32), least=least[mine])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: answers of each bucket, addressed to chunks."""
    for parts in _groups(batches):
        for to, body in answers_of([(chunk, unpack(body)) for chunk, body in parts]):
            yield pa.record_batch([[to], [to], [body]], schema=ROW)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """(chunk, body) of each place, rows sorted by place."""
    held, at = [], None
    for batch in batches:
        for place, *rest in zip(*(batch.column(c).to_pylist() for c in ("place", "chunk", "body"))):
            if place != at and held:
                yield held
                held = []
            at = place
            held.append(tuple(rest))
    if held:
        yield held


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk, compressed."""
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(chunks(batches)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        at = task << 32 | number
        yield pa.record_batch([[at], [at], [zstandard.ZstdCompressor(level=3).compress(sink.getvalue())]], schema=ROW)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows) of the chunk table."""
    for batch in batches:
        for number, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
            yield number, _rows(body.as_py())


def _rows(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)) as stream:
        return stream.read_next_batch()


def _removed(batch: pa.RecordBatch, bodies: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words of a chunk and whether each is removed."""
    words = Words(*flat(text_of(batch)), PLAIN)
    change = np.zeros(len(words) + 1, np.int64)
    if bodies:
        kmers = SuperKmers(words)
        found = [unpack(b) for b in bodies]
        name, window, count = (np.concatenate([np.frombuffer(p[k], np.int32) for p in found]).astype(np.int64) for k in ("name", "window", "count"))
        least = np.concatenate([np.frombuffer(p["least"], np.int64) for p in found])
        # every occurrence of a named super-k-mer, joined with its answers
        order = np.argsort(kmers.which, kind="stable")
        group = np.searchsorted(kmers.which[order], np.arange(len(kmers.sample) + 1))
        size = group[name + 1] - group[name]
        entry = np.repeat(np.arange(len(name)), size)
        one = order[np.repeat(group[name], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        drop = ids_of(batch)[kmers.doc[one]] > least[entry]
        start = kmers.window[one[drop]] + window[entry[drop]]
        np.add.at(change, start, 1)
        np.add.at(change, start + count[entry[drop]] - 1 + SPAN, -1)
    return words, np.cumsum(change[:-1]) > 0


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their answers: row, n_words, n_removed, kept text."""
    for body, answers in ((b.as_py(), a.as_py()) for batch in batches for b, a in zip(batch.column("body"), batch.column("answers"))):
        batch = _rows(body)
        words, gone = _removed(batch, answers or [])
        doc = words.doc()
        stay = np.flatnonzero(~gone)
        raw, spans = gather(words.data, words.start[stay], words.end[stay])
        joined = np.full(len(raw) + len(stay), 0x20, np.uint8)  # each word and a space; a document drops its last space
        joined[np.arange(len(raw)) + np.repeat(np.arange(len(stay)), np.diff(spans))] = raw
        edge = np.append(0, np.cumsum(np.bincount(doc[stay], minlength=batch.num_rows)))
        ends = spans[edge] + edge
        joined = joined.tobytes()
        yield pa.record_batch(
            [
                batch.column("row"), pa.array(words.counts(), pa.int64()), pa.array(np.bincount(doc[gone], minlength=batch.num_rows), pa.int64()),
                pa.array([joined[a : max(a, b - 1)].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()),
            ],
            names=["row", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of a document), n_words, n_removed and ``kept``, the words that stay joined by one space.

    ``docs`` should be a stored table: chunks are numbered by task and place in it, and a task that runs again must see its rows again.
    Both uses of the chunks share one exchange.
    """
    conf = docs.sparkSession.conf
    texts = docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(_texts, ROWS).repartition("place")
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    total = docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    # super-k-mers hold each word about three times
    buckets = max(2 * int(conf.get("spark.sql.shuffle.partitions")), 3 * total // BUCKET_BYTES)
    sent = texts.mapInArrow(_send(buckets), ROWS)
    judged = sent.repartition("place").sortWithinPartitions("place").mapInArrow(_judge, ROWS)
    answers = judged.groupBy("place").agg(F.collect_list("body").alias("answers"))
    met = texts.join(answers, "place", "left").select("body", "answers")
    schema = StructType([
        StructField("row", docs.schema), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()),
    ])
    return met.mapInArrow(_mark, schema)
