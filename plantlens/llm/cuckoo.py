"""Exact deduplication of texts over a cuckoo-filter index of live digests.

Texts are equal when identical after each run of ASCII white space is replaced by one space; null counts as empty. Digests are
sha256 of that text. The index is cut into buckets by digest. A bucket holds its live keys (digest, keeper, group size) and a cuckoo filter
over them: the filter answers "surely new" without touching the keys, and every hit is verified against the stored keys. When
an insertion finds no slot, the filter is rebuilt at twice the size from the stored keys. Deletion removes one fingerprint.

Skew: each task combines the copies of its Arrow batches (smallest id, rows) before they travel, so a bucket receives a text at
most once per batch; the join that gives every row its keeper is a plain equi join which adaptive execution splits.

Defined results: a null doc_id is larger than any other; rows without id are kept only if their text has no row with one (keep_id
is then null). Repeated (doc_id, text) rows count separately and share their keeper; each row that carries the keeper's id is
kept (``one_of_equal`` goes on to one row of each text). An empty table gives no rows. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .components import stored
from .identity import one_of_repeated, repeated, without

SLOTS = 4
KICKS = 200
NEVER = (1 << 63) - 1  # stands for a null doc_id: larger than all
KEYS = "bucket int, digest binary, keep_id bigint, group_size bigint"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; partial-key cuckoo hashing over 32-byte digests."""

    def __init__(self, keys: int = 64):
        self.rows = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        self.table = np.zeros((self.rows, SLOTS), np.uint16).tolist()
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.rows - 1)
        return print_, first, self._other(first, print_)

    def _other(self, row: int, print_: int) -> int:
        return row ^ ((print_ * 0x5BD1E995) & (self.rows - 1))

    def __contains__(self, digest: bytes) -> bool:
        print_, a, b = self._places(digest)
        return print_ in self.table[a] or print_ in self.table[b]

    def insert(self, digest: bytes) -> bool:
        """False when no slot could be freed; the caller then rebuilds from its keys."""
        print_, a, b = self._places(digest)
        for row in (a, b):
            if 0 in self.table[row]:
                self.table[row][self.table[row].index(0)] = print_
                self.size += 1
                return True
        row = b
        for kick in range(KICKS):
            slot = (kick * 7 + print_) % SLOTS
            print_, self.table[row][slot] = self.table[row][slot], print_
            row = self._other(row, print_)
            if 0 in self.table[row]:
                self.table[row][self.table[row].index(0)] = print_
                self.size += 1
                return True
        return False

    def delete(self, digest: bytes) -> None:
        print_, a, b = self._places(digest)
        for row in (a, b):
            if print_ in self.table[row]:
                self.table[row][self.table[row].index(print_)] = 0
                self.size -= 1
                return


class Bucket:
    """Live keys of one bucket and the filter over them."""

    def __init__(self) -> None:
        self.keys: dict[bytes, list[int]] = {}
        self.filter = CuckooFilter()
        self.resizes = 0

    def find(self, digest: bytes) -> list[int] | None:
        """A filter hit counts only when the stored key confirms it."""
        return self.keys.get(digest) if digest in self.filter else None

    def add(self, digest: bytes, doc: int, rows: int) -> None:
        held = self.find(digest)
        if held is not None:
            held[0], held[1] = min(held[0], doc), held[1] + rows
            return
        self.keys[digest] = [doc, rows]
        if not self.filter.insert(digest):
            self._grow()

    def remove(self, digest: bytes, rows: int) -> None:
        held = self.find(digest)
        if held is None:
            return
        held[1] -= rows
        if held[1] <= 0:
            del self.keys[digest]
            self.filter.delete(digest)

    def _grow(self) -> None:
        size = self.filter.rows * SLOTS
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(key) for key in self.keys):
                return


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest_of(F.col("text")).alias("digest"))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One change per text of a batch (smallest id, rows), so that copies are thinned out before they travel."""
    for batch in batches:
        doc = pc.fill_null(batch.column("doc_id"), NEVER)
        table = pa.table({"digest": batch.column("digest"), "doc": doc})
        found = table.group_by("digest").aggregate([("doc", "min"), ("doc", "count")])
        yield from found.select(["digest", "doc_min", "doc_count"]).rename_columns(["digest", "doc", "rows"]).to_batches()


def _changes(rows: DataFrame, sign: int, buckets: int) -> DataFrame:
    change = rows.select("doc_id", "digest").mapInArrow(_combine, "digest binary, doc bigint, rows bigint")
    return change.select(_bucket(buckets), "digest", "doc", (F.col("rows") * sign).alias("rows"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("int"), F.lit(buckets)).cast("int").alias("bucket")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: apply the changes of one bucket to its keys, hand them out, go on."""
    schema = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    bucket, current = Bucket(), None

    def out() -> pa.RecordBatch:
        keys = list(bucket.keys)
        return pa.record_batch([
            pa.array([current] * len(keys), pa.int32()), pa.array(keys, pa.binary()),
            pa.array([bucket.keys[k][0] for k in keys], pa.int64()), pa.array([bucket.keys[k][1] for k in keys], pa.int64()),
        ], schema=schema)

    for batch in batches:
        for at, digest, doc, rows in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != current:
                if current is not None:
                    yield out()
                bucket, current = Bucket(), at
            if rows > 0:
                bucket.add(digest, doc, rows)
            else:
                bucket.remove(digest, -rows)
    if current is not None:
        yield out()


def build(rows: DataFrame, buckets: int, base: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """Index after inserting ``rows`` into ``base`` and deleting ``gone`` (all of (doc_id, digest)).

    A deletion lowers a text's count and drops the key when no row is left; the keeper stays named until then.
    """
    changes = _changes(rows, 1, buckets)
    if base is not None:
        changes = changes.unionByName(base.select(_bucket(buckets), "digest", F.col("keep_id").alias("doc"), F.col("group_size").alias("rows")))
    if gone is not None:
        changes = changes.unionByName(_changes(gone, -1, buckets))
    placed = changes.repartition("bucket").sortWithinPartitions("bucket", F.col("rows").desc())
    return placed.mapInArrow(_apply, KEYS)


def buckets_for(docs: DataFrame) -> int:
    """About 100,000 rows a bucket, and enough buckets for every task; only the row count is read."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * tasks, -(-docs.count() // 100_000))


def dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row of ``docs``.

    The digests are written to the shared folder once; index and join read that small table.
    """
    return _judged(stored(digests(docs), "digests"), buckets)


def _judged(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    index = build(rows, buckets or buckets_for(rows)).select("digest", "keep_id", "group_size")
    joined = rows.join(index, "digest")
    keep = F.when(F.col("keep_id") != NEVER, F.col("keep_id"))
    return joined.select("doc_id", "digest", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"))


def _gone(judged: DataFrame) -> DataFrame:
    return judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))


def first_of_equal(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return without(docs, digest_of(docs["text"]), _gone(dedup(docs)))


def one_of_equal(docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns: of the rows that are kept, repeated ones (same id or none) count once."""
    rows = stored(digests(docs), "digests")
    twice = stored(repeated(rows), "repeated")
    kept = without(docs, digest_of(docs["text"]), stored(_gone(_judged(rows)), "gone"))
    return one_of_repeated(kept, digest_of(kept["text"]), twice)
