"""Exact Jaccard join of documents over word shingles, as a metric-space join.

A document's set holds the 64-bit hashes of its SHINGLE-word runs (A-Z folded, words split at ASCII white space). 1 - Jaccard is a metric, so
for a pivot p and a radius e = 1 - threshold, documents whose distances to p differ by more than e cannot be linked.

Random pivots do not divide texts that share nothing (all distances are 1), so the first regions come from shingles:
  1. Chunks of text send each shingle to a bucket, which returns how many different sets hold it.
  2. A set with more shingles of its own than a linked set may lack is alone. The others keep, in order of rarity, the shingles of
     which a partner must share one; each of these makes a region, and overlapping regions join into one.
  3. A region is joined around pivots: each pivot is compared with the sets that sizes and triangle windows allow, until all sets
     outside the largest linked group have been pivots; pairs inside one group need no test.
  4. A region too large for a task, of no more than PIVOTS blocks, is joined by pairs of bounded blocks. A larger one is first cut into Voronoi cells of
     several pivots. A set goes to its nearest pivot's cell and to every earlier cell whose pivot is at most 2 e farther, so linked sets share a cell;
     cells whose sets all link with their pivot are done, others recurse, and a cell that does not shrink is joined by pairs of blocks.
Equal sets are one node throughout. Links are closed to components; nothing but counts and pivots reaches the driver.

Defined results: null, empty or wordless text has the empty set, linked with nothing; fewer words than SHINGLE are one shingle;
a null doc_id is larger than any other (its component is null if all ids in it are null); repeated rows share a component. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components, stored
from .identity import one_of_repeated, repeated, without
from .superkmer import NEVER, ROW, ROWS, _opened, _rows, _texts, ids_of, pack, unpack
from .words import FOLDED, GRAM, Words, flat, mix, run_hash, text_of

SHINGLE = 4
THRESHOLD = 85  # percent
REGION_TOKENS = 2_000_000  # shingles of a region that one task joins
BUCKET_WORDS = 2 << 20
PIVOTS = 16
GATHER = 1 << 19  # shingles looked up at a time
SENT_BYTES = 4 << 20  # of a batch of sets that go to cells
NUMBER_BITS = 28  # of a shingle inside its bucket
DOCS = "doc_id bigint, digest binary, n_shingles bigint, key binary, members binary, prefix array<bigint>"


class Sets:
    """Shingle sets of a chunk: ``tokens[first[d]:first[d+1]]`` sorted, a 16-byte ``key``, and ``lead``, the first document of each set."""

    def __init__(self, batch: pa.RecordBatch, shingle: int):
        words = Words(*flat(text_of(batch)), FOLDED)
        counts = words.counts()
        grams = words.grams(shingle)
        whole = words.whole(shingle)
        doc = words.doc()
        token, owner = grams[whole], doc[: len(grams)][whole]
        short = np.flatnonzero((counts > 0) & (counts < shingle))
        some = run_hash(words.hash, words.first[short], words.first[short] + counts[short])
        token, owner = np.append(token, some), np.append(owner, short)
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.tokens, self.owner = token[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(batch.num_rows + 1))
        self.size = np.diff(self.first)
        keys = np.empty((batch.num_rows, 2), np.uint64)
        for i, values in enumerate((self.tokens, mix(self.tokens ^ GRAM))):
            keys[:, i] = run_hash(values, self.first[:-1], self.first[1:])
        self.key = keys
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
        self.lead = np.zeros(batch.num_rows, bool)
        self.lead[order[fresh]] = self.size[order[fresh]] > 0
        self.led = self.lead[self.owner]


def _address(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number inside it); two shingles with one address only make a count too large."""
    return (tokens >> np.uint64(33)) % np.uint64(buckets), tokens & np.uint64((1 << NUMBER_BITS) - 1)


def planes(rising: np.ndarray) -> bytes:
    """Rising numbers as the bytes of their gaps, lowest bytes first."""
    return np.diff(rising.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(body: bytes) -> np.ndarray:
    gaps = np.frombuffer(body, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32)


def _send(buckets: int, shingle: int):
    """Shingles of each chunk with the number of its sets that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _opened(batches):
            sets = Sets(batch, shingle)
            bucket, token = _address(sets.tokens[sets.led], buckets)
            both, count = np.unique(bucket << np.uint64(32) | token, return_counts=True)
            count = count.astype(np.uint32)
            cut = np.searchsorted(both >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            places = np.flatnonzero(np.diff(cut)).tolist()
            bodies = [pack(token=planes(both[a:b]), count=count[a:b]) for a, b in zip(cut[places], cut[np.array(places, int) + 1])]
            yield pa.record_batch([places, [number] * len(places), bodies], schema=ROW)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, those of its shingles in a bucket that two or more sets hold, and how many do."""
    for place, parts in _placed(batches):
        known = [unpack(b) for _, b in parts]
        tokens = [unplaned(k["token"]) for k in known]
        counts = np.concatenate([np.frombuffer(k["count"], np.uint32) for k in known])
        chunk = np.repeat(np.arange(len(parts)), [len(t) for t in tokens])
        token = np.concatenate(tokens)
        order = np.argsort(token, kind="stable")
        cut = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
        total = np.add.reduceat(counts[order].astype(np.uint64), cut)
        held = np.empty(len(token), np.uint64)
        held[order] = np.repeat(total, np.diff(np.append(cut, len(order))))
        for i, (to, _) in enumerate(parts):
            mine = slice(*np.searchsorted(chunk, [i, i + 1]))
            some = held[mine] > 1
            if some.any():
                count = np.minimum(held[mine][some], 0xFFFFFFFF).astype(np.uint32)
                body = pack(place=np.array([place]), token=planes(token[mine][some]), count=count)
                yield pa.record_batch([[to], [to], [body]], schema=ROW)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(place, its rows), rows sorted by place."""
    held, at = [], None
    for batch in batches:
        for place, chunk, body in zip(batch.column("place").to_pylist(), batch.column("chunk").to_pylist(), batch.column("body")):
            if place != at and held:
                yield at, held
                held = []
            at = place
            held.append((chunk, body.as_py()))
    if held:
        yield at, held


def needed(size: np.ndarray, threshold: int) -> np.ndarray:
    """Shingles that a set of this size must share with a linked one."""
    return (threshold * size + 99) // 100


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _choose(buckets: int, shingle: int, threshold: int, named: bool):
    """Every document with its key, and with the digest of its text if ``named``; the first of each possible set also with its shingles and its region shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, answers in zip(batch.column("body"), batch.column("answers")):
                yield one(_rows(body.as_py()), answers.as_py() or [])

    def one(batch: pa.RecordBatch, answers: list[bytes]) -> pa.RecordBatch:
        sets = Sets(batch, shingle)
        bucket, token = _address(sets.tokens, buckets)
        full = bucket << np.uint64(32) | token
        known = [unpack(a) for a in answers]
        place = [np.frombuffer(k["place"], np.uint64) << np.uint64(32) for k in known]
        name = np.concatenate([np.zeros(0, np.uint64), *(p | unplaned(k["token"]) for p, k in zip(place, known))])
        count = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(k["count"], np.uint32) for k in known)])
        order = np.argsort(name)
        name, count = name[order], count[order]
        at = np.minimum(np.searchsorted(name, full), max(0, len(name) - 1))
        held = np.where(name[at] == full, count[at], 1) if len(name) else np.ones(len(full), np.uint32)
        prefix = sets.size - needed(sets.size, threshold) + 1
        alone = np.bincount(sets.owner[held == 1], minlength=batch.num_rows)
        live = sets.lead & (alone < prefix) & (sets.size > 0)
        members, regions = [None] * batch.num_rows, [None] * batch.num_rows
        for d in np.flatnonzero(live).tolist():
            mine = slice(sets.first[d], sets.first[d + 1])
            members[d] = sets.tokens[mine].tobytes()
            rare = np.lexsort((sets.tokens[mine], held[mine]))[alone[d] : prefix[d]]
            regions[d] = sets.tokens[mine][rare].view(np.int64)
        ids, digest = ids_of(batch), [None] * batch.num_rows
        if named:
            data, at = flat(text_of(batch))
            digest = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1], at[1:])]
        return pa.record_batch(
            [
                pa.array(ids, mask=ids == NEVER), pa.array(digest, pa.binary()), pa.array(sets.size, pa.int64()), pa.array([k.tobytes() for k in sets.key], pa.binary()),
                pa.array(members, pa.binary()), pa.array(regions, pa.list_(pa.int64())),
            ],
            names=["doc_id", "digest", "n_shingles", "key", "members", "prefix"],
        )

    return run


class Region:
    """Sets of one region, as dense shingle numbers, joined around pivots."""

    def __init__(self, keys: list[bytes], members: list[bytes], threshold: int):
        self.keys, self.threshold = keys, threshold
        self.size = np.array([len(m) // 8 for m in members], np.int64)
        self.first = np.append(0, np.cumsum(self.size))
        whole = np.frombuffer(b"".join(members), np.uint64)
        names = np.unique(whole)
        self.tokens = np.empty(len(whole), np.int32)
        for low in range(0, len(whole), GATHER):
            self.tokens[low : low + GATHER] = np.searchsorted(names, whole[low : low + GATHER])
        self.mark = np.zeros(len(names), bool)
        self.root = np.arange(len(keys))

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Shingles that each of the others shares with the pivot."""
        mine = self.tokens[self.first[pivot] : self.first[pivot + 1]]
        self.mark[mine] = True
        size = self.size[others]
        ends = np.append(0, np.cumsum(size))
        both, low = np.empty(len(others), np.int64), 0
        while low < len(others):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + GATHER, "right")) - 1)
            a, b = others[low], others[high - 1]
            if b - a == high - 1 - low:  # neighbours
                hit = self.mark[self.tokens[self.first[a] : self.first[b + 1]]]
            else:
                hit = self.mark[self.tokens[np.repeat(self.first[others[low:high]] - ends[low:high], size[low:high]) + np.arange(ends[low], ends[high])]]
            sums = np.append(0, np.cumsum(hit, dtype=np.int64))
            both[low:high] = np.diff(sums[ends[low : high + 1] - ends[low]])
            low = high
        self.mark[mine] = False
        return both

    def links(self, between: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links that connect what is connected. ``between``: 0 or 1 for each set; only links from 0 to 1 are needed."""
        n, radius = len(self.keys), 1 - self.threshold / 100 + 1e-9
        waiting = np.ones(n, bool)
        seen: list[np.ndarray] = []  # distances to the first pivots
        while True:
            counts = np.bincount(self.root, minlength=n)
            largest = int(counts.argmax())
            left = np.flatnonzero(waiting & (self.root != largest)) if counts[largest] > 1 else np.flatnonzero(waiting)
            if not len(left) or counts[largest] == n:
                return
            pivot = int(left[0])
            waiting[pivot] = False
            fit = (self.root != self.root[pivot]) & (np.minimum(self.size, self.size[pivot]) * 100 >= self.threshold * np.maximum(self.size, self.size[pivot]))
            if between is not None:
                fit &= between != between[pivot]
            for far in seen:
                fit &= np.abs(far - far[pivot]) <= radius
            survey = len(seen) < 4 and between is None
            others = np.arange(n) if survey else np.flatnonzero(fit)
            both = self.shared(pivot, others)
            union = self.size[others] + self.size[pivot] - both
            if survey:
                seen.append(1 - both / union)
            linked = others[(100 * both >= self.threshold * union) & fit[others]]
            groups, place = np.unique(self.root[linked], return_index=True)
            if len(groups):
                self.root[np.isin(self.root, groups)] = self.root[pivot]
            yield from ((pivot, other) for other in linked[place].tolist())


def _join(threshold: int):
    """Links of whole regions; rows sorted by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = ([], [], []), None
        for batch in batches:
            for region, key, members, side in zip(*(batch.column(c).to_pylist() for c in ("region", "key", "members", "side"))):
                if region != at and held[0]:
                    yield out(*held)
                    held = ([], [], [])
                at = region
                for column, value in zip(held, (key, members, side)):
                    column.append(value)
        if held[0]:
            yield out(*held)

    def out(keys: list, members: list, sides: list) -> pa.RecordBatch:
        between = None if sides[0] is None else np.array(sides)
        found = list(Region(keys, members, threshold).links(between)) if len(keys) > 1 else []
        return pa.record_batch([pa.array([keys[i] for i, _ in found], pa.binary()), pa.array([keys[j] for _, j in found], pa.binary())], names=["a", "b"])

    return run


def _cells(pivots, threshold: int):
    """Distances of sets to the pivots of their region: cells to visit, and links with pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {r: [(k, np.frombuffer(m, np.uint64)) for k, m in v] for r, v in pivots.value.items()}
        radius = 1 - threshold / 100
        for batch in batches:
            rows, held = [], 0
            for region, key, whole in zip(batch.column("region").to_pylist(), batch.column("key").to_pylist(), batch.column("members")):
                members = whole.as_py()
                mine = np.frombuffer(members, np.uint64)
                both = [len(np.intersect1d(mine, p, assume_unique=True)) for _, p in known[region]]
                union = [len(mine) + len(p) - b for (_, p), b in zip(known[region], both)]
                far = [1 - b / u for b, u in zip(both, union)]
                home = int(np.argmin(far))
                for i, d in enumerate(far[: home + 1]):
                    if d - far[home] <= 2 * radius + 1e-9:
                        rows.append((f"{region}.{i}", key, members, known[region][i][0], 100 * both[i] >= threshold * union[i]))
                        held += len(members)
                if held >= SENT_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    def out(rows: list) -> pa.RecordBatch:
        names = ["region", "key", "members", "pivot", "linked"]
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def region_links(regions: DataFrame, sizes: DataFrame, threshold: int, most: int = REGION_TOKENS, parent: int | None = None) -> DataFrame:
    """Links (a, b) of the rows (region, key, members). ``sizes``: tokens and sets of each region; ``parent``: sets in the regions
    that these were cut from."""
    crowded = sizes.where(F.col("tokens") > most).select("region", "tokens", "sets").collect()  # at most all shingles / most
    none = F.lit(None).cast("int")
    if not crowded:
        return _solve(regions.withColumn("side", none), threshold)
    names = [r.region for r in crowded]
    found = _solve(regions.where(~F.col("region").isin(names)).withColumn("side", none), threshold)
    crowd = stored(regions.where(F.col("region").isin(names)), "crowded")
    blocks = {r.region: int(-(-r.tokens * 2 // most)) for r in crowded}  # a block holds half of what a task joins
    fresh = [r for r in crowded if blocks[r.region] > PIVOTS and (parent is None or r.sets < 0.7 * parent)]
    paired = [(n, blocks[n]) for n in names if n not in {r.region for r in fresh}]
    if paired:  # every pair of blocks of one region
        many = F.broadcast(regions.sparkSession.createDataFrame(paired, "region string, blocks int"))
        mine = crowd.join(many, "region").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, "block").alias("i"), F.greatest(j, "block").alias("j")))
        met = mine.withColumn("p", F.explode(pairs)).withColumn("region", F.concat_ws(".", "region", "p.i", "p.j"))
        side = F.when(F.col("p.i") != F.col("p.j"), (F.col("block") == F.col("p.j")).cast("int"))
        found = found.unionByName(_solve(met.withColumn("side", side), threshold))
    if not fresh:
        return found
    mine = crowd.where(F.col("region").isin([r.region for r in fresh]))
    place = Window.partitionBy("region").orderBy(F.xxhash64("key"))
    some = mine.select("region", "key").withColumn("n", F.row_number().over(place)).where(F.col("n") <= PIVOTS)
    pivots: dict[str, list] = {}
    for r in some.join(mine, ["region", "key"]).select("region", "key", "members").collect():
        pivots.setdefault(r.region, []).append((bytes(r.key), bytes(r.members)))
    sent = regions.sparkSession.sparkContext.broadcast(pivots)
    schema = "region string, key binary, members binary, pivot binary, linked boolean"
    cells = stored(mine.select("region", "key", "members").mapInArrow(_cells(sent, threshold), schema), "cells")
    found = found.unionByName(cells.where("linked AND key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
    tokens = F.sum((F.octet_length("members") / 8).cast("bigint"))
    rest = cells.groupBy("region").agg(F.min("linked").alias("done"), tokens.alias("tokens"), F.count(F.lit(1)).alias("sets"))
    rest = stored(rest.where("NOT done"), "open-cells")
    return found.unionByName(region_links(cells.join(rest.select("region"), "region").select("region", "key", "members"), rest, threshold, most, max(r.sets for r in fresh)))


def _solve(regions: DataFrame, threshold: int) -> DataFrame:
    rows = regions.select("region", "key", "members", "side").repartition("region").sortWithinPartitions("region", "key")
    return rows.mapInArrow(_join(threshold), "a binary, b binary")


def grouped(docs: DataFrame, shingle: int, threshold: int, most: int = REGION_TOKENS, named: bool = False) -> DataFrame:
    """doc_id, digest (of the text if ``named``), n_shingles and group of each document.

    ``docs`` should be a stored table: chunks are numbered by task and place in it.
    """
    conf = docs.sparkSession.conf
    texts = docs.select(F.struct("doc_id", "text").alias("row")).mapInArrow(_texts, ROWS).repartition("place")
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    total = docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    buckets = max(2 * int(conf.get("spark.sql.shuffle.partitions")), total // 6 // BUCKET_WORDS)
    sent = texts.mapInArrow(_send(buckets, shingle), ROWS)
    counted = sent.repartition("place").sortWithinPartitions("place").mapInArrow(_count, ROWS)
    answers = counted.groupBy("place").agg(F.collect_list("body").alias("answers"))
    met = texts.join(answers, "place", "left").select("body", "answers")
    found = stored(met.mapInArrow(_choose(buckets, shingle, threshold, named), DOCS), "sets")

    live = found.where("members IS NOT NULL")
    posted = live.select("key", F.explode("prefix").alias("token")).distinct()
    pivot = posted.groupBy("token").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = components(posted.join(pivot, "token").select(F.col("key").alias("a"), "b").distinct())
    near = stored(near.select(F.col("node").alias("key"), F.hex("root").alias("region")), "near")
    sizes = live.select("key", "n_shingles").distinct().join(near, "key").groupBy("region")
    sizes = sizes.agg(F.sum("n_shingles").alias("tokens"), F.count(F.lit(1)).alias("sets"))
    regions = live.groupBy("key").agg(F.first("members").alias("members")).join(near, "key").select("region", "key", "members")
    groups = components(region_links(regions, sizes, threshold, most))

    placed = found.select("doc_id", "digest", "n_shingles", "key").join(groups, F.col("key") == F.col("node"), "left")
    group = F.when(F.col("n_shingles") == 0, F.concat(F.lit("empty"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.hex(F.coalesce("root", "key")))
    return stored(placed.select("doc_id", "digest", "n_shingles", group.alias("group")), "grouped")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, most: int = REGION_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each document."""
    placed = grouped(docs, shingle, threshold, most)
    least = stored(placed.groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "group").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all its columns: the smallest id (null is larger than any), of equal ids the smallest digest of the text.

    Rows are named by id and text, so texts that share an id are told apart and repeated rows count once. Texts without words stay.
    """
    placed = grouped(docs, shingle, threshold, named=True).where("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    lead = stored(placed.groupBy("group").agg(F.min(first).alias("lead")), "leads")
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("digest") == F.col("lead.digest"))
    gone = placed.join(lead, "group").where(~leads).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    twice = stored(repeated(placed.select("doc_id", "digest")), "repeated")
    kept = without(docs, digest_of(docs["text"]), stored(gone, "gone"))
    return one_of_repeated(kept, digest_of(kept["text"]), twice)
