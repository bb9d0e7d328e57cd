"""Exact vector search without index files and without materialising all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, small
from .ordered import topk

QUERY_BLOCK = 4096  # queries in one unit
ROW_BLOCK = 8192  # rows in one unit
CELL = 8192  # rows for which there is one pivot
UNIT = 8192  # rows of a block that meets another one
BAND = 512  # rows of one product inside it
TASK = 32768  # rows of similarity units in one stored partition


def unit_vectors(df: DataFrame, vec: str) -> DataFrame:
    """L2-normalised vectors; rows with a zero, missing or non-finite vector are dropped (see ``bad_vectors``)."""
    norm = _norm(F.col(vec))
    return df.filter(_usable(F.col(vec))).withColumn(
        vec, F.transform(F.col(vec).cast("array<double>"), lambda x: x / norm)
    )


def bad_vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.filter(~F.coalesce(_usable(F.col(vec)), F.lit(False)))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _usable(v: Column) -> Column:
    n = _norm(v)
    return (n > 0) & ~F.isnan(n) & (n < float("inf"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score, id), larger ids first among equal scores."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    order = np.lexsort((ids[near], scores[near]))[::-1][:k]
    return near[order]


def grid(
    asked: DataFrame, rows: DataFrame, ask_key: list[str], row_key: list[str], row_block: int = ROW_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to the units (part, i, j) of a grid: at most about QUERY_BLOCK rows of ``asked`` meet ``row_block`` of ``rows`` in one.

    Each row goes to every unit of its line or column; a part that one side lacks has no unit.
    """
    many = lambda df, size, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = small(cut_lineage(many(asked, QUERY_BLOCK, "n_i").join(many(rows, row_block, "n_j"), "part")))  # one row a part, and a part may hold most rows

    def deal(df: DataFrame, key: list[str], own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*key), F.col(own_n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other)
        return df.join(sizes, "part").select("*", mine, every).drop("n_i", "n_j")

    return deal(asked, ask_key, "i", "n_i", "j", "n_j"), deal(rows, row_key, "j", "n_j", "i", "n_i")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def in_units(asked: DataFrame, rows: DataFrame, unit, schema: str) -> DataFrame:
    keys = ["part", "i", "j"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(unit, schema)


def vector_topk(
    queries: DataFrame, qid: str, qvec: str, vectors: DataFrame, id: str, vec: str, k: int, part: str | None = None
) -> DataFrame:
    """Best k rows per query by inner product (cosine for unit vectors), in (qid, id, score, rank).

    Queries and rows meet in the units of a grid, one matrix product each, which hand on their k best rows per query. Among equal scores at the
    cut the larger id survives; the output is ordered by score, then id. With ``part`` a query only sees rows of its own part.
    """
    own = lambda: (F.col(part) if part else F.lit("")).cast("string").alias("part")
    asked = queries.select(own(), F.col(qid).alias("qid"), F.col(qvec).cast("array<double>").alias("qvec"))
    rows = vectors.select(own(), F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    id_type, qid_type = rows.schema["id"].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        at, which, values = [], [], []
        if left.num_rows and right.num_rows:
            ids = right["id"].to_numpy()
            scores = np.round(_matrix(left["qvec"]) @ _matrix(right["vec"]).T, 6) + 0.0
            for q, row in enumerate(scores):
                best = _best(row, ids, k)
                at.append(np.full(len(best), q))
                which.append(best)
                values.append(row[best])
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({
            "qid": left["qid"].take(pa.array(flat(at, np.int64))), "id": right["id"].take(pa.array(flat(which, np.int64))), "score": pa.array(flat(values, float))})

    found = in_units(*grid(asked, rows, ["qid"], ["id"]), unit, f"qid {qid_type}, id {id_type}, score double")
    kept = topk(found, ["qid"], [F.col("score").desc(), F.col("id").desc()], k, "__r").drop("__r")
    return topk(kept, ["qid"], [F.col("score").desc(), F.col("id").asc()], k)


def similar_topk(df: DataFrame, id: str, vec: str, threshold: float, per_row: int) -> DataFrame:
    """For each row the ``per_row`` most similar other rows with cosine at or above the threshold, exactly.

    Rows are assigned to the nearest of a few pivots, and the rows of a cell are packed into blocks of at most about UNIT rows, one record each.
    Blocks meet in pairs unless the triangle inequality rules out a partner (the distance of their pivots less both radii). No row is copied to other
    cells: a task reads the blocks of one stored partition against those of another and keeps ``per_row`` partners a row, so
    memory is bounded and only time and what is handed on grow with the pairs.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    id_type = rows.schema["id"].dataType.simpleString()
    n = rows.count()
    wanted = max(1, min(n // CELL, math.isqrt(n)))  # grows with the rows; a broadcast of at most sqrt(n) vectors
    pivots = np.stack([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()])
    pivots = spark.sparkContext.broadcast(np.unique(pivots, axis=0))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def assign(batches):
        centres = pivots.value
        for batch in batches:
            for low in range(0, batch.num_rows, BAND):
                part = batch.slice(low, BAND)
                x = _matrix(pa.chunked_array([part.column("vec")]))
                far = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
                yield pa.record_batch([pa.array(far.argmin(1), pa.int32()), part.column("id"), part.column("vec")], names=["cell", "id", "vec"])

    def packed(group: pa.Table) -> pa.Table:
        cell, x = group["cell"][0].as_py(), _matrix(group["vec"])
        centre = pivots.value[cell]
        reach = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        ids = group["id"].combine_chunks()
        return pa.table({
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "rows": pa.array([x.tobytes()], pa.binary()),
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "reach": pa.array([reach])})

    placed = cut_lineage(rows.mapInArrow(assign, f"cell int, id {id_type}, vec array<double>"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("n"))
    units = placed.join(small(sizes), "cell").withColumn("unit", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    cores = spark.sparkContext.defaultParallelism
    tasks = max(math.ceil(n / TASK), math.isqrt(cores) + 1)  # partitions of a side; they grow in number with the rows, not in size
    blocks = units.groupBy("cell", "unit").applyInArrow(packed, f"ids array<{id_type}>, rows binary, centre array<double>, reach double")
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()).repartition(tasks, "block"))
    own = blocks.select(*[F.col(c).alias(f"own_{c}") for c in blocks.columns])
    apart = F.sqrt(F.aggregate(F.zip_with("own_centre", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    met = own.hint("shuffle_replicate_nl").join(blocks.hint("shuffle_replicate_nl"), apart <= F.col("own_reach") + F.col("reach") + radius + 1e-9)
    met = met.select("own_block", "own_ids", "own_rows", "ids", "rows")

    def best(batches):
        at = held = None
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("own_block")[i].as_py()
                if block != at:
                    if held is not None:
                        yield from held.found()
                    at, held = block, _Nearest(batch, i, threshold, per_row)
                held.meet(batch, i)
        if held is not None:
            yield from held.found()

    pairs = met.mapInArrow(best, f"id {id_type}, other {id_type}, score double")
    return topk(pairs, ["id"], [F.col("score").desc(), F.col("other").asc()], per_row)


class _Nearest:
    """The best partners so far of the rows of one block, which meets other blocks one at a time."""

    def __init__(self, batch: pa.RecordBatch, i: int, threshold: float, per_row: int):
        self.ids = batch.column("own_ids")[i].values
        self.rows = np.frombuffer(batch.column("own_rows")[i].as_py()).reshape(len(self.ids), -1)
        self.threshold, self.per_row = threshold, per_row
        self.bound = np.full(len(self.ids), threshold)  # scores below it do not count any more
        self.row, self.score, self.other = np.zeros(0, np.int64), np.zeros(0), self.ids.slice(0, 0)

    def meet(self, batch: pa.RecordBatch, i: int) -> None:
        others = batch.column("ids")[i].values
        right = np.frombuffer(batch.column("rows")[i].as_py()).reshape(len(others), -1).T
        for low in range(0, len(self.ids), BAND):
            sims = self.rows[low : low + BAND] @ right
            r, c = np.nonzero(sims >= self.bound[low : low + BAND, None] - 1e-6)
            if not len(r):
                continue
            score, other = np.round(sims[r, c], 6), others.take(pa.array(c))
            some = (score >= self.threshold) & ~pc.fill_null(pc.equal(other, self.ids.take(pa.array(r + low))), False).to_numpy(zero_copy_only=False)
            if some.any():
                self._keep(low, r[some] + low, score[some], other.filter(pa.array(some)))

    def _keep(self, low: int, row: np.ndarray, score: np.ndarray, other: pa.Array) -> None:
        band = (self.row >= low) & (self.row < low + BAND)
        row, score = np.append(self.row[band], row), np.append(self.score[band], score)
        other = pa.concat_arrays([self.other.filter(pa.array(band)), other])
        rank = pc.rank(other, tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, -score, row))
        first = np.searchsorted(row[order], row[order])
        kept = np.arange(len(order)) - first < self.per_row
        last = order[np.arange(len(order)) - first == self.per_row - 1]
        self.bound[row[last]] = score[last]
        order = order[kept]
        self.row, self.score = np.append(self.row[~band], row[order]), np.append(self.score[~band], score[order])
        self.other = pa.concat_arrays([self.other.filter(pa.array(~band)), other.take(pa.array(order))])

    def found(self):
        yield pa.record_batch([self.ids.take(pa.array(self.row)), self.other, pa.array(self.score)], names=["id", "other", "score"])


def maxsim(queries: DataFrame, qid: str, token: str, qvec: str, patches: DataFrame, page: str, vec: str) -> DataFrame:
    """Late interaction: per page the best patch of every query token, summed over the tokens.

    Tokens and patches meet in the units of a grid; each reduces its patches to one maximum per (query token, page), so no pair of token and
    patch is stored.
    """
    asked = queries.select(F.lit("").alias("part"), F.col(qid).alias("qid"), F.col(token).alias("token"), F.col(qvec).cast("array<double>").alias("v"))
    rows = patches.select(F.lit("").alias("part"), F.col(page).alias("page"), F.col(vec).cast("array<double>").alias("vec"))
    kind = lambda df, name: f"{name} {df.schema[name].dataType.simpleString()}"

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pc.sort_indices(right["page"])
        right = right.take(order)
        page_of = right["page"].combine_chunks()
        codes = page_of.dictionary_encode().indices.to_numpy() if right.num_rows else np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        n, pages = left.num_rows, len(first)
        best = np.zeros((n, 0))
        if n and pages:
            best = np.maximum.reduceat(_matrix(left["v"]) @ _matrix(right["vec"]).T, first, axis=1)
        tokens = pa.array(np.repeat(np.arange(n), best.shape[1]))
        return pa.table({
            "qid": left["qid"].take(tokens), "token": left["token"].take(tokens), "page": page_of.take(pa.array(np.tile(first, n if pages else 0))), "best": best.ravel()})

    schema = f"{kind(asked, 'qid')}, {kind(asked, 'token')}, {kind(rows, 'page')}, best double"
    found = in_units(*grid(asked, rows, ["qid", "token"], ["page", "vec"]), unit, schema)
    best = found.groupBy("qid", "token", "page").agg(F.max("best").alias("best"))
    return best.groupBy("qid", "page").agg(F.round(F.sum("best"), 6).alias("score"))
