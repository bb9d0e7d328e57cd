"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts lie together. A size-weighted sample of keys gives quantile borders of
many ranges; a border falls between texts unless one text alone fills several ranges, which is then cut by doc_id. Ranges that
still hold more than OVERFULL times their share are subdivided by a hash of the record. Exact byte counts of the ranges place each one in
the global order, a window inside a range places its records, and a record's shard is the sixteenth (or whichever part) of all bytes
in which the middle of its copies lies; texts whose copies are larger than a 64th of a shard are placed record by record. Texts themselves never travel
to be placed: only id, size, check sum and hash do.

Defined results: null text has size 1 and the check sum of nothing; a null doc_id comes first among equal texts; repeated records are
placed one after another; an empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .components import stored

SHARDS = 16
SAMPLE = 64  # expected samples a range
OVERFULL = 3
FINE = 64


def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
    )


def splitters(sample: list[tuple[int, int]], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of (key, doc_id); a key that is one quantile only loses its doc_id, so its records stay together."""
    sample = sorted(sample)
    picked = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    keys = [k for k, _ in picked]
    low = np.iinfo(np.int64).min
    first = [d if k in (a, b) else low for (k, d), a, b in zip(picked, [None, *keys], [*keys[1:], None])]
    return np.array(keys, np.int64), np.array(first, np.int64)


def _range_of(keys: np.ndarray, firsts: np.ndarray, parts: dict[int, int] | None):
    def run(frames):
        for frame in frames:
            key, doc = frame["key"].to_numpy(np.int64), frame["doc"].to_numpy(np.int64)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            place = low.copy()
            for k in np.unique(key[high > low]):  # at most all splitters
                mine, span = key == k, slice(np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right"))
                place[mine] = span.start + np.searchsorted(firsts[span], doc[mine], "right")
            part = np.zeros(len(frame), np.int64)
            if parts:
                count = np.array([parts.get(p, 1) for p in place.tolist()], np.int64)
                part = (frame["salt"].to_numpy(np.int64) & 0x7FFFFFFF) % count
            yield frame.drop(columns=["doc", "salt"]).assign(range=place.astype(np.int64), part=part)

    return run


def place(docs: DataFrame, shards: int = SHARDS, seed: int = 29) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0) of each record."""
    spark = docs.sparkSession
    keys = stored(_keys(docs), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 1
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * shards)
    low = F.lit(np.iinfo(np.int64).min)
    drawn = (F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    sample = keys.where(-F.log(drawn) / F.col("size") < ranges * SAMPLE / total).select("key", F.coalesce("doc_id", low).alias("doc"))
    borders = splitters([tuple(r) for r in sample.collect()], ranges)  # about SAMPLE rows a range

    def cut(parts: dict[int, int] | None) -> DataFrame:
        salted = keys.withColumn("doc", F.coalesce("doc_id", low)).withColumn("salt", F.xxhash64("key", "doc_id", F.lit(seed + 1)))
        schema = "doc_id bigint, size bigint, text_crc32 bigint, key bigint, range bigint, part bigint"
        nullable = salted.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", low))
        found = nullable.mapInPandas(_range_of(*borders, parts), schema.replace("key bigint", "key bigint, known boolean"))
        return found.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")

    def totals(cuts: DataFrame) -> pd.DataFrame:
        found = cuts.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # one row a range
        return pd.DataFrame([tuple(r) for r in found], columns=["range", "part", "bytes", "n"]).sort_values(["range", "part"])

    cuts = cut(None)
    held = totals(cuts)
    crowded = held[held["bytes"] > OVERFULL * total / ranges]
    if len(crowded):
        cuts = cut({int(r): int(-(-b * ranges // total)) for r, b in zip(crowded["range"], crowded["bytes"])})
        held = totals(cuts)
    if held.empty:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    before = held.assign(bytes_before=held["bytes"].cumsum() - held["bytes"], rows_before=held["n"].cumsum() - held["n"])
    before = spark.createDataFrame(before[["range", "part", "bytes_before", "rows_before"]])
    order = Window.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32", "size")
    rows = cuts.join(F.broadcast(before), ["range", "part"])
    rows = rows.withColumn("at", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.withColumn("row", F.col("rows_before") + F.row_number().over(order) - 1)
    same = Window.partitionBy("range", "part", "key")
    whole = F.sum("size").over(same)
    middle = F.when(whole * shards * FINE <= total, F.min("at").over(same) + whole / 2).otherwise(F.col("at") + F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int")
    rows = stored(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"), "placed")
    first = rows.groupBy("shard").agg(F.min("row").alias("first"))
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The records as Parquet folders, one for each shard, several files in each, in slot order inside a file.

    Records are matched to their places by doc_id, which must be unique here.
    """
    found = docs.join(place(docs, shards).select("doc_id", "shard", "slot"), "doc_id")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
