"""Rows named by (doc_id, digest of the text), for stages that keep one row of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def _same(docs: DataFrame, digest: Column, keys: DataFrame) -> Column:
    return (digest == keys["_digest"]) & docs["doc_id"].cast("bigint").eqNullSafe(keys["_id"])


def repeated(rows: DataFrame) -> DataFrame:
    """Keys (_id, _digest) that several of the rows (doc_id, digest) have."""
    counts = rows.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").select("_id", "_digest")


def without(docs: DataFrame, digest: Column, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows that the keys name.

    One plan at every size: both sides are dealt by the key, the names become the hash table and the texts stream past it unsorted.
    """
    return docs.join(keys.hint("shuffle_hash"), _same(docs, digest, keys), "left_anti")


def one_of_repeated(docs: DataFrame, digest: Column, keys: DataFrame) -> DataFrame:
    """``docs`` with one row of each of the keys, the one whose columns come first as JSON; the other rows stay.

    Each task combines its rows of a key before they travel.
    """
    if keys.isEmpty():
        return docs
    whole = F.struct(*(docs[f"`{name}`"] for name in docs.columns))
    tied = docs.join(keys.hint("shuffle_hash"), _same(docs, digest, keys)).select(whole.alias("row"), keys["_id"], keys["_digest"])
    best = tied.groupBy("_id", "_digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return without(docs, digest, keys).unionByName(best)
