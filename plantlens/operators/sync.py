"""Keeping stored corpora in step with their inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .assembly import row_text


def _hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def sync_plan(desired: DataFrame, stored: DataFrame, key: str, text: str, metadata: Sequence[str]) -> DataFrame:
    """What to do with every id: new, text (embed again), metadata (update only), stale (delete), unchanged."""
    side = lambda df, p: df.select(key, F.lit(True).alias(p), F.sha2(text, 256).alias(f"{p}t"), _hash(metadata).alias(f"{p}m"))
    both = side(desired, "d").join(side(stored, "s"), key, "full_outer")
    action = (
        F.when(F.col("s").isNull(), "new")
        .when(F.col("d").isNull(), "stale")
        .when(~F.col("dt").eqNullSafe(F.col("st")), "text")
        .when(F.col("dm") != F.col("sm"), "metadata")
        .otherwise("unchanged")
    )
    return both.select(key, action.alias("action"))


def reuse_vectors(desired: DataFrame, stored: DataFrame, key: str, passage: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Stored vectors of rows whose passage is unchanged, and the rows that still need one."""
    want = desired.withColumn("__h", F.sha2(passage, 256))
    have = stored.select(key, F.sha2(passage, 256).alias("__h"), vec)
    kept = want.join(have, [key, "__h"]).drop("__h")
    missing = want.join(have, [key, "__h"], "left_anti").drop("__h")
    return kept, missing


def revisions(df: DataFrame, doc: str, columns: Sequence[str]) -> DataFrame:
    """Order-free revision per document: row count and the sum of 60-bit row hashes. Both combine on the map side,
    so a document with very many rows costs no more than any other."""
    digest = F.conv(F.substring(F.md5(row_text(columns)), 1, 15), 16, 10)
    return df.groupBy(doc).agg(
        F.concat_ws("-", F.count("*").cast("string"), F.sum(digest.cast("decimal(20,0)")).cast("string")).alias("revision")
    )


def changed_documents(current: DataFrame, markers: DataFrame, doc: str) -> DataFrame:
    """Documents whose revision differs from the stored marker."""
    return current.join(markers.select(doc, "revision"), [doc, "revision"], "left_anti")


def merge_corpus(old: DataFrame, new: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Union of two corpora and the reasons not to accept it: shared ids, differing vector widths or models.

    Both need a ``model`` column.
    """
    merged = old.unionByName(new)
    shared = old.select(key).intersect(new.select(key)).select(F.col(key).cast("string").alias("item"), F.lit("shared id").alias("problem"))
    traits = merged.select(F.size(vec).alias("width"), "model").distinct()
    whole = traits.agg(F.count_distinct("width").alias("w"), F.count_distinct("model").alias("m"))
    wrong = whole.select(F.explode(F.array_compact(F.array(
        F.when(F.col("w") > 1, F.struct(F.lit("width").alias("item"), F.lit("differs").alias("problem"))),
        F.when(F.col("m") > 1, F.struct(F.lit("model").alias("item"), F.lit("differs").alias("problem"))),
    ))).alias("x")).select("x.*")
    return merged, shared.unionByName(wrong)


def lost_rows(old: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of the old corpus that are not in the merged one unchanged."""
    return old.exceptAll(merged.select(*old.columns))


def orphans(files: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Stored outputs the catalog no longer names."""
    return files.join(catalog.select(key).distinct(), key, "left_anti")


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in both corpora; must be empty before a merge."""
    return a.select(key).intersect(b.select(key))
