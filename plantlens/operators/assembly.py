"""Corpus assembly: pages, counters, fingerprints, merged source lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import first_per_key


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """One row per page: body lines in order, distinct titles by first mention, number of tables.

    ``blocks``: doc, page, position, text, title, kind. A page is the unit of the result, so its blocks meet in one row.
    """
    body = F.array_sort(F.collect_list(F.when(F.col("kind") != "tables", F.struct("position", "text"))))
    lines = blocks.groupBy("doc", "page").agg(body.alias("__b"), F.count_if(F.col("kind") == "tables").alias("n_tables"))
    titles = (
        blocks.filter(F.coalesce("title", F.lit("")) != "")
        .groupBy("doc", "page", "title")
        .agg(F.min("position").alias("p"))
        .groupBy("doc", "page")
        .agg(F.array_sort(F.collect_list(F.struct("p", "title"))).alias("__t"))
    )
    return lines.join(titles, ["doc", "page"], "left").select(
        "doc",
        "page",
        F.array_join(F.transform("__b", lambda b: b.text), "\n").alias("body"),
        "n_tables",
        F.coalesce(F.transform("__t", lambda x: x.title), F.array().cast("array<string>")).alias("titles"),
    )


def import_counters(chunks: DataFrame) -> DataFrame:
    """Per machine: pages, chunks, empty chunks, repeated ids."""
    return chunks.groupBy("machine").agg(
        F.count_distinct("page").alias("pages"),
        F.count("*").alias("chunks"),
        F.count_if(F.trim("text") == "").alias("empty_chunks"),
        (F.count("*") - F.count_distinct("id")).alias("repeated"),
    )


def row_text(columns: Sequence[str]) -> Column:
    """The values as one text that tells every row apart: each with its length before it, null as a dash."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fingerprint(df: DataFrame, order: str, columns: Sequence[str], width: int = 1024) -> DataFrame:
    """Hash of an ordered corpus as a tree: rows, blocks of ``width`` ids, blocks of blocks, until one block is left.

    The smallest and the largest id tell how many levels that takes, so no task holds more than one block of hashes however large the corpus
    is. A null id counts as -1; an empty corpus has the hash of nothing.
    """
    row = F.sha2(row_text(columns), 256)
    level = df.select(F.coalesce(F.col(order).cast("bigint"), F.lit(-1).cast("bigint")).alias("at"), row.alias("h"))
    low, high, total = level.agg(F.min("at"), F.max("at"), F.count("*")).first()
    if low is None:
        return df.sparkSession.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("fingerprint"), F.lit(0).cast("bigint").alias("n"))
    shift = min(low, 0)  # places are counted from 0, or from a negative smallest id
    level, low, high = level.withColumn("at", F.col("at") - shift), low - shift, high - shift
    levels = 1
    while low // width**levels != high // width**levels:
        levels += 1
    for _ in range(levels):
        block = F.floor(F.col("at") / width).cast("bigint").alias("b")
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda e: e.h)
        level = level.groupBy(block).agg(F.sha2(F.array_join(hashes, ""), 256).alias("h")).withColumnRenamed("b", "at")
    return level.select(F.col("h").alias("fingerprint"), F.lit(total).cast("bigint").alias("n"))


def merge_sources(df: DataFrame, source: str, position: str) -> DataFrame:
    """Distinct sources by canonical JSON, each at its first position."""
    keyed = df.withColumn("__k", F.to_json(source))
    return first_per_key(keyed, ["__k"], [F.col(position)]).drop("__k")
