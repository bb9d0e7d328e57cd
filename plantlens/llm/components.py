"""Connected components by alternating large and small stars; lineage is cut in the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b); root is the smallest node of its component.

    A hub's edges are folded by partial aggregation and joined by an equi join, so no node's neighbours are gathered.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", "m")).where("a <> b").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
