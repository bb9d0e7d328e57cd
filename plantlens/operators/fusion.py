"""Combining rankings: reciprocal ranks, duplicate removal, pools and bonuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_key
from ..session import cut_lineage, small
from . import lexical, vectors
from .ordered import first_per_key, topk

RRF_K = 60  # fixed value


def candidate_depth(k: int) -> int:
    return max(4 * k, 20)


def rrf(rankings: dict[str, DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) per (qid, id); each ranking's own rank stays visible."""
    tall = None
    for name, df in rankings.items():
        one = df.select("qid", "id", F.col("rank").alias("r"), F.lit(name).alias("src"))
        tall = one if tall is None else tall.unionByName(one)
    ranks = [F.max(F.when(F.col("src") == name, F.col("r"))).alias(f"{name}_rank") for name in rankings]
    return tall.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("r"))), 9).alias("rrf_score"), *ranks)


def best_first(score: str = "rrf_score") -> list[Column]:
    return [F.col(score).desc(), F.col("id").asc()]


def dedup_content(hits: DataFrame, text: str, order: Sequence[Column], keys: Sequence[str] = ("qid",)) -> DataFrame:
    """The best hit per normalised content."""
    keyed = hits.withColumn("__k", F.sha2(content_key(F.col(text)), 256))
    return first_per_key(keyed, [*keys, "__k"], order).drop("__k")


def hybrid(
    queries: DataFrame, docs: DataFrame, vecs: DataFrame, k: int, part: str, group: str | None = None
) -> DataFrame:
    """BM25 and cosine candidates of max(4k, 20) each, fused, one hit per content, best k.

    ``queries``: qid, qtext, qvec, part column; ``docs``: id, text, part column; ``vecs``: id, vec, part column.
    With ``group`` (a column of docs and vecs) the whole search runs per group value.
    """
    depth = candidate_depth(k)
    keys = ["qid"]
    if group:
        # a group is searched like a machine of its own: (part, group) becomes the part
        groups = docs.select(part, group).distinct()
        joined = lambda df: df.withColumn("__part", F.concat_ws("\x01", F.col(part).cast("string"), F.col(group).cast("string")))
        queries = joined(queries.join(groups, part)).withColumn("qid", F.struct("qid", F.col(group).alias("grp")))
        docs, vecs, part = joined(docs), joined(vecs), "__part"
    lex = lexical.bm25_topk(queries, "qid", "qtext", docs, "id", "text", part, depth)
    near = vectors.vector_topk(queries, "qid", "qvec", vecs, "id", "vec", depth, part) if not group else _near_by_group(
        queries, vecs, depth, part
    )
    fused = rrf({"vector": near.select("qid", "id", "rank"), "bm25": lex.select("qid", "id", F.col("bm25_rank").alias("rank"))})
    hits = docs.select("id", "text").join(small(cut_lineage(fused)), "id")
    return topk(dedup_content(hits, "text", best_first(), keys), keys, best_first(), k)


def scoped_hybrid(queries: DataFrame, docs: DataFrame, vecs: DataFrame, scope: DataFrame, k: int, part: str, file: str = "doc") -> DataFrame:
    """Hybrid search in which a query sees only the files it is routed to; (qid, id, rrf_score, rank, fallback).

    ``queries``: qid, qtext, qvec, part column; ``docs``: id, text, file and part columns; ``vecs``: id, vec, file and part columns; ``scope``: qid and
    the ``file`` values allowed, none or null for a query that names no manual. The set of files inside a machine is a part of its own, so both rankers read only
    its rows and BM25 takes its statistics; queries with the same set share it. Where the files of a machine hold no vector, the query falls back to the whole machine.
    """
    files = scope.filter(F.col(file).isNotNull()).groupBy("qid").agg(F.array_sort(F.collect_set(file)).alias("__files"))
    routed = queries.join(files, "qid", "left")
    key = F.when(F.col("__files").isNotNull(), F.to_json(F.struct(F.col(part).alias("p"), "__files")))
    routed = cut_lineage(routed.withColumn("__key", key))
    sets = routed.filter("__key IS NOT NULL").select(part, "__key", F.explode("__files").alias(file)).distinct()
    live = vecs.select(part, file).distinct().join(sets, [part, file]).select("__key").distinct().withColumn("__live", F.lit(True))
    asked = routed.join(live, "__key", "left")
    inside = F.coalesce("__live", F.lit(False))
    asked = asked.select(
        "qid", "qtext", "qvec", part, F.when(inside, F.col("__key")).otherwise(F.to_json(F.struct(F.col(part).alias("p")))).alias("__scope"),
        (F.col("__key").isNotNull() & ~inside).alias("fallback"))
    asked = cut_lineage(asked)
    whole = asked.select(part, "__scope").distinct().join(sets.select(F.col("__key").alias("__scope")).distinct(), "__scope", "left_anti")
    held = sets.withColumnRenamed("__key", "__scope").join(asked.select("__scope").distinct(), "__scope", "left_semi")

    def dealt(df: DataFrame, *columns: str) -> DataFrame:
        named = df.select("id", *columns, part, file)
        return named.join(held, [part, file]).select("id", *columns, "__scope").unionByName(named.join(whole, part).select("id", *columns, "__scope"))

    depth = candidate_depth(k)
    lex = lexical.bm25_topk(asked, "qid", "qtext", dealt(docs, "text"), "id", "text", "__scope", depth)
    near = vectors.vector_topk(asked, "qid", "qvec", dealt(vecs, "vec"), "id", "vec", depth, "__scope")
    fused = rrf({"vector": near.select("qid", "id", "rank"), "bm25": lex.select("qid", "id", F.col("bm25_rank").alias("rank"))})
    hits = docs.select("id", "text").join(small(cut_lineage(fused)), "id")
    best = topk(dedup_content(hits, "text", best_first()), ["qid"], best_first(), k)
    return best.join(asked.select("qid", "fallback"), "qid").select("qid", "id", "rrf_score", "rank", "fallback")


def _near_by_group(queries: DataFrame, vecs: DataFrame, depth: int, part: str) -> DataFrame:
    flat = queries.withColumn("__q", F.to_json("qid"))
    near = vectors.vector_topk(flat, "__q", "qvec", vecs, "id", "vec", depth, part)
    keys = queries.select("qid", F.to_json("qid").alias("__q")).distinct()
    return near.withColumnRenamed("qid", "__q").join(keys, "__q").drop("__q")


def case_search(
    queries: DataFrame,
    docs: DataFrame,
    vecs: DataFrame,
    k: int,
    pool: str,
    pools: Sequence[str] = ("factory_history", "company_knowledge"),
    min_similarity: float = 0.60,
    bonus: float = 0.005,
) -> DataFrame:
    """Repair cases: per pool the fused candidates whose cosine reaches the limit, with a bonus for the
    question's own machine; half of k per pool.

    ``queries``: qid, qtext, qvec, machine; ``docs``: id, text, machine and the pool column; ``vecs``: id, vec.
    """
    depth = max(4 * k, 30)
    each = F.explode(F.array(*[F.lit(p) for p in pools])).alias(pool)
    asked = queries.select("*", each).withColumn("__q", F.to_json(F.struct("qid", pool)))
    lex = lexical.bm25_topk(asked, "__q", "qtext", docs, "id", "text", pool, depth, keep_zero=False)
    pooled = vecs.join(docs.select("id", pool), "id")
    near = vectors.vector_topk(asked, "__q", "qvec", pooled, "id", "vec", depth, pool)
    fused = rrf({"vector": near.select("qid", "id", "rank"), "bm25": lex.select("qid", "id", F.col("bm25_rank").alias("rank"))})
    full = (
        small(cut_lineage(fused)).withColumnRenamed("qid", "__q")
        .join(asked.select("__q", "qid", "qvec", F.col("machine").alias("__m")), "__q")
        .join(pooled.select("id", "vec"), "id")
        .join(docs.select("id", pool, "machine"), "id")
        .withColumn("similarity", F.round(vectors.dot(F.col("qvec"), F.col("vec")), 6))
        .filter(F.col("similarity") >= min_similarity)
        .withColumn("same_machine", F.coalesce(F.col("machine") == F.col("__m"), F.lit(False)))
        .withColumn("score", F.round(F.col("rrf_score") + F.when(F.col("same_machine"), bonus).otherwise(0.0), 9))
    )
    return topk(full, ["qid", pool], best_first("score"), max(1, k // 2)).select(
        "qid", pool, "id", "similarity", "score", "same_machine", "rank"
    )
