"""Entity, passage and page graphs as node and edge tables, and bounded walks over them."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_key
from ..session import cut_lineage, fresh_path, small
from .ordered import first_per_key, topk
from .vectors import dot

RESTART, TOLERANCE = 0.7, 1e-6  # fixed values


def build_kg(triples: DataFrame, surfaces: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entity and passage nodes, predicate edges and ``appears_in`` edges.

    ``triples``: chunk_id, pos, s, p, o, section; (chunk_id, pos) is the insertion order and names the edge.
    With ``surfaces`` the edges keep s, p and o of their triple.
    """
    kept = ["s", "p", "o"] if surfaces else []
    key = lambda c: F.lower(F.trim(c))
    t = triples.withColumn("src", key("s")).withColumn("dst", key("o")).filter("src <> '' AND dst <> ''")
    ends = t.select("chunk_id", "pos", *kept, F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("side"), F.col("s").alias("surface")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("side"), F.col("o").alias("surface")),
    )).alias("e")).select("chunk_id", "pos", *kept, "e.*")
    entities = first_per_key(ends, ["node"], [F.col("chunk_id"), F.col("pos"), F.col("side")]).select(
        "node", F.lit("entity").alias("kind"), "surface"
    )
    passage = F.concat(F.lit("passage::"), F.col("chunk_id").cast("string"))
    passages = triples.select(passage.alias("node")).distinct().select("node", F.lit("passage").alias("kind"), F.lit(None).cast("string").alias("surface"))
    relations = t.select("chunk_id", "pos", F.lit(0).alias("side"), "src", "dst", F.col("p").alias("predicate"), "section", *kept)
    appears = ends.select(
        "chunk_id", "pos", (F.col("side") + 1).alias("side"), F.col("node").alias("src"), passage.alias("dst"),
        F.lit("appears_in").alias("predicate"), F.lit(None).cast("string").alias("section"), *kept,
    )
    return entities.unionByName(passages), relations.unionByName(appears)


def union_graphs(nodes: DataFrame, more_nodes: DataFrame, edges: DataFrame, more_edges: DataFrame, sets: str) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by key with the union of their set attribute (first kind wins); edges appended."""
    both = nodes.withColumn("__g", F.lit(0)).unionByName(more_nodes.withColumn("__g", F.lit(1)))
    kinds = both.groupBy("node").agg(F.min_by("kind", "__g").alias("kind"))
    values = both.select("node", F.explode_outer(sets).alias("v")).distinct().groupBy("node").agg(F.array_sort(F.collect_set("v")).alias(sets))
    return kinds.join(values, "node"), edges.unionByName(more_edges)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(qid, node) within ``radius`` undirected steps of the seeds."""
    links = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = cut_lineage(seeds.select("qid", "node").distinct())
    frontier = seen
    for _ in range(radius):
        step = links.join(small(frontier), F.col("node") == F.col("src")).select("qid", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["qid", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def neighbours(edges: DataFrame, seeds: DataFrame, radius: int, cap: int | None) -> DataFrame:
    """Out-edges of all reached nodes per query; at most ``cap`` by edge id when given.

    ``edges``: edge_id, src, dst and attributes.
    """
    found = edges.join(small(reach(edges, seeds, radius)), F.col("node") == F.col("src")).drop("node")
    return found if cap is None else topk(found, ["qid"], [F.col("edge_id")], cap, "triple_no")


def adaptive_hops(edges: DataFrame, seeds: DataFrame, min_sections: int = 2, cap1: int = 20, cap2: int = 40) -> DataFrame:
    """One step; two steps for the queries whose first step found fewer than ``min_sections`` sections."""
    one = neighbours(edges, seeds, 1, cap1)
    enough = one.groupBy("qid").agg(F.count_distinct("section").alias("n")).filter(F.col("n") >= min_sections).select("qid")
    poor = seeds.join(enough, "qid", "left_anti")
    two = neighbours(edges, poor, 2, cap2)
    return one.join(enough, "qid", "left_semi").withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))


STATE = ("kind", "edge_id", "src", "dst", "score", "depth", "pick")
PICKED, OPEN, CACHED, NODE, WANTED = range(5)


def best_first(
    edges: DataFrame, seeds: DataFrame, queries: DataFrame, max_triples: int = 20, floor: float = 0.30, max_depth: int = 4,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Edges in the order a best-first walk picks them by their cosine with the query.

    ``edges``: edge_id, src, dst, vec; ``seeds``: qid, node; ``queries``: qid, qvec. With ``vectors`` (vec_id, vec) the edges have a vec_id; they are stored
    once, and only those that a round looks up get their vector. The walk keeps a state of bounded size per query: its picks, the
    best open edges (no more than it can still pick), and the out-edges of the nodes that those lead to. A round looks up, for all queries at
    once, the nodes whose out-edges a pick may open, ``max_triples`` of them each; then every walk goes on until it needs a node that it has
    not seen. State is checkpointed each round; there are at most ``max_triples`` rounds, seldom more than ``max_depth`` + 2.
    """
    asked = queries.select("qid", "qvec")
    if vectors is not None:
        path = fresh_path(edges.sparkSession, "edges")
        edges.select("edge_id", "src", "dst", "vec_id").write.parquet(path)
        edges = edges.sparkSession.read.schema(edges.select("edge_id", "src", "dst", "vec_id").schema).parquet(path)
    meet = lambda nodes: edges.join(small(nodes), F.col("node") == F.col("src"))
    scored = lambda nodes: (
        (meet(nodes) if vectors is None else meet(nodes).join(vectors.select("vec_id", "vec"), "vec_id")).join(small(asked), "qid")
        .withColumn("score", F.round(dot(F.col("qvec"), F.col("vec")), 6)).filter(F.col("score") >= floor)
        .select("qid", "src", "dst", "edge_id", "score")
    )
    best = [F.col("score").desc(), F.col("edge_id")]

    def rows(df: DataFrame, kind: int) -> DataFrame:
        null = lambda c: F.col(c) if c in df.columns else F.lit(None).cast(types[c])
        return df.select("qid", F.lit(kind).alias("kind"), *[null(c).alias(c) for c in STATE[1:]])

    types = {c: edges.schema[c].dataType for c in ("edge_id", "src", "dst")} | {"score": "double", "depth": "int", "pick": "int"}
    schema = f"qid {seeds.schema['qid'].dataType.simpleString()}, kind int, " + ", ".join(
        f"{c} {types[c] if isinstance(types[c], str) else types[c].simpleString()}" for c in STATE[1:])
    first = topk(scored(seeds.select("qid", "node").distinct()), ["qid"], best, max_triples, "__r").withColumn("depth", F.lit(0))
    state = cut_lineage(rows(first, OPEN).groupBy("qid").applyInPandas(_walk(max_triples, max_depth), schema))
    for _ in range(max_triples):
        wanted = state.filter(F.col("kind") == WANTED).select("qid", F.col("dst").alias("node"))
        if wanted.isEmpty():
            break
        found = topk(scored(wanted), ["qid", "src"], best, max_triples, "__r")
        more = rows(found, CACHED).unionByName(rows(wanted.withColumnRenamed("node", "src"), NODE))
        held = state.filter(F.col("kind") != WANTED).unionByName(more)
        state = cut_lineage(held.groupBy("qid").applyInPandas(_walk(max_triples, max_depth), schema))
    return state.filter(F.col("kind") == PICKED).select("qid", "pick", "edge_id", "src", "dst", "score")


def _walk(max_triples: int, max_depth: int):
    """Go on with the walk of one query as far as its state reaches; what it lacks to go on becomes WANTED."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        by_kind = {kind: list(rows[["score", "edge_id", "src", "dst", "depth", "pick"]].itertuples(index=False)) for kind, rows in group.groupby("kind")}
        picked = sorted(by_kind.get(PICKED, []), key=lambda r: r.pick)
        queue = [(-r.score, r.edge_id, r.src, r.dst, int(r.depth)) for r in by_kind.get(OPEN, [])]
        heapq.heapify(queue)
        cache: dict = {r.src: [] for r in by_kind.get(NODE, [])}
        for r in by_kind.get(CACHED, []):
            cache[r.src].append(r)
        visited = {r.src for r in picked} | {r.dst for r in picked if r.depth < max_depth}
        picked = [(r.score, r.edge_id, r.src, r.dst, int(r.depth)) for r in picked]
        known = {edge for _, edge, *_ in picked} | {q[1] for q in queue}
        while queue and len(picked) < max_triples:
            cost, edge, src, dst, depth = queue[0]
            opens = depth < max_depth and dst not in visited
            if opens and dst not in cache:
                break
            heapq.heappop(queue)
            picked.append((-cost, edge, src, dst, depth))
            if opens:
                visited.add(dst)
                for r in cache[dst]:
                    if r.edge_id not in known:
                        known.add(r.edge_id)
                        heapq.heappush(queue, (-r.score, r.edge_id, r.src, r.dst, depth + 1))
        queue = heapq.nsmallest(max_triples - len(picked), queue)
        leads = {dst for *_, dst, depth in queue if depth < max_depth and dst not in visited}
        out = [(PICKED, e, s, d, score, depth, n) for n, (score, e, s, d, depth) in enumerate(picked, 1)]
        out += [(OPEN, e, s, d, -cost, depth, None) for cost, e, s, d, depth in queue]
        out += [(NODE, None, n, None, None, None, None) for n in leads if n in cache]
        out += [(CACHED, r.edge_id, r.src, r.dst, r.score, None, None) for n in leads if n in cache for r in cache[n]]
        out += [(WANTED, None, None, n, None, None, None) for n in leads if n not in cache]
        frame = pd.DataFrame(out, columns=list(STATE)).astype({"edge_id": object, "depth": object, "pick": object})
        return frame.assign(qid=group["qid"].iloc[0])[["qid", *STATE]]

    return run


def sections_to_chunks(titles: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """First ``limit`` chunks per query whose section title equals or starts with one of the query's titles.

    The prefix match is an equi join on the title's own prefixes, cut only at the lengths that occur.
    """
    wanted = titles.select("qid", content_key(F.col("title")).alias("head")).filter("head <> ''").distinct()
    lengths = [r[0] for r in wanted.select(F.length("head")).distinct().collect()]  # titles are short; few lengths
    norm = chunks.select("chunk_id", content_key(F.coalesce("section_title", F.lit(""))).alias("t"))
    heads = F.array(*[F.when(F.length("t") >= n, F.substring("t", 1, n)) for n in lengths])
    cut = norm.select("chunk_id", F.explode(F.array_compact(heads)).alias("head"))
    found = cut.join(wanted, "head").select("qid", "chunk_id").distinct()
    return topk(found, ["qid"], [F.col("chunk_id")], limit, "chunk_no")


def page_graph(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page and table nodes; each page linked with the next page and with its tables, both ways.

    ``blocks``: doc, page, position, text, kind.
    """
    page_id = lambda page: F.concat_ws("/", F.lit("p"), F.col("doc"), page.cast("string"))
    table_id = F.concat_ws("/", F.lit("t"), F.col("doc"), F.col("position").cast("string"))
    pages = blocks.select("doc", "page").distinct()
    tables = blocks.filter(F.col("kind") == "tables")
    nodes = pages.select(page_id(F.col("page")).alias("node"), F.lit("passage").alias("kind"), "doc", "page").unionByName(
        tables.select(table_id.alias("node"), F.lit("table").alias("kind"), "doc", "page")
    )
    following = pages.join(pages.select("doc", (F.col("page") - 1).alias("page")), ["doc", "page"], "left_semi")
    links = following.select(page_id(F.col("page")).alias("src"), page_id(F.col("page") + 1).alias("dst")).unionByName(
        tables.select(page_id(F.col("page")).alias("src"), table_id.alias("dst"))
    )
    return nodes, both_ways(links)


def transitions(edges: DataFrame) -> DataFrame:
    """Row-normalised edge weights."""
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    return edges.join(degree, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w"))


def rounds_needed(restart: float = RESTART, tolerance: float = TOLERANCE) -> int:
    """Rounds after which two successive score vectors differ by less than the tolerance (the step shrinks
    by 1 - restart per round, starting from at most 2)."""
    return math.ceil(math.log(tolerance / 2) / math.log(1 - restart))


def ppr(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, restart: float = RESTART, cut_every: int = 4) -> DataFrame:
    """Personalised PageRank per query; the mass of nodes without out-edges returns to the seeds.

    ``edges``: src, dst; ``seeds``: qid, node, weight, of which only positive weights count. Only nodes with mass are stored.
    """
    walk = small(cut_lineage(transitions(edges)))
    seeds = seeds.filter("weight > 0")
    total = seeds.groupBy("qid").agg(F.sum("weight").alias("__t"))
    seed = cut_lineage(seeds.join(total, "qid").select("qid", "node", (F.col("weight") / F.col("__t")).alias("s")))
    # the few seeds of a query travel with its rows, so stuck mass goes back without a second pass
    lists = small(seed.groupBy("qid").agg(F.collect_list(F.struct("node", "s")).alias("__seeds")))
    scores = seed.select("qid", "node", F.col("s").alias("score"))
    base = seed.select("qid", "node", (restart * F.col("s")).alias("score"))
    for n in range(1, (rounds or rounds_needed(restart)) + 1):
        at = scores.withColumnRenamed("node", "src").join(walk, "src", "left").join(lists, "qid")
        step = F.struct(F.col("dst").alias("node"), (F.col("score") * F.col("w")).alias("m"))
        stuck = F.transform("__seeds", lambda e: F.struct(e.node.alias("node"), (F.col("score") * e.s).alias("m")))
        moved = at.select("qid", F.explode(F.when(F.col("dst").isNotNull(), F.array(step)).otherwise(stuck)).alias("x"))
        flow = moved.select("qid", "x.node", ((1 - restart) * F.col("x.m")).alias("score"))
        scores = flow.unionByName(base).groupBy("qid", "node").agg(F.sum("score").alias("score"))
        if n % cut_every == 0:
            scores = cut_lineage(scores)
    return scores


def ppr_topk(scores: DataFrame, contexts: DataFrame, k: int = 5) -> DataFrame:
    """Best k context nodes with positive score per query."""
    positive = scores.withColumn("score", F.round("score", 6)).filter("score > 0").join(contexts.select("node"), "node", "left_semi")
    return topk(positive, ["qid"], [F.col("score").desc(), F.col("node")], k)


def subgraph(edges: DataFrame, direct: DataFrame, final: DataFrame, strongest: int = 2) -> DataFrame:
    """Edges shown for an answer: query to direct hits, and links among direct hits, finals and the
    ``strongest`` neighbours of each final. ``direct`` and ``final``: qid, node."""
    near = final.select("qid", "node").join(transitions(edges), F.col("node") == F.col("src"))
    near = topk(near, ["qid", "node"], [F.col("w").desc(), F.col("dst")], strongest, "__r").select("qid", F.col("dst").alias("node"))
    shown = direct.select("qid", "node").unionByName(final.select("qid", "node")).unionByName(near).distinct()
    inside = (
        shown.join(edges.filter("src < dst"), F.col("node") == F.col("src"))
        .select("qid", "src", "dst")
        .join(shown.select("qid", F.col("node").alias("dst")), ["qid", "dst"], "left_semi")
    )
    hits = direct.select("qid", F.lit("query").alias("src"), F.col("node").alias("dst"), F.lit("direct").alias("kind"))
    return hits.unionByName(inside.select("qid", "src", "dst", F.lit("context").alias("kind")))


def triple_passages(triples: DataFrame, edges: DataFrame) -> DataFrame:
    """Provenance of picked triples: the first edge with the same surface, and its passage.

    ``triples``: qid, s, p, o; ``edges`` as built by ``build_kg`` plus the surface columns s, p, o.
    """
    first = first_per_key(edges.filter(F.col("side") == 0), ["s", "p", "o"], [F.col("chunk_id"), F.col("pos")])
    # passages move once, by the key they are looked up with; triples meet their first edge where it is
    passage = edges.filter(F.col("predicate") == "appears_in").groupBy("chunk_id", "src").agg(F.collect_set("dst").alias("__p"))
    passage = passage.select("chunk_id", "src", F.explode("__p").alias("passage"))
    held = triples.join(first.select("s", "p", "o", "src", "chunk_id"), ["s", "p", "o"])
    return held.join(passage, ["chunk_id", "src"]).select("qid", "s", "p", "o", "chunk_id", "passage")


def merge_triples(branches: DataFrame, position: Column) -> DataFrame:
    """Distinct triples over all branches of a query, each at its first position."""
    return first_per_key(branches, ["qid", "s", "p", "o"], [position])
