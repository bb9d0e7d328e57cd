"""Bindings of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, graph, lexical, vectors
from ..operators.ordered import topk
from ..session import cut_lineage, small
from .bindings import CENTROID_SQL, QUESTION_SQL, centroids, questions, top_sql
from .catalog import BLOCKS_SQL, blocks
from .registry import query
from .retrieval import WORDS_SQL, tfidf_sql

TRIPLE_SQL = """(SELECT l_suppkey AS chunk_id, l_orderkey * 10 + l_linenumber + l_partkey * 10000000 AS pos, ' Order ' || l_orderkey AS s, l_returnflag AS p, 'Part ' || l_partkey AS o,
    'S' || (l_orderkey % 50) AS section FROM lineitem)"""


def triples(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("chunk_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") * 10000000).alias("pos"),
        F.concat(F.lit(" Order "), F.col("l_orderkey")).alias("s"), F.col("l_returnflag").alias("p"),
        F.concat(F.lit("Part "), F.col("l_partkey")).alias("o"),
        F.concat(F.lit("S"), (F.col("l_orderkey") % 50).cast("string")).alias("section"),
    )


@query(
    "kg_nodes_j1",
    f"""SELECT lower(trim(s)) AS node, 'entity' AS kind, any_value(s) AS surface FROM {TRIPLE_SQL} GROUP BY 1
        UNION ALL SELECT lower(trim(o)), 'entity', any_value(o) FROM {TRIPLE_SQL} GROUP BY 1
        UNION ALL SELECT DISTINCT 'passage::' || chunk_id, 'passage', NULL FROM {TRIPLE_SQL}""",
)
def kg_nodes_j1(t):
    return graph.build_kg(triples(t))[0]


@query(
    "kg_edges_j1b",
    f"""SELECT chunk_id, pos, 0 AS side, lower(trim(s)) AS src, lower(trim(o)) AS dst, p AS predicate, section FROM {TRIPLE_SQL}
        UNION ALL SELECT chunk_id, pos, 1, lower(trim(s)), 'passage::' || chunk_id, 'appears_in', NULL FROM {TRIPLE_SQL}
        UNION ALL SELECT chunk_id, pos, 2, lower(trim(o)), 'passage::' || chunk_id, 'appears_in', NULL FROM {TRIPLE_SQL}""",
)
def kg_edges_j1b(t):
    return graph.build_kg(triples(t))[1]


SYN_THRESHOLD = 0.85
UNIT_SQL = "(SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"


def synonym_sql(threshold: float) -> str:
    pairs = f"(SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 6) AS score FROM {UNIT_SQL} a JOIN {UNIT_SQL} b ON a.vec_id <> b.vec_id)"
    return f"SELECT id, other, score, rank FROM {top_sql(f'(SELECT * FROM {pairs} WHERE score >= {threshold})', 5, 'id', 'score DESC, other')}"


@query("synonym_edges_j2", synonym_sql(SYN_THRESHOLD))
def synonym_edges_j2(t):
    return vectors.similar_topk(vectors.unit_vectors(t.embeddings, "embedding"), "vec_id", "embedding", SYN_THRESHOLD, 5)


@query("related_edges_j2b", synonym_sql(0.3))
def related_edges_j2b(t):
    return vectors.similar_topk(vectors.unit_vectors(t.embeddings, "embedding"), "vec_id", "embedding", 0.3, 5)


@query(
    "match_entities_j3",
    f"""WITH s AS (SELECT label AS qid, vec_id AS id, round(list_dot_product(cvec, v) / sqrt(list_dot_product(cvec, cvec)), 6) AS score FROM {CENTROID_SQL}, {UNIT_SQL}),
      n AS (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS r0 FROM s) WHERE r0 <= 5)
      SELECT * FROM {top_sql('n', 5)} WHERE score >= 0.3""",
)
def match_entities_j3(t):
    unit = vectors.unit_vectors(t.embeddings, "embedding")
    near = vectors.vector_topk(vectors.unit_vectors(centroids(t), "cvec"), "label", "cvec", unit, "vec_id", "embedding", 5)
    return near.filter("score >= 0.3").select("qid", "id", "score", "rank")


GRAPH_SQL = "(SELECT DISTINCT l_orderkey * 100000000 + l_partkey AS edge_id, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'S' || (l_orderkey % 50) AS section FROM lineitem)"
SEED_SQL = "(SELECT o_orderpriority AS qid, 'o' || arg_max(o_orderkey, o_totalprice) AS node FROM orders GROUP BY 1)"
LINKS_SQL = f"(SELECT src AS a, dst AS b FROM {GRAPH_SQL} UNION SELECT dst, src FROM {GRAPH_SQL})"


def order_graph(t):
    return t.lineitem.select("l_orderkey", "l_partkey").distinct().select(
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey")).alias("edge_id"), F.concat(F.lit("o"), "l_orderkey").alias("src"),
        F.concat(F.lit("p"), "l_partkey").alias("dst"), F.concat(F.lit("S"), (F.col("l_orderkey") % 50).cast("string")).alias("section"),
    )


def dearest(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("qid")).agg(
        F.concat(F.lit("o"), F.max_by("o_orderkey", "o_totalprice")).alias("node")
    )


def reach_sql(seeds: str = SEED_SQL) -> str:
    return f"""l AS MATERIALIZED (SELECT * FROM {LINKS_SQL}), r0 AS (SELECT qid, node FROM {seeds}), r1 AS (SELECT * FROM r0 UNION SELECT qid, b FROM r0 JOIN l ON a = node),
      r2 AS (SELECT * FROM r1 UNION SELECT qid, b FROM r1 JOIN l ON a = node)"""


@query(
    "neighbours_j4",
    f"WITH {reach_sql()} SELECT qid, edge_id, src, dst FROM r2 JOIN {GRAPH_SQL} ON src = node",
)
def neighbours_j4(t):
    return graph.neighbours(order_graph(t), dearest(t), 2, None).select("qid", "edge_id", "src", "dst")


@query(
    "neighbours_capped_j4b",
    f"WITH {reach_sql()} SELECT qid, edge_id, triple_no FROM {top_sql(f'(SELECT qid, edge_id FROM r2 JOIN {GRAPH_SQL} ON src = node)', 30, 'qid', 'edge_id', 'triple_no')}",
)
def neighbours_capped_j4b(t):
    return graph.neighbours(order_graph(t), dearest(t), 2, 30).select("qid", "edge_id", "triple_no")


PART_SEEDS = "(SELECT p_brand AS qid, 'p' || max(p_partkey) AS node FROM part GROUP BY 1 UNION ALL SELECT * FROM " + SEED_SQL + ")"


@query(
    "adaptive_hops_j5",
    f"""WITH {reach_sql(PART_SEEDS)}, e AS (SELECT * FROM {GRAPH_SQL}),
      one AS {top_sql('(SELECT qid, e.* FROM r1 JOIN e ON src = node)', 20, 'qid', 'edge_id', 'triple_no')},
      two AS {top_sql('(SELECT qid, e.* FROM r2 JOIN e ON src = node)', 40, 'qid', 'edge_id', 'triple_no')},
      ok AS (SELECT qid FROM one GROUP BY qid HAVING count(DISTINCT section) >= 2)
      SELECT qid, edge_id, triple_no, 1 AS hops FROM one SEMI JOIN ok USING (qid) UNION ALL SELECT qid, edge_id, triple_no, 2 FROM two ANTI JOIN ok USING (qid)""",
)
def adaptive_hops_j5(t):
    parts = t.part.groupBy(F.col("p_brand").alias("qid")).agg(F.concat(F.lit("p"), F.max("p_partkey").cast("string")).alias("node"))
    return graph.adaptive_hops(order_graph(t), parts.unionByName(dearest(t))).select("qid", "edge_id", "triple_no", "hops")


def edge_vectors(t):
    """Order-part edges in both directions, each with the id of one embedding."""
    n = t.embeddings.agg(F.count("*").alias("n")).scalar()
    e = order_graph(t)
    back = e.select((F.col("edge_id") + 50000000).alias("edge_id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "section")
    return e.unionByName(back).select("edge_id", "src", "dst", (F.col("edge_id") % n).alias("vec_id"))


def walk_inputs(t):
    """Every label asks from the open orders of its customers."""
    labels = t.embeddings.agg(F.count_distinct("label").alias("n")).scalar()
    seeds = t.orders.filter("o_orderstatus = 'P'").select((F.col("o_custkey") % labels).cast("int").alias("qid"), F.concat(F.lit("o"), "o_orderkey").alias("node"))
    unit = vectors.unit_vectors(centroids(t), "cvec")
    return edge_vectors(t), seeds, unit.select(F.col("label").alias("qid"), F.col("cvec").alias("qvec"))


WALK_SQL = f"""sd AS (SELECT DISTINCT CAST(o_custkey % (SELECT count(DISTINCT label) FROM embeddings) AS INT) AS qid, 'o' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'P'),
  ed AS (SELECT edge_id, src, dst FROM {GRAPH_SQL} UNION ALL SELECT edge_id + 50000000, dst, src FROM {GRAPH_SQL}),
  se AS (SELECT * FROM (SELECT c.label AS qid, edge_id, src, dst, round(list_dot_product(cvec, CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(cvec, cvec)), 6) AS score
    FROM ed JOIN embeddings ON vec_id = edge_id % (SELECT count(*) FROM embeddings), {CENTROID_SQL} c) WHERE score >= 0.3),
  s0 AS (SELECT * FROM {top_sql('(SELECT se.* FROM se JOIN sd ON sd.qid = se.qid AND node = src)', 20, 'qid', 'score DESC, edge_id', 'r0')}),
  w(qid, k, picked, nodes, depths) AS (
    SELECT qid, 0, []::BIGINT[], []::VARCHAR[], []::INT[] FROM s0 GROUP BY qid
    UNION ALL
    SELECT qid, k + 1, list_append(picked, b.edge), CASE WHEN b.depth < 4 AND NOT list_contains(nodes, b.dst) THEN list_append(nodes, b.dst) ELSE nodes END,
      CASE WHEN b.depth < 4 AND NOT list_contains(nodes, b.dst) THEN list_append(depths, b.depth + 1) ELSE depths END
    FROM (SELECT qid, any_value(k) AS k, any_value(picked) AS picked, any_value(nodes) AS nodes, any_value(depths) AS depths,
        arg_min(struct_pack(edge := edge_id, dst := dst, depth := depth), row(-score, edge_id, depth)) AS b
      FROM (SELECT w.*, edge_id, dst, score, 0 AS depth FROM w JOIN s0 USING (qid)
        UNION ALL SELECT x.qid, k, picked, nodes, depths, edge_id, dst, score, depth FROM (SELECT *, unnest(nodes) AS node, unnest(depths) AS depth FROM w) x JOIN se ON se.qid = x.qid AND se.src = node)
      WHERE k < 20 AND NOT list_contains(picked, edge_id) GROUP BY qid)),
  walk AS (SELECT qid, CAST(unnest(range(1, len(picked) + 1)) AS INT) AS pick, unnest(picked) AS edge_id FROM (SELECT qid, arg_max(picked, k) AS picked FROM w GROUP BY qid))"""


@query("best_first_j6", f"WITH RECURSIVE {WALK_SQL} SELECT qid, pick, edge_id, src, dst, score FROM walk JOIN se USING (qid, edge_id)")
def best_first_j6(t):
    return graph.best_first(*walk_inputs(t), vectors=edge_embeddings(t))


def edge_embeddings(t):
    return t.embeddings.select("vec_id", F.col("embedding").alias("vec"))


@query(
    "triple_hits_j12",
    f"""WITH RECURSIVE {WALK_SQL}, nm AS (SELECT DISTINCT l_orderkey * 100000000 + l_partkey AS edge_id, ' Order ' || l_orderkey AS s, l_returnflag AS p, 'Part ' || l_partkey AS o FROM lineitem),
      fi AS (SELECT s, p, o, arg_min(chunk_id, row(chunk_id, pos)) AS chunk_id FROM {TRIPLE_SQL} GROUP BY ALL)
      SELECT DISTINCT qid, s, p, o, chunk_id, 'passage::' || chunk_id AS passage FROM walk JOIN nm USING (edge_id) JOIN fi USING (s, p, o)""",
)
def triple_hits_j12(t):
    picked = small(cut_lineage(graph.best_first(*walk_inputs(t), vectors=edge_embeddings(t))))
    named = t.lineitem.select(
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey")).alias("edge_id"), F.concat(F.lit(" Order "), F.col("l_orderkey")).alias("s"),
        F.col("l_returnflag").alias("p"), F.concat(F.lit("Part "), F.col("l_partkey")).alias("o"),
    )
    wanted = cut_lineage(named.join(picked, "edge_id").select("qid", "s", "p", "o").distinct())
    return graph.triple_passages(wanted, kg_surfaces(t, wanted))


def kg_surfaces(t, wanted=None):
    """The edges with the surface of their triple, or those of the ``wanted`` surfaces."""
    tr = triples(t)
    if wanted is None:
        return graph.build_kg(tr.filter("chunk_id is not null and pos is not null"), surfaces=True)[1]
    surfaces = tr.select("chunk_id", "pos", "s", "p", "o")
    surfaces = small(surfaces.join(small(wanted.select("s", "p", "o").distinct()), ["s", "p", "o"], "left_semi"))
    return graph.build_kg(tr)[1].join(surfaces, ["chunk_id", "pos"])


@query(
    "triple_passages_d17",
    f"""WITH w AS (SELECT DISTINCT s, p, o FROM {TRIPLE_SQL}), f AS (SELECT s, p, o, chunk_id FROM {top_sql(TRIPLE_SQL, 1, 's, p, o', 'chunk_id, pos')})
       SELECT p AS qid, s, p, o, chunk_id, 'passage::' || chunk_id AS passage FROM w JOIN f USING (s, p, o)""",
)
def triple_passages_d17(t):
    wanted = triples(t).select("s", "p", "o").distinct().select(F.col("p").alias("qid"), "s", "p", "o")  # dealt by the key that it is joined with
    return graph.triple_passages(wanted, kg_surfaces(t))


@query(
    "sections_to_chunks_j7",
    rf"""WITH c AS (SELECT doc_id AS chunk_id, lower(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))) AS t FROM documents),
       w AS (SELECT DISTINCT lang AS qid, lower(split_part(text, ' ', 1)) AS h FROM documents WHERE NOT contains(split_part(text, ' ', 1), chr(10)) AND trim(split_part(text, ' ', 1)) <> '')
       SELECT qid, chunk_id, chunk_no FROM {top_sql('(SELECT DISTINCT qid, chunk_id FROM c JOIN w ON starts_with(t, h))', 8, 'qid', 'chunk_id', 'chunk_no')}""",
)
def sections_to_chunks_j7(t):
    """First lines are section titles; the first words of a language's texts ask for them."""
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.substring_index("text", "\n", 1).alias("section_title"))
    word = F.substring_index("text", " ", 1)
    titles = t.documents.filter(~F.contains(word, F.lit("\n"))).select(F.col("lang").alias("qid"), word.alias("title"))
    return graph.sections_to_chunks(titles, chunks)


PAGE_NODES = f"""(SELECT DISTINCT 'p/' || doc || '/' || page AS node, 'passage' AS kind, doc, page FROM {BLOCKS_SQL}
   UNION ALL SELECT 't/' || doc || '/' || position, 'table', doc, page FROM {BLOCKS_SQL} WHERE kind = 'tables')"""
PAGE_LINKS = f"""(WITH pg AS (SELECT DISTINCT doc, page FROM {BLOCKS_SQL}), one AS (
   SELECT 'p/' || a.doc || '/' || a.page AS src, 'p/' || a.doc || '/' || b.page AS dst FROM pg a JOIN pg b ON a.doc = b.doc AND b.page = a.page + 1
   UNION ALL SELECT 'p/' || doc || '/' || page, 't/' || doc || '/' || position FROM {BLOCKS_SQL} WHERE kind = 'tables')
   SELECT src, dst FROM one UNION SELECT dst, src FROM one)"""


@query("page_nodes_j8", f"SELECT node, kind, doc, page FROM {PAGE_NODES}")
def page_nodes_j8(t):
    return graph.page_graph(blocks(t))[0]


@query("page_edges_j8b", f"SELECT src, dst FROM {PAGE_LINKS}")
def page_edges_j8b(t):
    return graph.page_graph(blocks(t))[1]


NODE_TEXT = f"""(SELECT 'p/' || doc || '/' || page AS id, coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (WHERE kind <> 'tables'), '') AS text FROM {BLOCKS_SQL} GROUP BY doc, page
   UNION ALL SELECT 't/' || doc || '/' || position, text FROM {BLOCKS_SQL} WHERE kind = 'tables')"""


def node_texts(t):
    b = blocks(t)
    pages = assembly.assemble_pages(b).select(F.concat_ws("/", F.lit("p"), "doc", F.col("page").cast("string")).alias("id"), F.col("body").alias("text"))
    tables = b.filter("kind = 'tables'").select(F.concat_ws("/", F.lit("t"), "doc", F.col("position").cast("string")).alias("id"), "text")
    return pages.unionByName(tables)


def page_seeds(t):
    hits = lexical.tfidf_topk(questions(t), "qid", "qtext", node_texts(t), "id", "text", 5)
    return hits.filter("score > 0").select("qid", F.col("id").alias("node"), F.col("score").alias("weight"))


ROUNDS = graph.rounds_needed()


def ppr_sql() -> str:
    head = f"""{tfidf_sql(WORDS_SQL, QUESTION_SQL, NODE_TEXT)},
      hit AS MATERIALIZED (SELECT qid, id AS node, score AS weight FROM {top_sql('ti', 5)} WHERE score > 0),
      e AS MATERIALIZED (SELECT src, dst, 1.0 / CAST(count(*) OVER (PARTITION BY src) AS DOUBLE) AS w FROM {PAGE_LINKS}),
      s AS MATERIALIZED (SELECT qid, node, weight / sum(weight) OVER (PARTITION BY qid) AS s FROM hit), x0 AS (SELECT qid, node, s AS score FROM s)"""
    for n in range(1, ROUNDS + 1):
        head += f""", x{n} AS MATERIALIZED (SELECT qid, node, sum(score) AS score FROM (
          SELECT qid, dst AS node, CAST(0.3 AS DOUBLE) * sum(score * w) AS score FROM x{n - 1} JOIN e ON src = node GROUP BY ALL
          UNION ALL SELECT qid, s.node, s * (CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * coalesce(d, 0)) FROM s LEFT JOIN
            (SELECT qid, sum(score) AS d FROM x{n - 1} WHERE node NOT IN (SELECT src FROM e) GROUP BY qid) USING (qid)) GROUP BY ALL)"""
    return head + f", pr AS MATERIALIZED (SELECT qid, node, round(score, 6) AS score FROM x{ROUNDS})"


@query("ppr_j9", f"WITH {ppr_sql()} SELECT qid, node, score FROM pr WHERE score > 0")
def ppr_j9(t):
    scores = graph.ppr(graph.page_graph(blocks(t))[1], page_seeds(t))
    scores = scores.select("qid", "node", F.round("score", 6).alias("score")).filter("score > 0")
    return scores


FINAL_SQL = top_sql("(SELECT * FROM pr WHERE score > 0)", 5, "qid", "score DESC, node")


def finals(t, seeds=None):
    nodes, edges = graph.page_graph(blocks(t))
    return graph.ppr_topk(graph.ppr(edges, page_seeds(t) if seeds is None else seeds), nodes)


@query("ppr_topk_j10", f"WITH {ppr_sql()} SELECT qid, node, score, rank FROM {FINAL_SQL}")
def ppr_topk_j10(t):
    return finals(t)


@query(
    "subgraph_j11",
    f"""WITH {ppr_sql()}, fin AS MATERIALIZED (SELECT qid, node FROM {FINAL_SQL}),
      nb AS (SELECT qid, dst AS node FROM {top_sql('(SELECT qid, node, dst, w FROM fin JOIN e ON src = node)', 2, 'qid, node', 'w DESC, dst')}),
      sh AS MATERIALIZED (SELECT qid, node FROM hit UNION SELECT * FROM fin UNION SELECT * FROM nb)
      SELECT qid, 'query' AS src, node AS dst, 'direct' AS kind FROM hit UNION ALL
      SELECT a.qid, src, dst, 'context' FROM sh a JOIN e ON src = a.node JOIN sh b ON b.qid = a.qid AND b.node = dst WHERE src < dst""",
)
def subgraph_j11(t):
    seeds = cut_lineage(page_seeds(t))
    return graph.subgraph(graph.page_graph(blocks(t))[1], seeds, cut_lineage(finals(t, seeds)))


@query(
    "merge_triples_j13",
    f"SELECT qid, s, p, o, min(pos) AS pos FROM (SELECT chunk_id % 3 AS qid, 'brand' AS s, p, section AS o, pos FROM {TRIPLE_SQL}) GROUP BY ALL",
)
def merge_triples_j13(t):
    rows = triples(t).select((F.col("chunk_id") % 3).alias("qid"), F.lit("brand").alias("s"), "p", F.col("section").alias("o"), "pos")
    return graph.merge_triples(rows, F.col("pos"))


@query(
    "union_graphs_h6",
    """SELECT node, min(kind) AS kind, array_to_string(list_sort(list(DISTINCT sec)), ',') AS sections FROM (
         SELECT 'p' || l_partkey AS node, 'a' AS kind, l_returnflag AS sec FROM lineitem WHERE l_linestatus = 'O'
         UNION ALL SELECT 'p' || l_partkey, 'b', l_linestatus || l_returnflag FROM lineitem WHERE l_linestatus = 'F') GROUP BY node""",
)
def union_graphs_h6(t):
    node = F.concat(F.lit("p"), F.col("l_partkey")).alias("node")
    one = t.lineitem.filter("l_linestatus = 'O'")
    two = t.lineitem.filter("l_linestatus = 'F'")
    side = lambda df, kind, sec: df.select(node, F.lit(kind).alias("kind"), F.array(sec).alias("sections")).distinct()
    edges = lambda df: df.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes, _ = graph.union_graphs(
        side(one, "a", F.col("l_returnflag")), side(two, "b", F.concat("l_linestatus", "l_returnflag")), edges(one), edges(two), "sections"
    )
    return nodes.withColumn("sections", F.array_join("sections", ","))
