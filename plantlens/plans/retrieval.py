"""Bindings of search, fusion, ranking and page-level retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_key, term_pattern
from ..operators import catalog, evidence, fusion, lexical, pages, vectors
from ..operators.ordered import first_per_key, topk
from ..session import cut_lineage, small
from .bindings import (
    CENTROID_SQL,
    DOCS_SQL,
    QUESTION_SQL,
    VECS_SQL,
    bm25_sql,
    centroids,
    cosine_sql,
    docs,
    near_sql,
    questions,
    top_sql,
    vecs,
)
from .registry import query

BM_ALL = bm25_sql(QUESTION_SQL, DOCS_SQL, "part")
BM_MACHINE = bm25_sql(QUESTION_SQL, DOCS_SQL, "machine")


@query(
    "corpus_stats_e1",
    f"WITH {BM_MACHINE} SELECT part, term, df, round(idf, 6) AS idf, n AS n_docs, round(avgdl, 6) AS avgdl FROM idf JOIN tot USING (part)",
)
def corpus_stats_e1(t):
    totals, terms = lexical.corpus_stats(docs(t), "id", "machine", "text")
    return terms.join(totals, "part").select(
        "part", "term", "df", F.round("idf", 6).alias("idf"), "n_docs", F.round("avgdl", 6).alias("avgdl")
    )


@query("bm25_topk_i1", f"WITH {BM_ALL} SELECT qid, id, score, bm25_rank FROM {top_sql('bm', 5, rank='bm25_rank')}")
def bm25_topk_i1(t):
    return lexical.bm25_topk(questions(t), "qid", "qtext", docs(t), "id", "text", None, 5).select(
        "qid", "id", "score", "bm25_rank"
    )


@query(
    "bm25_by_machine_i1b",
    f"WITH {BM_MACHINE} SELECT part, qid, id, score, bm25_rank FROM {top_sql('bm', 20, rank='bm25_rank')}",
)
def bm25_by_machine_i1b(t):
    return lexical.bm25_topk(questions(t), "qid", "qtext", docs(t), "id", "text", "machine", 20).select(
        "part", "qid", "id", "score", "bm25_rank"
    )


@query("vector_topk_i2", f"WITH {cosine_sql(QUESTION_SQL, VECS_SQL, 'machine')} SELECT qid, id, score, rank FROM {near_sql(20)}")
def vector_topk_i2(t):
    return vectors.vector_topk(questions(t), "qid", "qvec", vecs(t), "id", "vec", 20, "machine")


@query(
    "all_scores_rank_f1",
    f"WITH {cosine_sql(QUESTION_SQL, VECS_SQL, 'part')} SELECT qid, id, score, rank FROM {top_sql('vs', 50)}",
)
def all_scores_rank_f1(t):
    found = vectors.vector_topk(questions(t), "qid", "qvec", vecs(t), "id", "vec", 50)
    return topk(found.drop("rank"), ["qid"], [F.col("score").desc(), F.col("id")], 50)


@query(
    "best_candidate_d16",
    f"WITH {cosine_sql(VECS_SQL.replace('SELECT vec_id AS id,', 'SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qvec,').replace('CAST(embedding AS DOUBLE[]) AS vec, ', ''), VECS_SQL, 'machine')} SELECT qid, id, score, rank FROM {near_sql(3)}",
)
def best_candidate_d16(t):
    """Every vector as a query against all vectors of its machine."""
    v = vecs(t)
    q = v.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "machine")
    return vectors.vector_topk(q, "qid", "qvec", v, "id", "vec", 3, "machine")


@query(
    "bounded_topk_g1",
    """WITH s AS (SELECT label AS qid, vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 1) AS score FROM embeddings)
       SELECT qid, id, score, rank FROM """
    + near_sql(4, "s"),
)
def bounded_topk_g1(t):
    e = t.embeddings.select(
        F.col("vec_id").alias("id"),
        F.array(F.round(F.col("embedding")[0].cast("double"), 1)).alias("vec"),
        F.col("label").alias("machine"),
    )
    q = t.embeddings.select(F.col("label").alias("qid"), F.array(F.lit(1.0)).alias("qvec"), F.col("label").alias("machine")).distinct()
    return vectors.vector_topk(q, "qid", "qvec", e, "id", "vec", 4, "machine")


@query(
    "ip_postfilter_i3",
    f"WITH {cosine_sql(QUESTION_SQL, VECS_SQL, 'part')} SELECT n.qid, n.id, n.score, n.rank FROM {near_sql(20)} n "
    f"JOIN {VECS_SQL} v USING (id) JOIN {QUESTION_SQL} q USING (qid) WHERE v.machine = q.machine",
)
def ip_postfilter_i3(t):
    q, v = questions(t), vecs(t)
    near = vectors.vector_topk(q, "qid", "qvec", v, "id", "vec", 20)
    owner = v.select("id", F.col("machine").alias("owner"))
    return (
        near.join(owner, "id").join(q.select("qid", "machine"), "qid").filter("owner = machine").select("qid", "id", "score", "rank")
    )


def fused_sql(part: str, depth: int) -> str:
    """CTE fu(qid, id, rrf_score, vector_rank, bm25_rank)."""
    return f"""{bm25_sql(QUESTION_SQL, DOCS_SQL, part)}, {cosine_sql(QUESTION_SQL, VECS_SQL, part)},
      b AS (SELECT qid, id, rank FROM {top_sql('bm', depth)}), v AS (SELECT qid, id, rank FROM {near_sql(depth)}),
      fu AS (SELECT qid, id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS rrf_score,
                    v.rank AS vector_rank, b.rank AS bm25_rank FROM v FULL JOIN b USING (qid, id))"""


@query("rrf_i4", f"WITH {fused_sql('machine', 20)} SELECT qid, id, rrf_score, coalesce(vector_rank, 0) AS vector_rank, coalesce(bm25_rank, 0) AS bm25_rank FROM fu")
def rrf_i4(t):
    q, d, v = questions(t), docs(t), vecs(t)
    lex = lexical.bm25_topk(q, "qid", "qtext", d, "id", "text", "machine", 20)
    near = vectors.vector_topk(q, "qid", "qvec", v, "id", "vec", 20, "machine")
    fused = fusion.rrf({"vector": near, "bm25": lex.withColumnRenamed("bm25_rank", "rank")})
    zero = F.lit(0)
    return fused.select(
        "qid", "id", "rrf_score", F.coalesce("vector_rank", zero).alias("vector_rank"), F.coalesce("bm25_rank", zero).alias("bm25_rank")
    )


KEY_SQL = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"
BEST = "rrf_score DESC, id"


def hybrid_tail(k: int) -> str:
    first = top_sql(f"(SELECT fu.*, {KEY_SQL} AS ck FROM fu JOIN documents ON doc_id = id)", 1, "qid, ck", BEST, "r1")
    return top_sql(first, k, "qid", BEST)


@query("hybrid_i5", f"WITH {fused_sql('machine', 20)} SELECT qid, id, rrf_score, rank FROM {hybrid_tail(5)}")
def hybrid_i5(t):
    return fusion.hybrid(questions(t), docs(t), vecs(t), 5, "machine").select("qid", "id", "rrf_score", "rank")


CONTAINER_DOCS = f"(SELECT *, machine || '/' || CASE WHEN id % 3 = 0 THEN 'ladder' ELSE 'documents' END AS mc FROM {DOCS_SQL})"
CONTAINER_VECS = f"(SELECT *, machine || '/' || CASE WHEN id % 3 = 0 THEN 'ladder' ELSE 'documents' END AS mc FROM {VECS_SQL})"
CONTAINER_Q = f"(SELECT g || '/' || qid AS qid, qtext, qvec, machine || '/' || g AS mc FROM {QUESTION_SQL}, (VALUES ('ladder'), ('documents')) x(g))"


@query(
    "hybrid_by_container_i6",
    f"""WITH {bm25_sql(CONTAINER_Q, CONTAINER_DOCS, 'mc')}, {cosine_sql(CONTAINER_Q, CONTAINER_VECS, 'mc')},
      b AS (SELECT qid, id, rank FROM {top_sql('bm', 20)}), v AS (SELECT qid, id, rank FROM {near_sql(20)}),
      fu AS (SELECT qid, id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS rrf_score FROM v FULL JOIN b USING (qid, id))
      SELECT split_part(qid, '/', 1) AS container, CAST(split_part(qid, '/', 2) AS BIGINT) AS qid, id, rrf_score, rank FROM {hybrid_tail(5)}""",
)
def hybrid_by_container_i6(t):
    container = F.when(F.col("id") % 3 == 0, "ladder").otherwise("documents")
    d, v = docs(t).withColumn("container", container), vecs(t).withColumn("container", container)
    hits = fusion.hybrid(questions(t), d, v, 5, "machine", "container")
    return hits.select(F.col("qid.grp").alias("container"), F.col("qid.qid").alias("qid"), "id", "rrf_score", "rank")


POOL = "CASE WHEN id % 2 = 0 THEN 'factory_history' ELSE 'company_knowledge' END"
POOL_DOCS = f"(SELECT *, {POOL} AS pool FROM {DOCS_SQL})"
POOL_VECS = f"(SELECT *, {POOL} AS pool FROM {VECS_SQL} WHERE doc IS NOT NULL)"  # a vector without a document is no case
POOL_Q = f"(SELECT p || '/' || qid AS qid, qtext, qvec, p AS pool, machine FROM {QUESTION_SQL}, (VALUES ('factory_history'), ('company_knowledge')) x(p))"


@query(
    "case_search_i7",
    f"""WITH {bm25_sql(POOL_Q, POOL_DOCS, 'pool', keep_zero=False)}, {cosine_sql(POOL_Q, POOL_VECS, 'pool')},
      b AS (SELECT qid, id, rank FROM {top_sql('bm', 30)}), v AS (SELECT qid, id, rank FROM {near_sql(30)}),
      fu AS (SELECT qid, id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS rrf_score FROM v FULL JOIN b USING (qid, id)),
      sim AS (SELECT q.qid, pool, id, round(list_dot_product(q.qvec, v.vec), 6) AS similarity, rrf_score, q.machine = v.machine AS same_machine
              FROM fu JOIN {POOL_Q} q USING (qid) JOIN {VECS_SQL} v USING (id)),
      ok AS (SELECT *, round(rrf_score + CASE WHEN same_machine THEN 0.005 ELSE 0 END, 9) AS score FROM sim WHERE similarity >= 0.05)
      SELECT CAST(split_part(qid, '/', 2) AS BIGINT) AS qid, pool, id, similarity, score, same_machine, rank FROM {top_sql('ok', 3)}""",
)
def case_search_i7(t):
    pool = F.when(F.col("id") % 2 == 0, "factory_history").otherwise("company_knowledge")
    return fusion.case_search(
        questions(t), docs(t).withColumn("pool", pool), vecs(t).select("id", "vec"), 6, "pool", min_similarity=0.05
    )


@query(
    "pool_topk_g2",
    f"WITH {BM_ALL} SELECT qid, machine, id, score, rank FROM {top_sql(f'(SELECT bm.*, d.machine FROM bm JOIN {DOCS_SQL} d USING (id))', 3, 'qid, machine')}",
)
def pool_topk_g2(t):
    scores = lexical.bm25_scores(questions(t), "qid", "qtext", docs(t), "id", "text", k=3, group="machine")
    pooled = docs(t).select("id", "machine").join(small(scores), "id")
    zero = _zero_fill(t, pooled)
    return topk(zero, ["qid", "machine"], [F.col("score").desc(), F.col("id")], 3).select("qid", "machine", "id", "score", "rank")


def _zero_fill(t, pooled):
    """Pools in which a question matches fewer than 3 documents take the smallest other ids at score 0."""
    d = docs(t).select("id", "machine", "part")
    first = topk(d, ["machine"], [F.col("id")], 6, "__r").drop("__r")
    filler = questions(t).select("qid", "part").join(first, "part").drop("part")
    held = topk(pooled, ["qid", "machine"], [F.col("score").desc(), F.col("id")], 3, "__r").select("qid", "machine", "id", "score")
    return held.unionByName(
        filler.join(held, ["qid", "machine", "id"], "left_anti").join(pooled.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
    )


@query(
    "distinct_page_topk_g3",
    f"WITH {fused_sql('machine', 20)}, p AS (SELECT fu.*, doc, page FROM fu JOIN {DOCS_SQL} d USING (id)) "
    f"SELECT qid, doc, page, id, rank FROM {top_sql(top_sql('p', 1, 'qid, doc, page', BEST, 'r1'), 5, 'qid', BEST)}",
)
def distinct_page_topk_g3(t):
    q, d, v = questions(t), docs(t), vecs(t)
    lex = lexical.bm25_topk(q, "qid", "qtext", d, "id", "text", "machine", 20)
    near = vectors.vector_topk(q, "qid", "qvec", v, "id", "vec", 20, "machine")
    fused = fusion.rrf({"vector": near, "bm25": lex.withColumnRenamed("bm25_rank", "rank")})
    paged = d.select("id", "doc", "page").join(small(cut_lineage(fused)), "id")
    best = fusion.best_first()
    return topk(first_per_key(paged, ["qid", "doc", "page"], best), ["qid"], best, 5).select("qid", "doc", "page", "id", "rank")


@query(
    "dedup_content_f2",
    r"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY n_chars DESC, doc_id) AS r
        FROM documents) WHERE r = 1""",
)
def dedup_content_f2(t):
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    return fusion.dedup_content(t.documents, "text", order, keys=()).select("doc_id")


PATCH_Q = f"(SELECT label % 3 AS qid, label AS token, cvec AS qvec FROM {CENTROID_SQL})"
MAXSIM_SQL = f"""ms AS (SELECT qid, page, round(sum(best), 6) AS score FROM (
    SELECT qid, token, label AS page, max(list_dot_product(qvec, CAST(embedding AS DOUBLE[]))) AS best FROM embeddings, {PATCH_Q} GROUP BY ALL) GROUP BY ALL)"""


def page_scores(t):
    q = centroids(t).select((F.col("label") % 3).alias("qid"), F.col("label").alias("token"), F.col("cvec").alias("qvec"))
    return vectors.maxsim(q, "qid", "token", "qvec", t.embeddings, "label", "embedding")


@query("maxsim_i8", f"WITH {MAXSIM_SQL} SELECT qid, page, score FROM ms")
def maxsim_i8(t):
    return page_scores(t)


@query(
    "page_search_i9",
    f"""WITH {MAXSIM_SQL}, tx AS (SELECT label AS page, string_agg(DISTINCT doc, ' ' ORDER BY doc) AS text FROM {VECS_SQL} GROUP BY label HAVING count(doc) > 0)
      SELECT qid, page, score, rank, coalesce(text, '') AS text FROM {top_sql('ms', 4, 'qid', 'score DESC, page')} LEFT JOIN tx USING (page)""",
)
def page_search_i9(t):
    """The text of a page is the list of the sources of its vectors' documents."""
    held = vecs(t).filter("doc IS NOT NULL").groupBy(F.col("label").alias("page")).agg(F.array_sort(F.collect_set("doc")).alias("d"))
    return pages.page_search(page_scores(t), held.select("page", F.array_join("d", " ").alias("text")), 4)


@query(
    "expand_pages_i10",
    f"""WITH sz AS (SELECT doc, page, sum(length(text)) AS n FROM {DOCS_SQL} GROUP BY ALL),
      pg AS (SELECT doc, page, string_agg(text, chr(10) || chr(10) ORDER BY id) AS body FROM {DOCS_SQL} JOIN sz USING (doc, page) WHERE n <= 6000 AND trim(text) <> '' GROUP BY ALL),
      h AS (SELECT machine AS qid, id, doc, page, text FROM {DOCS_SQL})
      SELECT qid, doc, page, min(id) AS id, 'page' AS scope, md5(any_value(body)) AS text FROM h JOIN pg USING (doc, page) GROUP BY qid, doc, page
      UNION ALL SELECT qid, doc, page, id, 'hit', md5(text) FROM h ANTI JOIN pg USING (doc, page)""",
)
def expand_pages_i10(t):
    d = docs(t)
    hits = d.select(F.col("machine").alias("qid"), "id", "doc", "page", "text", F.col("id").alias("rank"))
    blocks = d.select("doc", "page", F.col("id").alias("position"), "text")
    return pages.expand_pages(hits, blocks).select("qid", "doc", "page", "id", "scope", F.md5("text").alias("text"))


@query(
    "nearby_figures_i11",
    """WITH fig AS (SELECT l_suppkey AS doc, l_partkey AS page, 'img/' || (l_orderkey % 50) AS path FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
      h AS (SELECT l_orderkey AS qid, l_suppkey AS doc, l_partkey AS page, min(l_linenumber) AS rank FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
      shown AS (SELECT DISTINCT l_orderkey AS qid, 'img/' || (l_partkey % 50) AS path FROM lineitem),
      j AS (SELECT qid, rank, fig.doc, fig.page, path FROM h JOIN fig ON fig.doc = h.doc AND fig.page IN (h.page, h.page + 1) ANTI JOIN shown USING (qid, path)),
      one AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY qid, path ORDER BY rank, page, doc) = 1)
      SELECT qid, CAST(row_number() OVER w AS INT) AS figure_no, doc, page, path FROM one WINDOW w AS (PARTITION BY qid ORDER BY rank, page, path, doc) QUALIFY row_number() OVER w <= 5""",
)
def nearby_figures_i11(t):
    picture = lambda c: F.concat(F.lit("img/"), (F.col(c) % 50).cast("string")).alias("path")
    figures = t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("page"), picture("l_orderkey"), F.col("l_shipdate").cast("string").alias("caption"))
    hits = t.lineitem.filter("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("page"), F.col("l_linenumber").alias("rank"))
    shown = t.lineitem.select(F.col("l_orderkey").alias("qid"), picture("l_partkey"))
    return pages.nearby_figures(hits, figures, already=shown).select("qid", "figure_no", "doc", "page", "path")


SHINGLES = r"""(SELECT {k}, unnest(list_distinct(list_transform(range(1, CAST(length(c) AS BIGINT) - 6), lambda i: substr(c, i, 8)))) AS piece
    FROM (SELECT {k}, regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', '', 'g') AS c FROM {rel}))"""


@query(
    "evidence_page_i12",
    f"""WITH c AS {SHINGLES.format(k="item_id AS cid, 'src' || (item_id % 20) AS doc", text='text', rel='benchmark').replace("SELECT item_id AS cid, 'src' || (item_id % 20) AS doc, unnest", "SELECT cid, doc, unnest")},
      p AS {SHINGLES.format(k='doc_id, source', text='text', rel='documents')},
      o AS (SELECT cid, doc_id AS page, count(*) AS overlap FROM c JOIN p ON p.source = c.doc AND p.piece = c.piece GROUP BY ALL),
      b AS (SELECT * FROM o JOIN (SELECT cid, max(overlap) AS overlap FROM o GROUP BY cid) USING (cid, overlap))
      SELECT cid, min(page) AS page, any_value(overlap) AS overlap FROM b GROUP BY cid HAVING count(*) = 1""",
)
def evidence_page_i12(t):
    candidates = t.benchmark.select(
        F.col("item_id").alias("cid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc"),
        F.lit(0).alias("first"), F.lit(2**62).alias("last"), F.col("text").alias("excerpt"),
    )
    held = t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return pages.evidence_page(candidates, held)


NORM = r"trim(regexp_replace(lower({0}), '[^0-9a-z가-힣]+', ' ', 'g'))"


@query(
    "highlight_i13",
    f"""WITH w AS (SELECT item_id AS pid, unnest(CASE WHEN n <= 18 THEN [plain] ELSE list_distinct(list_transform(list_concat(range(0, n - 17, 9), [n - 18]),
            lambda s: array_to_string(w[s + 1:s + 18], ' '))) END) AS win FROM (SELECT item_id, plain, string_split(plain, ' ') AS w, len(string_split(plain, ' ')) AS n
            FROM (SELECT item_id, {NORM.format('text')} AS plain FROM benchmark)) WHERE plain <> ''),
      it AS (SELECT page, pos, x FROM (SELECT page, pos, {NORM.format('x')} AS x FROM (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS x,
            unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)) WHERE x <> ''),
      sp AS (SELECT page, pos, e - length(x) - 1 AS a, e - 1 AS b FROM (SELECT *, sum(length(x) + 1) OVER (PARTITION BY page ORDER BY pos) AS e FROM it)),
      pt AS (SELECT page, string_agg(x, ' ' ORDER BY pos) AS body FROM it GROUP BY page),
      hit AS (SELECT DISTINCT page, pid, instr(body, win) - 1 AS s, instr(body, win) - 1 + length(win) AS e FROM pt JOIN w ON contains(body, win))
      SELECT DISTINCT pid, page, CAST(pos AS INT) AS pos FROM hit JOIN sp USING (page) WHERE a < e AND b > s""",
)
def highlight_i13(t):
    items = t.documents.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return pages.highlight(items, t.benchmark.select(F.col("item_id").alias("pid"), "text"))


def tfidf_sql(terms: str, q: str, d: str, corpus: str | None = None) -> str:
    """CTEs ending in ti(qid, id, score); ``terms`` maps {0} (a text) to a list of terms, ``corpus`` gives their frequencies."""
    corpus = corpus or d
    return rf"""dtf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms.format('text')}) AS term FROM {d}) GROUP BY ALL),
      idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {corpus})) / (1 + count(*))) + 1 AS idf
        FROM (SELECT DISTINCT id, term FROM (SELECT id, unnest({terms.format('text')}) AS term FROM {corpus})) GROUP BY term),
      dw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM dtf JOIN idf USING (term)), dn AS (SELECT id, sqrt(sum(w * w)) AS len FROM dw GROUP BY id),
      qw AS (SELECT qid, term, (1 + ln(tf)) * idf AS qw FROM (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({terms.format('qtext')}) AS term FROM {q}) GROUP BY ALL) JOIN idf USING (term)),
      qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qlen FROM qw GROUP BY qid),
      ti AS (SELECT qid, id, round(dot / (len * qlen), 6) AS score FROM (SELECT qid, id, sum(w * qw) AS dot FROM dw JOIN qw USING (term) GROUP BY ALL) JOIN dn USING (id) JOIN qn USING (qid))"""


STOPS = "[" + ", ".join(f"'{w}'" for w in lexical.STOP_WORDS) + "]"
WORDS_SQL = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains(" + STOPS + ", w))"
TFIDF_WORDS = tfidf_sql(WORDS_SQL, QUESTION_SQL, DOCS_SQL)


@query("tfidf_words_i14", f"WITH {TFIDF_WORDS} SELECT qid, id, score, rank FROM {top_sql('ti', 5)}")
def tfidf_words_i14(t):
    return lexical.tfidf_topk(questions(t), "qid", "qtext", docs(t), "id", "text", 5)


GRAM_Q = "(SELECT p_partkey AS qid, p_type AS qtext FROM part)"
GRAM_D = "(SELECT s_suppkey AS id, s_name || ' ' || n_name || ' ' || r_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
GRAMS_SQL = "list_concat(" + ", ".join(
    f"list_transform(range(1, CAST(length({{0}}) AS BIGINT) - {n - 2}), lambda i: substr(lower({{0}}), i, {n}))" for n in (2, 3, 4)
) + ")"


@query("tfidf_grams_i14b", f"WITH {tfidf_sql(GRAMS_SQL, GRAM_Q, GRAM_D)} SELECT qid, id, score, rank FROM {top_sql('ti', 3)}")
def tfidf_grams_i14b(t):
    d = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", "s_name", "n_name", "r_name").alias("text"))
    )
    q = t.part.select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("qtext"))
    return lexical.tfidf_topk(q, "qid", "qtext", d, "id", "text", 3, lexical.gram_terms())


SCORED_SQL = """(SELECT doc_id, text, CAST(n_chars AS DOUBLE) / 100000 AS score, CASE WHEN contains(text, '|') THEN 'table' ELSE 'passage' END AS kind FROM documents)"""
THE = "(^|[^a-z0-9])the($|[^a-z0-9])"
FIRST_THE = "length(regexp_extract(lower(text), '(?s)^(.*?(?:^|[^#a-z0-9]))the(?:$|[^a-z0-9])', 1))"


def scored(t):
    kind = F.when(F.contains("text", F.lit("|")), "table").otherwise("passage")
    return t.documents.select("doc_id", "text", (F.col("n_chars").cast("double") / 100000).alias("score"), kind.alias("kind"))


def shown(rows, *keys):
    return rows.select(*keys, F.round("score", 6).alias("score"), F.md5("excerpt").alias("excerpt"))


@query(
    "boost_code_i15",
    rf"""SELECT doc_id, CASE WHEN hit THEN round(score + 1, 6) ELSE 0.0 END AS score, CASE WHEN hit THEN md5(CASE WHEN kind = 'table'
            THEN substr(array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(lower(l), '(^|[^#a-z0-9])the($|[^a-z0-9])')), chr(10)), 1, 1100)
            ELSE substr(text, greatest(pos - 159, 1), 1100) END) END AS excerpt
        FROM (SELECT *, regexp_matches(lower(text), '(^|[^#a-z0-9])the($|[^a-z0-9])') AS hit, {FIRST_THE} AS pos FROM {SCORED_SQL})""",
)
def boost_code_i15(t):
    return shown(evidence.boost_code(scored(t), "the"), "doc_id")


ALARM_SQL = """(SELECT event_id, CAST(value AS DOUBLE) AS score, event_type || repeat(' ' || event_type, user_id % 40) ||
    CASE WHEN event_type = 'error' THEN ' alarm' ELSE '' END || repeat(' ' || user_id, event_id % 40) || ' AL' || json_extract_string(props, '$.k') || '.' AS text FROM events)"""


@query(
    "boost_alarm_code_i15e",
    f"""SELECT event_id, CASE WHEN hit THEN round(score + 1, 6) ELSE 0.0 END AS score, CASE WHEN hit THEN md5(substr(text, greatest(pos - 159, 1), 1100)) END AS excerpt
        FROM (SELECT *, pos >= 0 AND contains(substr(text, greatest(pos - 119, 1), pos + 4 + 120 - greatest(pos - 120, 0)), 'alarm') AS hit
          FROM (SELECT *, CASE WHEN regexp_matches(text, ' AL42[.]') THEN instr(text, ' AL42.') ELSE -1 END AS pos FROM {ALARM_SQL}))""",
)
def boost_alarm_code_i15e(t):
    """Alarm messages of uneven length: the code counts only beside the word alarm."""
    many = lambda c, n: F.repeat(F.concat(F.lit(" "), F.col(c).cast("string")), n.cast("int"))
    text = F.concat(
        "event_type", many("event_type", F.col("user_id") % 40), F.when(F.col("event_type") == "error", " alarm").otherwise(""),
        many("user_id", F.col("event_id") % 40), F.lit(" AL"), F.get_json_object("props", "$.k"), F.lit("."))
    rows = t.events.select("event_id", F.col("value").cast("double").alias("score"), text.alias("text"), F.lit("passage").alias("kind"))
    return shown(evidence.boost_code(rows, "AL42", needs_alarm_word=True), "event_id")


SECTIONED_SQL = rf"""(SELECT doc_id, score, regexp_replace(text, '([.!?]) ', '\1' || chr(10) || '① ', 'g') AS text FROM {SCORED_SQL})"""


@query(
    "boost_terms_i15b",
    rf"""WITH d AS {SECTIONED_SQL},
      ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
      lo AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS off FROM ln),
      tk AS (SELECT doc_id, k, line, off, unnest(tk) AS tok, unnest(range(len(tk))) AS i FROM (SELECT *, regexp_extract_all(lower(line), '[a-z0-9]+|[^a-z0-9]+') AS tk FROM lo)),
      pl AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(tok) AS spot FROM tk),
      th AS (SELECT doc_id, k, off + spot AS spot, regexp_matches(lower(substr(line, CAST(greatest(spot - 100, 0) AS BIGINT) + 1, CAST(spot + 103 - greatest(spot - 100, 0) AS BIGINT))), '(^|[^a-z0-9])of($|[^a-z0-9])') AS near
             FROM pl WHERE tok = 'the'),
      m AS (SELECT doc_id, bool_or(near) AS near, coalesce(min(spot) FILTER (near), min(spot)) AS spot FROM th GROUP BY doc_id),
      b AS (SELECT doc_id, max(off) FILTER (off <= spot) AS low, min(off) FILTER (off > spot) AS high FROM lo JOIN m USING (doc_id) WHERE starts_with(ltrim(line), '①') GROUP BY doc_id, spot),
      e AS (SELECT d.*, near, spot, greatest(spot - 200, coalesce(low, 0), 0) AS low, coalesce(high, length(text)) AS high FROM d LEFT JOIN m USING (doc_id) LEFT JOIN b USING (doc_id))
      SELECT doc_id, CASE WHEN spot IS NULL THEN 0.0 ELSE round(score + 1 + CAST(near AS INT), 6) END AS score,
        CASE WHEN spot IS NOT NULL THEN md5(substr(text, CAST(low AS BIGINT) + 1, CAST(least(1100, high - low) AS BIGINT))) END AS excerpt FROM e""",
)
def boost_terms_i15b(t):
    """Sentences stand for the numbered sections of a page."""
    rows = scored(t).withColumn("text", F.regexp_replace("text", r"([.!?]) ", "$1\n① "))
    return shown(evidence.boost_terms(rows, ["the"], ["of"]), "doc_id")


FAULT_WORDS = evidence.WORDING._replace(steps="er", check=r"\Qing\E", operate="ation", caution="an|check")
HITS_SQL = f"""(SELECT qid, id, score, qtext, text, doc AS label,
    list_transform(list_filter(string_split(text, chr(10)), lambda l: contains(l, '|')), lambda l: list_transform(string_split(l, '|'), lambda c: trim(c))) AS grid
    FROM {top_sql('bm', 20)} JOIN {DOCS_SQL} USING (id) JOIN {QUESTION_SQL} USING (qid))"""


@query(
    "boost_action_i15c",
    rf"""WITH {BM_ALL}, a AS (SELECT *, regexp_extract(qtext, '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-z]+(?:[ \t]+[A-Za-z]+){{2,}})(?:$|[^\p{{L}}\p{{N}}_])', 1) AS msg, string_split(text, chr(10)) AS ls FROM {HITS_SQL}),
      b AS (SELECT *, msg <> '' AND regexp_matches(lower(text), regexp_replace(lower(msg), '[ \t]+', '\\s+', 'g')) AS named, len(grid) > 0 AS tab,
        CASE WHEN regexp_matches(lower(text), '{THE}') THEN length(regexp_extract(lower(text), '(?s)^(.*?(?:^|[^a-z0-9]))the(?:$|[^a-z0-9])', 1)) END AS first FROM a),
      c AS (SELECT *, CASE WHEN named THEN length(regexp_extract(lower(text), '(?s)^(.*?)' || regexp_replace(lower(msg), '[ \t]+', '\\s+', 'g'), 1)) ELSE first END AS spot,
        tab AND regexp_matches(lower(ls[1]), 'er') AS steps,
        list_filter(flatten(list_transform(range(1, least(3, len(grid)) + 1), lambda i: list_transform(range(2, len(grid[i]) + 1), lambda j: {{'i': i, 'j': j}}))),
          lambda h: lower(grid[h.i][h.j]) = 'the' AND h.i < len(grid))[1] AS head,
        CASE WHEN NOT tab THEN list_filter(ls, lambda l: regexp_matches(lower(l), '{THE}') AND contains(lower(l), 'ing'))[1] END AS line,
        CASE WHEN NOT tab THEN list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n'), lambda l: regexp_matches(lower(l), '{THE}') AND contains(lower(l), 'ation'))[1] END AS sentence,
        list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^\s*\d+\s*\|')) AS nums FROM b),
      d AS (SELECT *, steps AND len(list_filter(grid[2:3], lambda r: len(r) > 1 AND regexp_matches(lower(r[2]), '^the($|[^a-z0-9])'))) > 0 AS proc,
        coalesce(list_filter(range(1, len(grid[head.i]) + 1), lambda j: grid[head.i][j] <> grid[head.i][1])[1] - 1, head.j - 1) AS nlab,
        list_filter(nums, lambda i: contains(lower(ls[i]), lower(msg)))[1] AS mine FROM c),
      e AS (SELECT *, CASE WHEN head IS NOT NULL THEN array_to_string(list_concat([grid[head.i][head.j]], list_transform(grid[head.i + 1:],
          lambda r: array_to_string(list_filter(r[1:nlab], lambda x, k: list_position(r, x) = k), ' · ') || ' | ' || r[head.j])), chr(10)) END AS col,
        CASE WHEN steps THEN 0 ELSE greatest(spot - 160, 0) END AS low,
        CASE WHEN named AND tab AND mine IS NOT NULL THEN array_to_string(ls[mine : coalesce(list_filter(nums, lambda i: i > mine)[1] - 1, len(ls))], chr(10)) END AS rws FROM d),
      f AS (SELECT *, coalesce(col, CASE WHEN proc THEN text END, substr(text, CAST(low AS BIGINT) + 1, 1400)) AS part FROM e),
      g AS (SELECT *, spot IS NOT NULL AS found, col IS NULL AND NOT steps AND regexp_matches(part, '\.{{3,}}\s*\d+') AS toc FROM f)
      SELECT qid, id, round(CASE WHEN NOT found THEN score WHEN toc THEN 0.0 ELSE score + CASE WHEN named THEN 4.0 ELSE 0 END
          + CASE WHEN sentence IS NOT NULL OR col IS NOT NULL OR proc OR line IS NOT NULL THEN 2.0 WHEN regexp_matches(lower(part), 'an|check') THEN 0.18 ELSE 0 END END, 6) AS score,
        CASE WHEN found AND NOT toc THEN CASE WHEN sentence IS NOT NULL THEN 'operation_detail' WHEN col IS NOT NULL THEN 'comparison' WHEN proc THEN 'steps'
          WHEN line IS NOT NULL THEN 'precaution' WHEN rws IS NOT NULL THEN 'message' END END AS evidence,
        CASE WHEN found AND NOT toc THEN md5(coalesce(sentence, label || chr(10) || line, rws, label || chr(10) || part)) END AS excerpt FROM g"""
)
def boost_action_i15c(t):
    """The 20 best passages of each question; lines with bars are the rows of their tables."""
    d = docs(t)
    top = lexical.bm25_topk(questions(t), "qid", "qtext", d, "id", "text", None, 20).drop("bm25_rank")
    cells = F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.transform(F.split(x, r"\|"), F.trim))
    rows = d.join(small(top), "id").select(*top.columns, "text", F.col("doc").alias("label"), cells.alias("grid")).join(
        questions(t).select("qid", F.col("qtext").alias("question")), "qid")
    return shown(evidence.boost_action(rows, ["the"], FAULT_WORDS), "qid", "id", "evidence")


INCIDENT_WORDS = evidence.WORDING._replace(condition=term_pattern(["the"]), action=term_pattern(["was", "hed"]))
PASSAGE_SQL = "(SELECT doc_id AS id, text FROM documents)"
TFIDF_BLOCKS = tfidf_sql(WORDS_SQL, QUESTION_SQL, "bd", PASSAGE_SQL)


@query(
    "general_incident_i15d",
    rf"""WITH ln AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM {SCORED_SQL} WHERE kind = 'passage'),
      bl AS (SELECT id, list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN regexp_matches(lower(ls[i]), '{THE}') AND regexp_matches(lower(ls[i]), '(^|[^a-z0-9])(was|hed)($|[^a-z0-9])')
          THEN ls[i] || CASE WHEN i < len(ls) AND NOT regexp_matches(ls[i], '[.!?。]\s*$') THEN ' ' || ls[i + 1] ELSE '' END END), lambda x: x IS NOT NULL) AS b FROM ln),
      bd AS (SELECT id, array_to_string(b, chr(10)) AS text FROM bl WHERE len(b) > 0), {TFIDF_BLOCKS}
      SELECT qid, id, score, md5(substr(text, 1, 1100)) AS excerpt FROM ti JOIN bd USING (id)""",
)
def general_incident_i15d(t):
    passages = scored(t).withColumnRenamed("doc_id", "id")
    out = evidence.general_incident(passages, questions(t), wording=INCIDENT_WORDS)
    return shown(out, "qid", "id")


@query("item_coverage_i16")
def item_coverage_i16(t):
    items = {"first": ["the"], "second": ["of", "and"], "third": ["der"]}
    return pages.item_coverage(scored(t), "doc_id", "text", "score", items, ["on", "die"])


ASKED_SQL = f"""(SELECT *, qid % 4 = 1 AS is_p, qid % 4 = 2 AS is_o, qid % 4 = 3 AS is_m FROM {QUESTION_SQL})"""
IN_P, IN_O = "CAST(substr(doc, 4) AS INT) % 6 = 0", "CAST(substr(doc, 4) AS INT) % 6 = 1"
SCOPE_Q = f"""(SELECT * FROM (SELECT qid, qtext, qvec, machine, is_m AS fallback,
    CASE WHEN is_p THEN machine || '/p' WHEN is_o THEN machine || '/o' ELSE machine END AS sc FROM {ASKED_SQL}))"""
scoped_rows = lambda rel: (
    f"(SELECT *, machine || '/p' AS sc FROM {rel} WHERE {IN_P} UNION ALL SELECT *, machine || '/o' FROM {rel} WHERE {IN_O} UNION ALL SELECT *, machine FROM {rel})")


@query(
    "scoped_search_i17",
    f"""WITH {bm25_sql(SCOPE_Q, scoped_rows(DOCS_SQL), 'sc')}, {cosine_sql(SCOPE_Q, scoped_rows(VECS_SQL), 'sc')},
      b AS (SELECT qid, id, rank FROM {top_sql('bm', 20)}), v AS (SELECT qid, id, rank FROM {near_sql(20)}),
      fu AS (SELECT qid, id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS rrf_score FROM v FULL JOIN b USING (qid, id))
      SELECT qid, id, rrf_score, rank, fallback FROM {hybrid_tail(5)} JOIN (SELECT qid, fallback FROM {SCOPE_Q}) USING (qid)""",
)
def scoped_search_i17(t):
    """Questions in turn ask for controller parameters, operation or maintenance, or for no manual; sources are manuals, those for maintenance were never indexed."""
    q, d, v = questions(t), docs(t), vecs(t)
    asks = F.get(F.array(F.lit("뜻"), F.lit("parameter"), F.lit("조작"), F.lit("보수 매뉴얼")), (F.col("qid") % 4).cast("int"))
    number = F.substring("source", 4, 9).cast("int") % 6
    kinds = t.documents.select("source", number.alias("n")).distinct()
    manuals = kinds.select(
        F.when(F.col("n") % 2 == 0, "controller").otherwise("manual").alias("doc_group"),
        F.get(F.array(F.lit("parameter"), F.lit("operation"), F.lit("maintenance")), F.col("n") % 3).alias("manual_type"),
        F.when(F.col("n") % 3 == 2, F.concat(F.lit("old-"), "source")).otherwise(F.col("source")).alias("filename"))
    routed = catalog.route_manual(q.select("qid", asks.alias("ask")), "ask", manuals)
    return fusion.scoped_hybrid(q, d, v, routed.select("qid", F.col("filename").alias("doc")), 5, "machine")


@query(
    "supporting_evidence_i19",
    f"""WITH {BM_ALL}, h AS (SELECT qid, id, rank, text, CASE WHEN id % 7 = 0 THEN 'tables' ELSE 'texts' END AS kind,
             CASE WHEN id % 5 = 0 THEN 'Electrical ' || doc ELSE doc END AS doc FROM {top_sql('bm', 20)} JOIN {DOCS_SQL} USING (id))
       SELECT qid, evidence_no, id, doc, md5(substr(text, 1, 1800)) AS text FROM
         {top_sql("(SELECT * FROM h WHERE trim(text) <> '' AND kind = 'texts' AND NOT starts_with(doc, 'Electrical') AND doc <> 'src3')", 3, 'qid', 'rank, id', 'evidence_no')}""",
)
def supporting_evidence_i19(t):
    top = lexical.bm25_topk(questions(t), "qid", "qtext", docs(t), "id", "text", None, 20)
    d = docs(t).select("id", "text", "doc")
    name = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Electrical "), F.col("doc"))).otherwise(F.col("doc"))
    hits = d.join(small(top), "id").select(
        "qid", "id", name.alias("doc"), F.when(F.col("id") % 7 == 0, "tables").otherwise("texts").alias("kind"), "text",
        F.col("bm25_rank").alias("rank"),
    )
    linked = t.documents.select(F.col("source").alias("doc")).filter("doc <> 'src3'")
    return pages.supporting_evidence(hits, linked, 3).withColumn("text", F.md5("text"))


@query(
    "answer_sources_i20",
    f"""WITH {BM_ALL}, h AS (SELECT qid, id, rank, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS corpus, CASE WHEN id % 3 = 0 THEN 'table' ELSE 'passage' END AS kind,
            CASE WHEN id % 3 = 0 THEN 'cap ' || doc || chr(10) || 'k | v' || chr(10) || text ELSE text END AS body FROM {top_sql('bm', 5)} JOIN {DOCS_SQL} USING (id))
       SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY corpus, rank) AS INT) AS source_no, corpus, kind,
         md5(CASE WHEN length(c) <= 700 THEN c ELSE regexp_replace(CASE WHEN p > 0 AND 700 - p >= 350 THEN substr(c, 1, 700 - p) ELSE substr(c, 1, 700) END, '\\s+$', '') || chr(10) || '[이하 생략]' END) AS content
       FROM (SELECT *, instr(reverse(substr(c, 1, 700)), chr(10)) AS p FROM (SELECT *, trim(body) AS c FROM h)) WHERE c <> ''""",
)
def answer_sources_i20(t):
    top = lexical.bm25_topk(questions(t), "qid", "qtext", docs(t), "id", "text", None, 5)
    hits = docs(t).select("id", "text", "doc").join(small(top), "id").select(
        "qid", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("corpus"), F.col("bm25_rank").alias("rank"),
        F.when(F.col("id") % 3 == 0, "table").otherwise("passage").alias("kind"), "text",
        F.concat(F.lit("cap "), F.col("doc")).alias("caption"), F.lit("k | v").alias("header"), F.col("text").alias("rows"),
    )
    return pages.answer_sources(hits).withColumn("content", F.md5("content"))
