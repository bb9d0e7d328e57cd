"""Bindings of the quality rules and grounding checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import doc_key
from ..operators import audit
from ..sources.readers import hash_mismatch
from .registry import query


@query(
    "assert_invariants_n1",
    """SELECT 'unique id' AS rule, CAST(i AS VARCHAR) AS item FROM (SELECT CASE WHEN doc_id % 100 = 1 THEN doc_id - 1 ELSE doc_id END AS i FROM documents) GROUP BY i HAVING count(*) > 1
       UNION ALL SELECT 'one type', source FROM documents GROUP BY source HAVING min(doc_id % 2) <> max(doc_id % 2)
       UNION ALL SELECT DISTINCT 'registered', source FROM documents WHERE source IN ('src1', 'src2')
       UNION ALL SELECT DISTINCT 'vector', CAST(CASE WHEN doc_id % 100 = 1 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) FROM documents WHERE CASE WHEN doc_id % 100 = 1 THEN doc_id - 1 ELSE doc_id END NOT IN (SELECT vec_id FROM embeddings)
       UNION ALL SELECT DISTINCT 'factory', lang FROM documents WHERE lang NOT IN ('en', 'de')""",
)
def assert_invariants_n1(t):
    d = F.col("doc_id")
    chunks = t.documents.select(
        F.when(d % 100 == 1, d - 1).otherwise(d).alias("id"), doc_key(F.col("source")).alias("doc_key"),
        F.when(d % 2 == 0, "manual").otherwise("controller").alias("document_type"), F.col("lang").alias("factory"),
    )
    catalog = chunks.select("doc_key").distinct().filter("doc_key not in ('src1', 'src2')")
    return audit.assert_invariants(chunks, catalog, t.embeddings.select(F.col("vec_id").alias("id")), ["en", "de"])


@query(
    "verify_quotes_n2",
    r"""WITH c AS (SELECT doc_id AS claim, doc_id AS source, CASE WHEN doc_id % 2 = 0 THEN substr(d.text, 3, 40) ELSE b.text END AS quote, d.text FROM documents d JOIN benchmark b ON b.item_id = doc_id % (SELECT count(*) FROM benchmark))
        SELECT claim, source, trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS verified FROM c""",
)
def verify_quotes_n2(t):
    n = t.benchmark.agg(F.count("*").alias("n")).scalar()
    d = t.documents.withColumn("item_id", F.col("doc_id") % n).join(t.benchmark.select("item_id", F.col("text").alias("b")), "item_id")
    claims = d.select(F.col("doc_id").alias("claim"), F.col("doc_id").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 3, 40)).otherwise(F.col("b")).alias("quote"))
    return audit.verify_quotes(claims, t.documents.select(F.col("doc_id").alias("source"), "text"))


@query(
    "table_rows_cited_n3",
    r"""WITH r AS (SELECT doc_id AS source, lang, unnest(string_split(replace(text, ', ', ' | '), chr(10))) AS row FROM documents),
          h AS (SELECT source, row FROM r WHERE contains(row, '|') AND contains(trim(regexp_replace(row, '\s+', ' ', 'g')), lang || ' |'))
        SELECT source AS claim, source, min(trim(row)) AS row FROM h GROUP BY source HAVING count(*) = 1""",
)
def table_rows_cited_n3(t):
    sources = t.documents.select(F.col("doc_id").alias("source"), F.replace("text", F.lit(", "), F.lit(" | ")).alias("text"))
    claims = t.documents.select(F.col("doc_id").alias("claim"), F.col("doc_id").alias("source"), F.concat("lang", F.lit(" |")).alias("quote"))
    return audit.table_rows_cited(claims, sources)


@query(
    "condition_split_n4",
    """WITH c AS (SELECT item_id AS qid, item_id % 3 AS claim, 'a' AS label, substr(text, 5, 6) AS quote, text FROM benchmark UNION ALL SELECT item_id, item_id % 3, 'b', CASE WHEN item_id % 2 = 0 THEN 'on' ELSE 'zzz' END, text FROM benchmark),
         m AS (SELECT qid, claim, label, trim(quote) <> '' AND contains(text, quote) AS met FROM c)
       SELECT qid, claim, label, met, bool_and(met) OVER (PARTITION BY qid, claim) AS claim_stands FROM m""",
)
def condition_split_n4(t):
    pair = F.array(
        F.struct(F.lit("a").alias("label"), F.substring("text", 5, 6).alias("quote")),
        F.struct(F.lit("b").alias("label"), F.when(F.col("item_id") % 2 == 0, "on").otherwise("zzz").alias("quote")),
    )
    c = t.benchmark.select(F.col("item_id").alias("qid"), (F.col("item_id") % 3).alias("claim"), F.explode(pair).alias("x")).select("qid", "claim", "x.*")
    return audit.condition_split(c, t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question")))


@query(
    "unsupported_ids_n5",
    "SELECT p_partkey AS claim, 'cn' || p_size AS identifier FROM part WHERE p_size <> p_partkey % 50 UNION ALL SELECT p_partkey, 'x' || p_partkey || '.1' FROM part WHERE p_partkey % 3 = 0",
)
def unsupported_ids_n5(t):
    claims = t.part.select(F.col("p_partkey").alias("claim"), F.expr("'check CN' || p_size || ' and X' || p_partkey || '.1 now'").alias("text"))
    support = t.part.select(F.col("p_partkey").alias("claim"), F.expr("'see cn' || (p_partkey % 50) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' x' || p_partkey || '.1' END").alias("text"))
    return audit.unsupported_ids(claims, support)


@query(
    "citation_audit_n6",
    """WITH s AS (SELECT l_orderkey AS answer, l_linenumber AS source_no, CAST(max(1 + CAST(l_quantity AS BIGINT) % 3) AS BIGINT) AS n, min(CAST(round(l_extendedprice) AS BIGINT) % 5) AS c FROM lineitem GROUP BY ALL),
         o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY answer ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
       SELECT answer, CAST(source_no AS VARCHAR) AS item, 'no citation' AS problem FROM o WHERE c = 0
       UNION ALL SELECT answer, CAST(CAST(off + c AS BIGINT) AS VARCHAR), 'out of range' FROM o WHERE c > n GROUP BY 1, 2
       UNION ALL SELECT answer, CAST(source_no AS VARCHAR), 'never cited' FROM o WHERE c = 0 OR c > n""",
)
def citation_audit_n6(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("source_no")).agg(
        F.max(F.col("l_quantity").cast("bigint") % 3 + 1).alias("n_chunks"), F.min(F.round("l_extendedprice").cast("bigint") % 5).alias("c")
    )
    paragraphs = s.select("answer", F.col("source_no").alias("para"), "source_no", F.when(F.col("c") == 0, F.array().cast("array<bigint>")).otherwise(F.array("c")).alias("citations"))
    return audit.citation_audit(paragraphs, s.select("answer", "source_no", "n_chunks"))


@query(
    "group_conditions_n7",
    r"""WITH q AS (SELECT s_suppkey AS source, s_nationkey AS pos, (s_suppkey % 9) || '. ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Oil level, low!' ELSE 'oil  LEVEL low ' END || n_regionkey AS quote FROM supplier JOIN nation ON n_nationkey = s_nationkey),
          k AS (SELECT source, pos, regexp_replace(quote, '^[0-9]+[.)]\s+', '') AS w FROM q), d AS (SELECT *, regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') AS key FROM k)
        SELECT DISTINCT key, source, (SELECT count(DISTINCT source) FROM d e WHERE e.key = d.key) AS n_sources, (SELECT arg_min(w, source) FROM d e WHERE e.key = d.key) AS wording FROM d""",
)
def group_conditions_n7(t):
    quote = F.expr("(s_suppkey % 9) || '. ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Oil level, low!' ELSE 'oil  LEVEL low ' END || n_regionkey")
    q = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("pos"), quote.alias("quote"))
    return audit.group_conditions(q)


@query(
    "page_gaps_n8",
    """WITH p AS (SELECT source AS doc, doc_id // 20 AS page FROM documents), e AS (SELECT doc, unnest(range(1, max(page) + 1)) AS page FROM p GROUP BY doc), c AS (SELECT doc, page, count(*) AS n FROM p GROUP BY ALL)
       SELECT doc, page, 'missing' AS problem FROM e ANTI JOIN c USING (doc, page) UNION ALL SELECT doc, page, 'unexpected' FROM c ANTI JOIN e USING (doc, page) UNION ALL SELECT doc, page, 'twice' FROM c WHERE n > 1""",
)
def page_gaps_n8(t):
    p = t.documents.select(F.col("source").alias("doc"), F.floor(F.col("doc_id") / 20).alias("page"))
    return audit.page_gaps(p, p.groupBy("doc").agg(F.max("page").alias("n_pages")))


@query("hash_mismatch_n9", "SELECT 'd' || doc_id AS name FROM documents WHERE doc_id % 9 = 0 OR doc_id % 31 = 5")
def hash_mismatch_n9(t):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    files = t.documents.filter("doc_id % 31 <> 5").select(name, sha.alias("sha"))
    manifest = t.documents.select(name, F.when(F.col("doc_id") % 9 == 0, F.lit("0")).otherwise(sha).alias("sha"))
    return hash_mismatch(files, manifest).select("name")


STEP_TABLE = """'Restart ' || c_custkey || '\n' || CASE WHEN c_nationkey % 3 = 0 THEN 'other | header' ELSE '순서 | 조작 | 비고' END || '\n1 | ' || c_mktsegment || ' | -\n2 | ' || c_name ||
   CASE WHEN c_nationkey % 2 = 0 THEN '\nnote | x' ELSE '' END || '\n3 | release | z'"""


@query(
    "step_rows_n10",
    """SELECT c_custkey AS "table", 1 AS step_no, c_mktsegment AS action FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT c_custkey, 2, c_name FROM customer WHERE c_nationkey % 3 <> 0
       UNION ALL SELECT c_custkey, 3, 'release' FROM customer WHERE c_nationkey % 3 <> 0 AND c_nationkey % 2 <> 0""",
)
def step_rows_n10(t):
    return audit.step_rows(t.customer.select(F.col("c_custkey").alias("table"), F.expr(STEP_TABLE).alias("text")))


CAUSE_LINES = """array('[원인]', 'low oil ' || s_nationkey, '[조치]', 'fill ' || s_name, 'check pump', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'wait' END, 'after blank',
   '[신호]', '(1) X' || s_suppkey || '.1 : pressure', 'free words', 'Y2.1: late', CASE WHEN s_suppkey % 2 = 0 THEN '[원인]' ELSE 'plain' END, 'hot motor', '[조치]', 'cool down')"""


@query(
    "cause_actions_n11",
    """SELECT s_suppkey AS source, 'low oil' AS quote, 'action' AS kind, 3 AS pos, 'fill ' || s_name AS text FROM supplier UNION ALL SELECT s_suppkey, 'low oil', 'action', 4, 'check pump' FROM supplier
       UNION ALL SELECT s_suppkey, 'low oil', 'action', 5, 'wait' FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'low oil', 'action', 6, 'after blank' FROM supplier WHERE s_suppkey % 3 <> 0
       UNION ALL SELECT s_suppkey, 'low oil', 'signal', 8, 'X' || s_suppkey || '.1 : pressure' FROM supplier UNION ALL SELECT s_suppkey, 'hot', 'action', 14, 'cool down' FROM supplier""",
)
def cause_actions_n11(t):
    lines = t.supplier.select(F.col("s_suppkey").alias("source"), F.posexplode(F.expr(CAUSE_LINES)).alias("pos", "line"))
    quotes = t.supplier.select(F.col("s_suppkey").alias("source"), F.explode(F.array(F.lit("low oil"), F.lit("hot"))).alias("quote"))
    return audit.cause_actions(lines, quotes)


@query(
    "alarm_rows_n12",
    "SELECT p_partkey AS source, '10' || p_size AS code, 1 AS pos, p_name || ' fault' AS description FROM part UNION ALL SELECT p_partkey, '10' || p_size, 3, 'see 10' || p_size || ' again' FROM part",
)
def alarm_rows_n12(t):
    text = F.expr("'code | text\n10' || p_size || ' | ' || p_name || ' fault | 5\n210' || p_size || ' | other text\nA1.2 | see 10' || p_size || ' again'")
    tables = t.part.select(F.col("p_partkey").alias("source"), text.alias("text"))
    return audit.alarm_rows(tables, t.part.select(F.col("p_partkey").alias("source"), F.concat(F.lit("10"), F.col("p_size").cast("string")).alias("code")))


@query(
    "checkable_lines_n13",
    """WITH c AS (SELECT *, c_custkey % 5 <> 0 OR (c_custkey >= 100 AND c_custkey % 2 = 0) AS el, c_nationkey % 3 = 0 AND c_custkey % 4 = 0 AS sees FROM customer),
         a AS (SELECT c_nationkey, bool_or(el AND sees) AS anysee FROM c GROUP BY 1)
       SELECT c_nationkey AS qid, c_custkey AS source, 2 AS pos, 'sensor detects ' || c_custkey AS line FROM c WHERE el AND sees
       UNION ALL SELECT c_nationkey, c_custkey, 1, 'check valve ' || c_custkey FROM c JOIN a USING (c_nationkey) WHERE el AND NOT anysee""",
)
def checkable_lines_n13(t):
    first = "CASE WHEN c_custkey % 5 = 0 THEN 'Alarm | text' ELSE 'plain' END"
    last = "CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 4 = 0 THEN '\nsensor detects ' || c_custkey ELSE '' END"
    text = F.expr(f"{first} || '\ncheck valve ' || c_custkey || {last}")
    asked = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("did all of "), F.col("c_custkey").cast("string"))).otherwise("no")
    s = t.customer.select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("source"), text.alias("text"), asked.alias("q"))
    return audit.checkable_lines(s, F.col("q"))


@query(
    "item_lines_n14",
    """WITH l AS (SELECT lang AS qid, doc_id AS source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
         i AS (SELECT * FROM (VALUES ('the', 'the'), ('of', 'of|and')) v(item, pat))
       SELECT qid, item, source, CAST(pos AS INT) AS pos, row_number() OVER (PARTITION BY qid, item ORDER BY source, pos) AS line_no FROM l JOIN i ON regexp_matches(lower(line), pat)""",
)
def item_lines_n14(t):
    pair = F.array(F.struct(F.lit("the").alias("item"), F.lit("the").alias("pattern")), F.struct(F.lit("of").alias("item"), F.lit("of|and").alias("pattern")))
    items = t.documents.select(F.col("lang").alias("qid")).distinct().select("qid", F.explode(pair).alias("x")).select("qid", "x.*")
    out = audit.item_lines(t.documents.select(F.col("lang").alias("qid"), F.col("doc_id").alias("source"), "text"), items)
    return out.select("qid", "item", "source", "pos", "line_no")
