"""Bindings of readers, sinks, set operations and corpus synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import passage
from ..operators import assembly, sync
from ..operators.chunking import char_shingles
from ..session import fresh_path, small
from ..sources import readers, sinks
from .bindings import VECS_SQL, vecs
from .registry import query


@query("read_chunks_a1", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS body, lang FROM documents")
def read_chunks_a1(t):
    row = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("page_content"), F.struct("lang", "n_chars").alias("metadata")))
    lines = t.documents.select(F.explode(F.array(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("﻿"), row)).otherwise(row), F.lit("  "))).alias("value"))
    path = fresh_path(t.spark, "chunks")
    lines.write.text(path)
    out = readers.read_chunks(t.spark, path)
    return out.select("id", F.md5("page_content").alias("body"), F.variant_get("metadata", "$.lang", "string").alias("lang"))


@query(
    "ocr_blocks_a2",
    r"""WITH l AS (SELECT doc_id, lang AS doc, doc_id + 1 AS page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS parts FROM documents)
        SELECT doc, page, CAST(i AS INT) AS position, CASE i % 5 WHEN 2 THEN 'tables' WHEN 3 THEN 'pictures' ELSE 'texts' END AS container_type, md5(trim(parts[i - i % 5 + 1])) AS section,
          CASE WHEN i % 5 = 3 THEN 'p' || lpad(CAST(page AS VARCHAR), 4, '0') || '-b' || lpad(CAST(i AS VARCHAR), 4, '0') || '.jpg'
               WHEN i % 5 = 2 AND trim(line) <> '' THEN 'p' || lpad(CAST(page AS VARCHAR), 4, '0') || '-b' || lpad(CAST(i AS VARCHAR), 4, '0') || '.md' ELSE '' END AS asset FROM l""",
)
def ocr_blocks_a2(t):
    labels = F.array(*map(F.lit, ("paragraph_title", "text", "table", "image", "number")))
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    block = lambda line, i: F.struct(F.element_at(labels, i % 5 + 1).alias("block_label"), line.alias("block_content"), box.alias("block_bbox"))
    data = F.struct(F.transform(F.split("text", "\n"), block).alias("parsing_res_list"), F.lit(100).alias("width"), F.lit(200).alias("height"))
    file = F.concat(F.lit("page_"), F.col("doc_id").cast("string"), F.lit("_res.json"))
    out = readers.ocr_blocks(t.documents.select("lang", file.alias("file"), data.alias("data")), "lang", "file", "data")
    return out.select("doc", "page", "position", "container_type", F.md5("section_title").alias("section"), "asset")


ROWS_SQL = """(SELECT source AS doc, doc_id AS pos, 'c' || (doc_id // 50) AS chunk_id, CASE WHEN doc_id % 17 = 0 THEN 'bad' ELSE 'sha' END AS sha, doc_id % 9 AS a, doc_id % 9 + doc_id % 4 AS b FROM documents)"""


def struct_input(t):
    d = F.col("doc_id")
    rows = t.documents.select(
        F.col("source").alias("doc"), d.alias("pos"), F.concat(F.lit("c"), F.floor(d / 50).cast("string")).alias("chunk_id"),
        F.when(d % 17 == 0, "bad").otherwise("sha").alias("sha"), (d % 9).alias("first"), (d % 9 + d % 4).alias("last"),
    )
    manifest = t.documents.select(F.col("source").alias("doc")).distinct().select("doc", F.lit("sha").alias("source_sha"), F.lit(10).alias("pages"))
    return readers.struct_rows(rows, manifest)


@query(
    "struct_rows_a3",
    f"""SELECT doc, pos, chunk_id AS original_chunk_id, 'docling:' || doc || ':b' || lpad(CAST(n - 1 AS VARCHAR), 6, '0') AS chunk_id, pos <> f AS repeated FROM (
          SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n, min(pos) OVER (PARTITION BY doc, chunk_id) AS f FROM {ROWS_SQL}) WHERE sha = 'sha' AND a >= 1 AND a <= b AND b <= 10""",
)
def struct_rows_a3(t):
    return struct_input(t)[0]


@query("struct_problems_a3b", f"SELECT doc, pos, CASE WHEN sha <> 'sha' THEN 'hash' ELSE 'pages' END AS problem FROM {ROWS_SQL} WHERE sha <> 'sha' OR a < 1 OR b > 10")
def struct_problems_a3b(t):
    return struct_input(t)[1]


def registry(t):
    text = F.expr(
        """'{"M' || n_nationkey || '": {"machine_name": ' || CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || '"' ELSE '["' || n_name || '", "alias ' || n_nationkey || '"]' END ||
           ', "document": {"manual": ["' || n_name || '.pdf", {"filename": "Guide  ' || n_nationkey || '.PDF", "manual_type": "operation"}], "other": ["x"], "ladder": ["L' || n_regionkey || '.lst"]}}}'"""
    )
    # one registry per supplier's nation: the work grows with the supplier table
    return readers.registry_machines(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", text.alias("j")), "j").dropDuplicates(["machine_code"])


REG_SQL = "(SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))"


@query(
    "registry_names_a5",
    f"SELECT 'M' || n_nationkey AS machine_code, 0 AS name_no, n_name AS machine_name FROM {REG_SQL} UNION ALL SELECT 'M' || n_nationkey, 1, 'alias ' || n_nationkey FROM {REG_SQL} WHERE n_nationkey % 2 = 1",
)
def registry_names_a5(t):
    return readers.registry_names(registry(t))


@query(
    "registry_documents_a5b",
    f"""SELECT 'M' || n_nationkey AS machine_code, 'manual' AS document_type, lower(n_name) AS doc_key, '-' AS manual_type FROM {REG_SQL}
        UNION ALL SELECT 'M' || n_nationkey, 'manual', 'guide ' || n_nationkey, 'operation' FROM {REG_SQL} UNION ALL SELECT 'M' || n_nationkey, 'ladder', 'l' || n_regionkey, '-' FROM {REG_SQL}""",
)
def registry_documents_a5b(t):
    out = readers.registry_documents(registry(t))
    return out.select("machine_code", "document_type", "doc_key", F.coalesce("manual_type", F.lit("-")).alias("manual_type"))


SHEET_SQL = """(SELECT o_orderpriority AS sheet, 3 + o_orderkey AS r, CASE WHEN o_custkey % 10 = 0 THEN '계' ELSE CAST(o_orderkey AS VARCHAR) END AS no,
    strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'symptom ' || o_custkey END AS s, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'action ' || o_orderstatus END AS a FROM orders)"""


@query(
    "repair_cases_a6",
    f"""SELECT 'xls:book:' || sheet || ':' || (r + 1) AS id, md5('출처: plant_a 공장 수리 이력 / ' || sheet || ' 시트 / ' || (r + 1) || '행' || chr(10) || '장비: ' || sheet || chr(10) || '발생일자(원본): ' || d || chr(10)
          || '결함개소: ' || f(s) || chr(10) || '발생내용: ' || f(s) || chr(10) || '조치내용: ' || f(a) || chr(10) || '조치일(원본): 기록 없음' || chr(10) || '미가동시간: 기록 없음' || chr(10) || '수리비용: 기록 없음') AS document, r + 1 AS source_row
        FROM {SHEET_SQL} WHERE (s <> '' OR a <> '') AND no <> '계'""".replace("f(s)", "CASE WHEN s = '' THEN '기록 없음' ELSE s END").replace("f(a)", "CASE WHEN a = '' THEN '기록 없음' ELSE a END"),
)
def repair_cases_a6(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    values = [
        F.when(c % 10 == 0, "계").otherwise(o.cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("ignored"),
        F.when(c % 7 == 0, "").otherwise(F.concat(F.lit("symptom "), c.cast("string"))), F.when(c % 5 == 0, "").otherwise(F.concat(F.lit("action "), "o_orderstatus")),
    ]
    cell = [F.struct(F.lit(i).alias("col"), v.alias("value")) for i, v in enumerate(values)]
    body = t.orders.select(F.col("o_orderpriority").alias("sheet"), (o + 3).alias("row"), F.explode(F.array(*cell)).alias("x")).select("sheet", "row", "x.*")
    names = ("순번", "발생 일자", "결함개소", "발생내용", "조치내용")
    head = t.orders.select(F.col("o_orderpriority").alias("sheet")).distinct().select(
        "sheet", F.lit(2).cast("bigint").alias("row"), F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(n).alias("value")) for i, n in enumerate(names)])).alias("x")
    ).select("sheet", "row", "x.*")
    merged = F.col("col") == 2
    cells = body.unionByName(head).withColumn("merged_row", F.when(merged & (F.col("row") > 2), F.col("row"))).withColumn("merged_col", F.when(merged & (F.col("row") > 2), 3))
    return readers.repair_cases(cells, "plant_a", "book").select("id", F.md5("document").alias("document"), "source_row")


def notes(t):
    line = F.concat(F.lit("업체명: "), "s_name", F.lit(", 기계명: MX-"), F.col("s_nationkey").cast("string"), F.lit(", CNC: F31i, 작업내용: replaced"))
    return readers.field_notes(t.supplier.select(F.col("s_suppkey").alias("line_no"), F.when(F.col("s_suppkey") % 6 == 0, F.concat(F.lit("free text "), "s_name")).when(F.col("s_suppkey") % 6 == 1, " ").otherwise(line).alias("line")), "notes.txt")


@query("field_notes_a7", "SELECT 'txt:notes.txt:' || s_suppkey AS id, s_name AS company, 'MX-' || s_nationkey AS machine_name FROM supplier WHERE s_suppkey % 6 > 1")
def field_notes_a7(t):
    return notes(t)[0].select("id", "company", "machine_name")


@query("field_note_problems_a7b", "SELECT s_suppkey AS line_no, 'free text ' || s_name AS line FROM supplier WHERE s_suppkey % 6 = 0")
def field_note_problems_a7b(t):
    return notes(t)[1]


@query(
    "read_symbols_a9",
    "SELECT 'X' || p_partkey || '.' || (p_partkey % 8) AS address, p_brand AS symbol, '절삭유 ' || p_name AS short, p_type AS comment FROM part WHERE p_size % 9 <> 0",
)
def read_symbols_a9(t):
    a = F.when(F.col("p_size") % 9 == 0, "no address").otherwise(F.concat(F.lit("X00"), F.col("p_partkey").cast("string"), F.lit("."), (F.col("p_partkey") % 8).cast("string")))
    path = fresh_path(t.spark, "symbols")
    note = readers._recode("cp949", "iso-8859-1")(F.concat(F.lit("절삭유 "), "p_name"))
    t.part.select(a, "p_brand", note, "p_type").write.csv(path, sep="\t", encoding="iso-8859-1", quote="")
    return readers.read_symbols(t.spark, path)


@query("read_view_a10", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def read_view_a10(t):
    views = {"orders-by-day": ("orders", ("o_orderdate", "o_orderkey"))}
    return readers.read_view(t.spark, "orders-by-day", path=t.sf_dir, views=views).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("store_a12", "SELECT doc_id, lang AS machine_code, md5(text) AS body FROM documents")
def store_a12(t):
    path = fresh_path(t.spark, "store")
    sinks.write_store(t.documents.select("doc_id", "text", F.lit("plant_a").alias("site_id"), F.col("lang").alias("machine_code")), path)
    return sinks.read_store(t.spark, path).select("doc_id", "machine_code", F.md5("text").alias("body"))


def graph_files(t):
    nodes = t.part.filter("p_size < 45").select(F.col("p_partkey").alias("position"), F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("node"))
    contents = t.part.filter("p_size < 40").select(F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("node"))
    adjacency = t.lineitem.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).distinct()
    return readers.read_graph(adjacency, nodes, contents)


ADJ_SQL = "(SELECT DISTINCT l_suppkey AS r, l_partkey AS c FROM lineitem)"


@query("read_graph_a13", f"SELECT 'N' || r AS src, 'N' || c AS dst FROM {ADJ_SQL} JOIN part a ON a.p_partkey = r JOIN part b ON b.p_partkey = c WHERE a.p_size < 45 AND b.p_size < 45")
def read_graph_a13(t):
    return graph_files(t)[0]


@query(
    "graph_problems_a13b",
    f"""SELECT r || ',' || c AS item, 'position' AS problem FROM {ADJ_SQL} WHERE r NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) OR c NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)
        UNION ALL SELECT 'N' || p_partkey, 'content' FROM part WHERE p_size BETWEEN 40 AND 44""",
)
def graph_problems_a13b(t):
    return graph_files(t)[1]


@query(
    "page_evidence_a14",
    """WITH d AS (SELECT doc_id // 20 AS page, * FROM documents), pg AS (SELECT page FROM d UNION SELECT vec_id // 20 FROM embeddings),
       ti AS (SELECT page, string_agg(DISTINCT lang, ' · ' ORDER BY lang) AS t FROM d GROUP BY page),
       w AS (SELECT page, string_agg(source, ' ' ORDER BY p) AS w FROM (SELECT page, source, min(doc_id) AS p FROM d JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY page),
       x AS (SELECT page, string_agg(text, chr(10) ORDER BY doc_id) AS x FROM d GROUP BY page)
       SELECT page, CASE WHEN w IS NOT NULL AND x IS NOT NULL THEN 'full' ELSE 'partial' END AS coverage, md5(concat_ws(chr(10), t, w, x)) AS evidence FROM pg LEFT JOIN ti USING (page) LEFT JOIN w USING (page) LEFT JOIN x USING (page)""",
)
def page_evidence_a14(t):
    """Twenty documents are a page; labelled ones give its words, vectors refer to pages, of which some have no document."""
    page = lambda c: F.floor(F.col(c) / 20).alias("page")
    d = t.documents.withColumn("page", page("doc_id"))
    held = d.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    out = readers.page_evidence(
        d.select("page", F.col("lang").alias("title")),
        d.join(t.labels.select("doc_id"), "doc_id").select("page", F.col("doc_id").alias("pos"), F.col("source").alias("word")),
        held.select("page", F.array_join(F.transform("x", lambda x: x.text), "\n").alias("text")),
        t.embeddings.select(page("vec_id")),
    )
    return out.select("page", "coverage", F.md5("evidence").alias("evidence"))


@query("write_if_changed_a16", "SELECT doc_id, md5(text) AS body FROM documents UNION ALL SELECT doc_id, md5(text || '!') FROM documents WHERE doc_id % 4 = 0")
def write_if_changed_a16(t):
    """Written twice unchanged, then with a quarter of the rows changed."""
    path = fresh_path(t.spark, "content")
    docs = t.documents.select("doc_id", "text")
    sinks.write_if_changed(docs, path)
    sinks.write_if_changed(docs, path)
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sinks.write_if_changed(edited, path).select("doc_id", F.md5("text").alias("body"))


@query(
    "export_search_a17",
    f"""SELECT machine, id, round(list_dot_product(v, v), 6) AS norm FROM (SELECT unnest([machine, doc]) AS machine, id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS v FROM {VECS_SQL} JOIN documents ON doc_id = id WHERE trim(text) <> '')""",
)
def export_search_a17(t):
    path = fresh_path(t.spark, "search")
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("page_content"), F.array("lang", "source", "lang").alias("machine_code"))
    sinks.export_search(chunks, vecs(t).select("id", "vec"), path)
    v = t.spark.read.parquet(f"{path}/vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return v.select(F.col("machine").cast("string").alias("machine"), "id", F.round(norm, 6).alias("norm"))


@query(
    "upsert_report_a18",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS report_day, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-10' THEN 0 ELSE count(*) END AS n FROM events GROUP BY CAST(ts AS DATE)",
)
def upsert_report_a18(t):
    path = fresh_path(t.spark, "reports")
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("report_day")).agg(F.count("*").alias("n"))
    sinks.upsert_report(days.filter("report_day < '2024-01-10'").withColumn("n", F.lit(0).cast("bigint")), path)
    sinks.upsert_report(days, path)
    sinks.upsert_report(days, path)
    return t.spark.read.parquet(path)


@query(
    "claimable_a18b",
    """SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS report_day,
         CASE WHEN day(ts) % 3 = 0 THEN 'done' WHEN day(ts) % 3 = 1 AND day(ts) > 20 THEN 'running' ELSE 'again' END AS status FROM events""",
)
def claimable_a18b(t):
    days = t.events.select(F.to_date("ts").alias("d")).distinct().select(F.date_format("d", "yyyy-MM-dd").alias("report_day"), F.dayofmonth("d").alias("n"))
    age = F.when(F.col("n") > 20, F.lit("2024-02-01 11:55:00")).otherwise(F.lit("2024-02-01 11:00:00")).cast("timestamp")
    stored = days.filter("n % 3 < 2").select("report_day", F.when(F.col("n") % 3 == 0, "done").otherwise("running").alias("status"), age.alias("started_at"))
    path, now = fresh_path(t.spark, "claims"), "2024-02-01 12:00:00"
    stored.write.parquet(path)
    again = days.select("report_day", F.lit("again").alias("status"), F.lit(now).cast("timestamp").alias("started_at"))
    sinks.upsert_report(again, path, now)
    sinks.upsert_report(again, path, now)
    return sinks.read_reports(t.spark, path, again.schema).select("report_day", "status")


WANT_SQL = "(SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0)"
HAVE_SQL = "(SELECT doc_id AS id, text, lang FROM documents WHERE doc_id % 13 <> 0)"


def wanted(t):
    d = t.documents.filter("doc_id % 11 <> 0")
    i = F.col("doc_id")
    return d.select(i.alias("id"), F.when(i % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(i % 5 == 0, "x").otherwise(F.col("lang")).alias("lang"))


def stored(t):
    return t.documents.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), "text", "lang")


PLAN_SQL = f"""SELECT coalesce(w.id, h.id) AS id, CASE WHEN h.id IS NULL THEN 'new' WHEN w.id IS NULL THEN 'stale' WHEN w.text <> h.text THEN 'text' WHEN w.lang <> h.lang THEN 'metadata' ELSE 'unchanged' END AS action
   FROM {WANT_SQL} w FULL JOIN {HAVE_SQL} h ON w.id = h.id"""


@query("sync_plan_k1", PLAN_SQL)
def sync_plan_k1(t):
    return sync.sync_plan(wanted(t), stored(t), "id", "text", ["lang"])


@query("sync_counts_d18", f"SELECT action, count(*) AS n FROM ({PLAN_SQL}) GROUP BY action")
def sync_counts_d18(t):
    return sync.sync_plan(wanted(t), stored(t), "id", "text", ["lang"]).groupBy("action").agg(F.count("*").alias("n"))


@query(
    "reuse_vectors_k2",
    f"SELECT w.id, round(vec[1], 6) AS first_value FROM {WANT_SQL} w JOIN {HAVE_SQL} h ON h.id = w.id AND h.text = w.text AND h.id % 3 > 0 JOIN {VECS_SQL} v ON v.id = w.id",
)
def reuse_vectors_k2(t):
    return reuse(t)[0].select("id", F.round(F.col("vec")[0], 6).alias("first_value"))


@query(
    "missing_vectors_k2b",
    f"SELECT w.id FROM {WANT_SQL} w WHERE NOT EXISTS (SELECT 1 FROM {HAVE_SQL} h JOIN {VECS_SQL} v USING (id) WHERE h.id = w.id AND h.text = w.text AND h.id % 3 > 0)",
)
def missing_vectors_k2b(t):
    return reuse(t)[1].select("id")


def reuse(t):
    text = lambda df: df.withColumn("passage", passage(F.lit(""), F.col("text")))
    have = text(stored(t).filter("id % 3 > 0")).join(vecs(t).select("id", "vec"), "id")
    return sync.reuse_vectors(text(wanted(t)), have, "id", "passage", "vec")


REV_SQL = """(SELECT {doc} AS doc, count(*) || '-' || CAST(sum(CAST(('0x' || substr(md5(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || length({text}) || ':' || {text}), 1, 15)) AS HUGEINT)) AS VARCHAR) AS revision FROM documents GROUP BY 1)"""


@query("revisions_k3", "SELECT doc, revision FROM " + REV_SQL.format(doc="source", text="text"))
def revisions_k3(t):
    return sync.revisions(t.documents.withColumnRenamed("source", "doc"), "doc", ["doc_id", "text"])


@query("changed_documents_k3b", "SELECT DISTINCT source AS doc FROM documents WHERE doc_id % 333 = 1")
def changed_documents_k3b(t):
    d = t.documents.withColumnRenamed("source", "doc")
    edited = d.withColumn("text", F.when(F.col("doc_id") % 333 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sync.changed_documents(sync.revisions(edited, "doc", ["doc_id", "text"]), sync.revisions(d, "doc", ["doc_id", "text"]), "doc").select("doc")


def corpora(t):
    d = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit("m1").alias("model"))
    new = t.embeddings.select((F.col("vec_id") + F.when(F.col("label") == 3, 0).otherwise(10**9)).alias("id"), F.slice("embedding", 1, 32).alias("vec"), F.lit("m1").alias("model"))
    return d, new


@query("merge_problems_k4", "SELECT CAST(vec_id AS VARCHAR) AS item, 'shared id' AS problem FROM embeddings WHERE label = 3 UNION ALL SELECT 'width', 'differs'")
def merge_problems_k4(t):
    return sync.merge_corpus(*corpora(t), "id", "vec")[1]


@query("merged_rows_k4b", "SELECT count(*) * 2 AS n, 0::BIGINT AS lost FROM embeddings")
def merged_rows_k4b(t):
    old, new = corpora(t)
    merged = sync.merge_corpus(old, new, "id", "vec")[0]
    lost = sync.lost_rows(old, merged).agg(F.count("*").alias("n")).scalar()
    return merged.agg(F.count("*").alias("n"), F.max(lost).alias("lost"))


@query("shared_ids_h5", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def shared_ids_h5(t):
    return sync.shared_ids(t.documents, t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("orphans_k5", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_k5(t):
    return sync.orphans(t.documents.select("doc_id"), t.labels, "doc_id")


@query("publish_k6", "SELECT doc_id, md5(text) AS body FROM documents")
def publish_k6(t):
    root = fresh_path(t.spark, "published")
    finger = lambda df: assembly.fingerprint(df, "doc_id", ["doc_id", "text"])
    docs = t.documents.select("doc_id", "text")
    sinks.publish(docs, root, "v1", finger(docs))
    return sinks.read_ready(t.spark, root, "v1", finger).select("doc_id", F.md5("text").alias("body"))


@query(
    "union_chunks_h1",
    "SELECT doc_id AS id, md5(text) AS body, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, 'label', NULL, quality FROM labels",
)
def union_chunks_h1(t):
    a = t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("body"), "lang")
    b = t.labels.select(F.col("doc_id").alias("id"), F.lit("label").alias("body"), "quality")
    return a.unionByName(b, allowMissingColumns=True)


@query("stale_and_new_h2", f"SELECT id, 'stale' AS side FROM {HAVE_SQL} ANTI JOIN {WANT_SQL} USING (id) UNION ALL SELECT id, 'new' FROM {WANT_SQL} ANTI JOIN {HAVE_SQL} USING (id)")
def stale_and_new_h2(t):
    w, s = wanted(t).select("id"), stored(t).select("id")
    return s.exceptAll(w).withColumn("side", F.lit("stale")).unionByName(w.exceptAll(s).withColumn("side", F.lit("new")))


@query(
    "shingle_overlap_h4",
    r"""WITH b AS (SELECT item_id, list_distinct(list_transform(range(1, CAST(length(c) AS BIGINT) - 6), lambda i: substr(c, i, 8))) AS g FROM (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS c FROM benchmark)),
          d AS (SELECT doc_id, list_distinct(list_transform(range(1, CAST(length(c) AS BIGINT) - 6), lambda i: substr(c, i, 8))) AS g FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS c FROM documents))
        SELECT doc_id, len(list_intersect(d.g, b.g)) AS overlap FROM d JOIN b ON item_id = doc_id % (SELECT count(*) FROM benchmark)""",
)
def shingle_overlap_h4(t):
    """A document's text meets the fragments of its item; its own fragments are cut behind the join and do not travel."""
    b = t.benchmark.select("item_id", char_shingles(F.col("text")).alias("bg"))
    d = t.documents.select("doc_id", (F.col("doc_id") % t.benchmark.count()).alias("item_id"), "text")
    shared = F.array_intersect(char_shingles(F.col("text")), F.col("bg"))
    return d.join(small(b), "item_id").select("doc_id", F.size(shared).cast("bigint").alias("overlap"))


@query("bad_vectors_a17b", "SELECT vec_id FROM embeddings WHERE label = 2")
def bad_vectors_a17b(t):
    from ..operators.vectors import bad_vectors

    zeroed = F.when(F.col("label") == 2, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return bad_vectors(t.embeddings.select("vec_id", zeroed.alias("vec")), "vec").select("vec_id")
