"""Bindings of catalog joins, membership, intervals and corpus assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import doc_key
from ..operators import assembly, catalog, intervals
from ..operators.ordered import carry_last
from .bindings import STATUS_SQL, status_history
from .registry import query

CHUNKS_SQL = """(SELECT doc_id AS id, text, lower(source) AS doc_key, CASE WHEN doc_id % 3 = 0 THEN 'paddleocr' ELSE 'docling' END AS source_type FROM documents)"""
CATALOG_SQL = """(SELECT 'src' || s_suppkey AS doc_key, CASE s_nationkey % 4 WHEN 0 THEN 'electrical' WHEN 1 THEN 'controller' ELSE 'manual' END AS document_type,
    'M' || s_nationkey AS machine_code FROM supplier WHERE s_nationkey % 5 <> 0)"""


def chunks(t):
    kind = F.when(F.col("doc_id") % 3 == 0, "paddleocr").otherwise("docling")
    return t.documents.select(F.col("doc_id").alias("id"), "text", doc_key(F.col("source")).alias("doc_key"), kind.alias("source_type"))


def links(t):
    n = F.col("s_nationkey") % 4
    return t.supplier.filter("s_nationkey % 5 <> 0").select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("doc_key"),
        F.when(n == 0, "electrical").when(n == 1, "controller").otherwise("manual").alias("document_type"),
        F.concat(F.lit("M"), F.col("s_nationkey").cast("string")).alias("machine_code"),
    )


@query(
    "link_catalog_d1",
    f"SELECT id, c.doc_key, document_type, machine_code FROM {CHUNKS_SQL} c JOIN {CATALOG_SQL} k USING (doc_key) WHERE document_type <> 'electrical'",
)
def link_catalog_d1(t):
    out = catalog.link_catalog(chunks(t), catalog.document_catalog(links(t)))
    return out.select("id", "doc_key", "document_type", F.array_join("machine_code", ",").alias("machine_code"))


@query(
    "skip_prepared_d2",
    f"""SELECT id, source_type FROM {CHUNKS_SQL} WHERE source_type <> 'paddleocr'
        OR doc_key NOT IN (SELECT 'src' || s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)""",
)
def skip_prepared_d2(t):
    done = t.supplier.filter("s_nationkey % 2 = 0").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("doc_key"))
    return catalog.skip_prepared(chunks(t), done, "paddleocr").select("id", "source_type")


@query(
    "missing_documents_d3",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def missing_documents_d3(t):
    extracted = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.missing_documents(t.customer, extracted, "c_custkey").select("c_custkey", "c_name")


@query(
    "keep_identified_d4",
    """WITH f AS (SELECT p_partkey, p_brand, CASE WHEN p_type = 'ECONOMY' THEN 'pictures' ELSE 'texts' END AS kind,
           p_type = 'ECONOMY' AND 'CN' || p_size = 'CN' || substr(p_brand, 7) AS hit FROM part)
       SELECT p_partkey, p_brand, kind FROM (SELECT *, bool_or(hit) OVER (PARTITION BY p_brand) AS anyhit FROM f) WHERE NOT anyhit OR kind <> 'pictures' OR hit""",
)
def keep_identified_d4(t):
    items = t.part.select(
        "p_partkey", "p_brand", F.when(F.col("p_type") == "ECONOMY", "pictures").otherwise("texts").alias("kind"),
        F.concat(F.lit("fig cn"), F.col("p_size").cast("string"), F.lit(", "), F.col("p_name")).alias("text"),
    )
    wanted = t.part.select("p_brand", F.concat(F.lit("CN"), F.substring("p_brand", 7, 9)).alias("identifier")).distinct()
    return catalog.keep_identified(items, "p_brand", "text", "kind", wanted).select("p_partkey", "p_brand", "kind")


@query(
    "resolve_documents_d5",
    """WITH r AS (SELECT DISTINCT lower(p_brand) AS k, p_type AS machine FROM part),
         d AS (SELECT DISTINCT k FROM (SELECT lower(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name || ' ' || p_brand END) AS k FROM part)),
         e AS (SELECT d.k, r.machine FROM d JOIN r USING (k)),
         x AS (SELECT d.k, r.machine FROM d JOIN r ON contains(d.k, r.k) OR contains(r.k, d.k) WHERE d.k NOT IN (SELECT k FROM r))
       SELECT DISTINCT k AS doc_key, machine FROM (SELECT * FROM e UNION ALL SELECT * FROM x)""",
)
def resolve_documents_d5(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    documents = t.part.select(doc_key(name).alias("doc_key")).distinct()
    registry = t.part.select(doc_key(F.col("p_brand")).alias("doc_key"), F.col("p_type").alias("machine")).distinct()
    return catalog.resolve_documents(documents, registry, "doc_key", "machine")


@query(
    "explode_machines_d6",
    "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, unnest(['M' || l_suppkey, 'S' || l_linenumber, 'M' || l_suppkey]) AS machine FROM lineitem",
)
def explode_machines_d6(t):
    codes = F.array(F.concat(F.lit("M"), F.col("l_suppkey")), F.concat(F.lit("S"), F.col("l_linenumber")), F.concat(F.lit("M"), F.col("l_suppkey")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", codes.alias("codes"))
    return catalog.explode_machines(rows, "codes").select("l_orderkey", "l_linenumber", "l_partkey", "machine").distinct()


def machines(t):
    return t.events.select(F.col("user_id").alias("machine_code")).distinct().withColumn(
        "machine_sys", F.col("machine_code") % 3
    ).withColumn("machine_ver", F.col("machine_code") % 2)


def definitions(t):
    return t.part.groupBy(
        (F.col("p_partkey") % 3).alias("machine_sys"), (F.floor(F.col("p_partkey") / 3) % 2).alias("machine_ver"),
        F.concat(F.lit("AL"), F.col("p_size").cast("string")).alias("alarm_code"),
    ).agg(F.min("p_name").alias("alarm_details"))


DEFS_SQL = "(SELECT p_partkey % 3 AS sys, (p_partkey // 3) % 2 AS ver, 'AL' || p_size AS alarm_code, min(p_name) AS alarm_details FROM part GROUP BY ALL)"


@query(
    "with_definitions_d7",
    f"""SELECT event_id, s.alarm_code, alarm_details FROM {STATUS_SQL} s LEFT JOIN {DEFS_SQL} a
        ON a.sys = s.machine_code % 3 AND a.ver = s.machine_code % 2 AND a.alarm_code = s.alarm_code""",
)
def with_definitions_d7(t):
    return intervals.with_definitions(status_history(t), machines(t), definitions(t)).select("event_id", "alarm_code", "alarm_details")


def bins_sql(unit: str, shift: int = 0) -> str:
    return f"""(SELECT *, greatest(0, (epoch_us(least(e, w + INTERVAL 1 {unit})) - epoch_us(greatest(occur_date, w)))) // 1000000 AS seconds FROM (
      SELECT s.*, occur_date + to_seconds(operate_period) AS e, unnest(generate_series(date_trunc('{unit}', occur_date - INTERVAL {shift} HOUR),
        date_trunc('{unit}', occur_date + to_seconds(operate_period) - INTERVAL {shift} HOUR - INTERVAL 1 MICROSECOND), INTERVAL 1 {unit})) + INTERVAL {shift} HOUR AS w
      FROM {STATUS_SQL} s WHERE operate_period > 0))"""


@query("day_overlap_d8", f"SELECT event_id, strftime(w, '%Y-%m-%d %H') AS window_start, seconds FROM {bins_sql('day', 8)}")
def day_overlap_d8(t):
    return intervals.split_by(status_history(t), "day", 8).select(
        "event_id", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "seconds"
    )


@query("hour_bins_d9", f"SELECT event_id, strftime(w, '%Y-%m-%d %H') AS window_start, seconds FROM {bins_sql('hour')}")
def hour_bins_d9(t):
    return intervals.split_by(status_history(t), "hour").select(
        "event_id", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "seconds"
    )


@query(
    "previous_question_d10",
    """SELECT a.conv_id, a.turn, q.turn AS question_order, md5(q.text) AS question FROM conversations a ASOF LEFT JOIN
         (SELECT * FROM conversations WHERE role = 'user') q ON a.conv_id = q.conv_id AND a.turn > q.turn WHERE a.role = 'assistant'""",
)
def previous_question_d10(t):
    out = intervals.previous_user_message(t.conversations, "conv_id", "turn", "role", "text")
    return out.select("conv_id", "turn", "question_order", F.md5("question").alias("question"))


@query(
    "next_pages_d12",
    """WITH p AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS page FROM lineitem)
       SELECT a.doc, a.page, b.page AS next_page FROM p a JOIN p b ON a.doc = b.doc AND b.page = a.page + 1""",
)
def next_pages_d12(t):
    return intervals.next_pages(t.lineitem.select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("page")), "doc", "page")


BOX = {
    "x0": "cast(l_quantity as int) * 20", "y0": "l_linenumber * 130",
    "x1": "cast(l_quantity as int) * 20 + 100 + cast(l_tax * 1000 as int)", "y1": "l_linenumber * 130 + cast(l_discount * 1000 as int)",
}
BOX_SQL = ", ".join(f"{e} AS {n}" for n, e in BOX.items())


@query(
    "nearest_pictures_d13",
    f"""WITH b AS (SELECT l_suppkey AS doc, l_orderkey // 20 AS page, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, l_returnflag, {BOX_SQL} FROM lineitem),
      c AS (SELECT doc, page, id AS cid, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1 FROM b WHERE l_returnflag = 'A'), p AS (SELECT doc, page, id AS pid, x0, y0, x1, y1 FROM b WHERE l_returnflag = 'R'),
      g AS (SELECT DISTINCT doc, page, cid, pid, greatest(0, cy0 - y1, y0 - cy1) AS gap FROM c JOIN p USING (doc, page) WHERE least(cx1, x1) - greatest(cx0, x0) > 0)
      SELECT doc, page, cid, min(pid) AS pid, CAST(gap AS INT) AS gap FROM g JOIN (SELECT doc, page, cid, min(gap) AS gap FROM g WHERE gap <= 150 GROUP BY ALL) USING (doc, page, cid, gap)
      GROUP BY ALL HAVING count(*) = 1""",
)
def nearest_pictures_d13(t):
    blocks = t.lineitem.select(
        "l_returnflag", F.col("l_suppkey").alias("doc"), F.floor(F.col("l_orderkey") / 20).alias("page"),
        (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), *[F.expr(e).alias(n) for n, e in BOX.items()],
    )
    out = intervals.nearest_pictures(blocks.filter("l_returnflag = 'A'"), blocks.filter("l_returnflag = 'R'"))
    return out.withColumn("gap", F.col("gap").cast("int"))


@query(
    "symbol_addresses_d15",
    r"""SELECT DISTINCT doc_id, address FROM (SELECT doc_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z][A-Z0-9.*_-]+')) AS label FROM documents)
        JOIN (SELECT label, 'X' || min(item_id) AS address FROM (SELECT item_id, upper(replace(unnest(string_split(text, ' ')), 'ß', 'SS')) AS label FROM benchmark) GROUP BY label) USING (label)""",
)
def symbol_addresses_d15(t):
    """Every word of the benchmark is a symbol; its address is the first item that has it."""
    words = t.benchmark.select("item_id", F.explode(F.split("text", " ")).alias("word")).groupBy(F.upper("word").alias("label")).agg(F.min("item_id").alias("i"))
    return catalog.symbol_addresses(t.documents, "doc_id", "text", words.select("label", F.concat(F.lit("X"), F.col("i").cast("string")).alias("address")), "[A-Z][A-Z0-9.*_-]+")


@query(
    "readiness_e13",
    """WITH d AS (SELECT DISTINCT c_custkey AS machine, o_orderkey AS doc, o_orderstatus = 'F' AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
         p AS (SELECT machine, count(doc) AS document_count, count(*) FILTER (WHERE found) AS searchable_count FROM d GROUP BY machine)
       SELECT machine, document_count, searchable_count, CASE WHEN document_count = 0 THEN 'no_documents' WHEN searchable_count = 0 THEN 'no_search_data'
              WHEN searchable_count < document_count THEN 'partial' ELSE 'ready' END AS state FROM p""",
)
def readiness_e13(t):
    documents = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("machine"), F.col("o_orderkey").alias("doc_key")
    )
    found = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("machine"), F.col("o_orderkey").alias("doc_key"))
    return catalog.readiness(documents, found)


@query(
    "machine_document_links_e14",
    """WITH l AS (SELECT DISTINCT l_suppkey AS machine, l_partkey AS doc FROM lineitem)
       SELECT machine, doc, count(*) OVER (PARTITION BY doc) AS n_machines, count(*) OVER (PARTITION BY machine) AS n_documents FROM l""",
)
def machine_document_links_e14(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("machine"), F.col("l_partkey").alias("doc"))
    return catalog.machine_document_links(rows, "machine", "doc")


MANIFEST_SQL = """(SELECT doc_id, source AS doc, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS folder, CASE WHEN doc_id % 2 = 0 THEN 'sha' || (doc_id % 20) END AS sha, 7 AS n_pages FROM documents)"""


@query(
    "merge_manifests_a4",
    f"SELECT doc, arg_min(folder, doc_id) AS folder, arg_min(sha, doc_id) AS sha, min(n_pages) AS n_pages FROM {MANIFEST_SQL} GROUP BY doc",
)
def merge_manifests_a4(t):
    return catalog.merge_manifests(manifests(t), "doc", ["folder", "sha", "n_pages"], "doc_id")[0]


@query(
    "manifest_conflicts_a4b",
    f"""SELECT doc, 'folder' AS field FROM {MANIFEST_SQL} GROUP BY doc HAVING min(folder) <> max(folder)
        UNION ALL SELECT doc, 'sha' FROM {MANIFEST_SQL} GROUP BY doc HAVING min(sha) <> max(sha)""",
)
def manifest_conflicts_a4b(t):
    return catalog.merge_manifests(manifests(t), "doc", ["folder", "sha", "n_pages"], "doc_id")[1]


def manifests(t):
    return t.documents.select(
        "doc_id", F.col("source").alias("doc"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("folder"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("sha"), (F.col("doc_id") % 20).cast("string"))).alias("sha"), F.lit(7).alias("n_pages"),
    )


BLOCKS_SQL = """(SELECT source AS doc, doc_id // 20 AS page, doc_id AS position, text, lang AS title, CASE WHEN doc_id % 4 = 0 THEN 'tables' ELSE 'texts' END AS kind FROM documents)"""


def blocks(t):
    return t.documents.select(
        F.col("source").alias("doc"), F.floor(F.col("doc_id") / 20).alias("page"), F.col("doc_id").alias("position"), "text",
        F.col("lang").alias("title"), F.when(F.col("doc_id") % 4 == 0, "tables").otherwise("texts").alias("kind"),
    )


@query(
    "assemble_pages_e12",
    f"""SELECT doc, page, md5(coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (WHERE kind <> 'tables'), '')) AS body,
          count(*) FILTER (WHERE kind = 'tables') AS n_tables, (SELECT string_agg(title, ' · ' ORDER BY p) FROM (SELECT title, min(position) AS p FROM {BLOCKS_SQL} b2
            WHERE b2.doc = b.doc AND b2.page = b.page GROUP BY title)) AS titles FROM {BLOCKS_SQL} b GROUP BY doc, page""",
)
def assemble_pages_e12(t):
    out = assembly.assemble_pages(blocks(t))
    return out.select("doc", "page", F.md5("body").alias("body"), "n_tables", F.array_join("titles", " · ").alias("titles"))


@query(
    "import_counters_e15",
    """SELECT count(DISTINCT doc_id // 20) AS pages, count(*) AS chunks, count(*) FILTER (WHERE trim(text) = '') AS empty_chunks,
         count(*) - count(DISTINCT md5(text)) AS repeated, lang AS machine FROM documents GROUP BY lang""",
)
def import_counters_e15(t):
    d = t.documents.select(F.floor(F.col("doc_id") / 20).alias("page"), F.md5("text").alias("id"), "text", F.col("lang").alias("machine"))
    return assembly.import_counters(d)


FINGER_SQL = """WITH RECURSIVE r AS (SELECT doc_id AS id, sha256(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || length(text) || ':' || text) AS h FROM documents),
  t AS (
    SELECT 0 AS lev, id, h, min(id) OVER () AS lo, max(id) OVER () AS hi FROM r
    UNION ALL
    SELECT lev + 1, id // 1024, sha256(string_agg(h, '' ORDER BY id)), any_value(lo) // 1024, any_value(hi) // 1024 FROM t WHERE lev = 0 OR lo <> hi GROUP BY lev, id // 1024)
  SELECT h AS fingerprint, (SELECT count(*) FROM documents) AS n FROM t WHERE lev > 0 AND lo = hi"""


@query("fingerprint_e16", FINGER_SQL)
def fingerprint_e16(t):
    return assembly.fingerprint(t.documents, "doc_id", ["doc_id", "text"])


@query(
    "merge_sources_e18",
    """SELECT doc, kind, min(position) AS position FROM (SELECT source AS doc, lang AS kind, doc_id AS position FROM documents
         UNION ALL SELECT source, lang, doc_id + 1000000 FROM documents) GROUP BY ALL""",
)
def merge_sources_e18(t):
    rows = t.documents.select(F.struct(F.col("source").alias("doc"), F.col("lang").alias("kind")).alias("s"), F.col("doc_id").alias("position"))
    both = rows.unionByName(rows.withColumn("position", F.col("position") + 1000000))
    return assembly.merge_sources(both, "s", "position").select("s.doc", "s.kind", "position")


LINE_SQL = """(SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber + l_partkey * 10000000 AS pos, min(l_returnflag) AS kind, min('T' || l_orderkey) AS text FROM lineitem GROUP BY 1, 2)"""


def doc_lines(t):
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") * 10000000
    return t.lineitem.groupBy(F.col("l_suppkey").alias("doc"), pos.alias("pos")).agg(
        F.min("l_returnflag").alias("kind"), F.min(F.concat(F.lit("T"), F.col("l_orderkey").cast("string"))).alias("text")
    )


@query(
    "running_title_f4",
    f"SELECT doc, pos, coalesce(last_value(CASE WHEN kind = 'A' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), '') AS title FROM {LINE_SQL}",
)
def running_title_f4(t):
    title = F.when(F.col("kind") == "A", F.col("text"))
    out = carry_last(doc_lines(t), ["doc"], ["pos"], F.floor(F.col("pos") / 10**9), {"title": title})
    return out.select("doc", "pos", F.coalesce("title", F.lit("")).alias("title"))


@query(
    "continuation_f5",
    f"""WITH e AS (SELECT doc, pos, kind, text, last_value(CASE WHEN kind <> 'N' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos) AS entry FROM {LINE_SQL})
        SELECT doc, entry, count(*) FILTER (WHERE kind = 'N') AS n_more, arg_max(text, pos) AS last_text FROM e WHERE entry IS NOT NULL GROUP BY doc, entry""",
)
def continuation_f5(t):
    entry = F.when(F.col("kind") != "N", F.col("pos"))
    out = carry_last(doc_lines(t), ["doc"], ["pos"], F.floor(F.col("pos") / 10**9), {"entry": entry}).filter("entry is not null")
    return out.groupBy("doc", "entry").agg(F.count_if(F.col("kind") == "N").alias("n_more"), F.max_by("text", "pos").alias("last_text"))
