"""Bindings of the scalar helpers: names, identifiers, routing rules, bands and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import bands, pages, rules, text as T
from .registry import query

# Phrases appended by row position so that every rule is exercised on the test texts.
PHRASES = (
    "",
    "반복되는 원인 분석",
    "X008 주소 도면",
    "의미 설명",
    "지금 조치",
    "매뉴얼 12페이지 열어줘",
    "두 번째 참조 보여줘",
    "page 7 show",
    "열지 마",
    "오늘 가동률",
    "2026-10-19 실적",
    "컨트롤러 파라미터",
    "보수 매뉴얼",
    "운전 순서 조작",
    "gun coolant 펌프",
    "절삭유 coolant",
    "AUTO 모드에서 정지",
    "AUTO 모드에서 정지하지 않",
)


def phrase(position: Column) -> Column:
    n = len(PHRASES)
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.pmod(position, F.lit(n)) + 1).cast("int"))


SQL_PHRASES = "list_extract([" + ", ".join(f"'{p}'" for p in PHRASES) + "], CAST(({0}) %% {1} + 1 AS INT))".replace(
    "%%", "%"
).replace("{1}", str(len(PHRASES)))


def sql_phrase(position: str) -> str:
    return SQL_PHRASES.replace("{0}", position)


CHAT_SQL = f"(SELECT conv_id, turn, role, text || ' ' || {sql_phrase('conv_id + turn')} AS q FROM conversations)"


def chat_questions(t):
    q = F.concat(F.col("text"), F.lit(" "), phrase(F.col("conv_id") + F.col("turn")))
    return t.conversations.select("conv_id", "turn", "role", q.alias("q"))


@query(
    "doc_key_b1",
    r"""SELECT page_id, lower(trim(regexp_replace(regexp_replace(trim(nfc_normalize(
          regexp_extract(url || '.PDF', '([^/]*)$', 1))), '^(.+)\.(pdf|lst|lad)$', '\1', 'i'), '\s+', ' ', 'g'))) AS doc_key
        FROM pages""",
)
def doc_key_b1(t):
    return t.pages.select("page_id", T.doc_key(F.concat("url", F.lit(".PDF")), compose=True).alias("doc_key"))


@query(
    "name_key_b2",
    """SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9가-힣#]', '', 'g') AS name_key,
              regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-z]+', '', 'g') AS latin_key FROM part""",
)
def name_key_b2(t):
    name = F.concat_ws(" ", "p_name", "p_brand")
    return t.part.select("p_partkey", T.name_key(name).alias("name_key"), T.latin_key(name).alias("latin_key"))


@query(
    "content_key_b3",
    r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS content_key FROM documents""",
)
def content_key_b3(t):
    return t.documents.select("doc_id", F.md5(T.content_key(F.col("text"))).alias("content_key"))


@query(
    "match_text_b4",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower('passage: ' || text), '^passage:\s*', ''),
              '[^0-9a-z가-힣]+', ' ', 'g'))) AS match_text FROM documents""",
)
def match_text_b4(t):
    body = F.concat(F.lit("passage: "), F.col("text"))
    return t.documents.select("doc_id", F.md5(T.match_text(body)).alias("match_text"))


@query(
    "tokens_b5",
    r"""SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, md5(array_to_string(tk, '|')) AS tokens FROM (
          SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z]+\.?\d*\.?\d*|[가-힣]+|\d+') AS tk FROM documents)""",
)
def tokens_b5(t):
    tk = T.tokens(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(tk).cast("bigint").alias("n_tokens"), F.md5(F.array_join(tk, "|")).alias("tokens")
    )


@query(
    "identifiers_b6",
    r"""SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(s, '\b[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*\b'),
               lambda x: regexp_matches(x, '[0-9]')), ',') AS ids
        FROM (SELECT p_partkey, p_name || ' CN' || p_size || '-' || p_partkey || ', ' || p_brand || ' 77' AS s FROM part)""",
)
def identifiers_b6(t):
    s = F.expr("p_name || ' CN' || p_size || '-' || p_partkey || ', ' || p_brand || ' 77'")
    return t.part.select("p_partkey", F.array_join(T.identifiers(s), ",").alias("ids"))


RANGE_SQL = """CASE l_linenumber % 5 WHEN 0 THEN CAST(l_linenumber AS VARCHAR)
      WHEN 1 THEN l_linenumber || '-' || (l_linenumber + CAST(l_quantity AS INT) % 9)
      WHEN 2 THEN l_linenumber || ', ' || (CAST(l_quantity AS INT) % 12) WHEN 3 THEN '' ELSE 'A-' || l_linenumber END"""
LINES_SQL = f"(SELECT l_orderkey, l_linenumber, l_partkey, {RANGE_SQL} AS r, CAST(l_quantity AS INT) % 12 AS pg FROM lineitem)"


def line_ranges(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.expr(RANGE_SQL.replace("VARCHAR", "STRING")).alias("r"),
        F.expr("cast(l_quantity as int) % 12").alias("pg"),
    )


@query(
    "page_matches_b7",
    rf"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r = '' THEN false
          WHEN regexp_matches(r, '^\d+$') THEN CAST(r AS BIGINT) = pg
          WHEN regexp_matches(r, '^\d+-\d+$') THEN pg BETWEEN CAST(split_part(r, '-', 1) AS BIGINT) AND CAST(split_part(r, '-', 2) AS BIGINT)
          WHEN contains(r, ',') THEN list_contains(list_transform(string_split(r, ','), lambda x: trim(x)), CAST(pg AS VARCHAR))
          ELSE r = CAST(pg AS VARCHAR) END AS hit FROM {LINES_SQL}""",
)
def page_matches_b7(t):
    return line_ranges(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", pages.page_matches(F.col("r"), F.col("pg")).alias("hit")
    )


@query(
    "page_label_b8",
    rf"""SELECT l_orderkey, l_linenumber, l_partkey,
          CAST(NULLIF(regexp_extract(r, '(\d+)', 1), '') AS BIGINT) AS first_page,
          CASE WHEN r = '' THEN NULL
               WHEN regexp_matches(r, '^\d+-\d+$') AND split_part(r, '-', 1) = split_part(r, '-', 2) THEN 'p.' || split_part(r, '-', 1)
               WHEN regexp_matches(r, '^\d+-\d+$') THEN 'p.' || split_part(r, '-', 1) || '~p.' || split_part(r, '-', 2)
               WHEN regexp_matches(r, '^\d+$') THEN 'p.' || r ELSE 'p.' || replace(r, '-', '~') END AS label,
          CAST(CASE WHEN regexp_matches(r, '^\d+$') THEN r
               WHEN regexp_matches(r, '^\d+-\d+$') AND split_part(r, '-', 1) = split_part(r, '-', 2) THEN split_part(r, '-', 1) END AS BIGINT) AS single
        FROM {LINES_SQL}""",
)
def page_label_b8(t):
    r = F.col("r")
    return line_ranges(t).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        pages.first_page(r).alias("first_page"),
        pages.page_label(r).alias("label"),
        pages.single_page(r).alias("single"),
    )


@query(
    "for_machine_b10",
    "SELECT doc_id, source FROM documents WHERE list_contains([lang, source], 'src1')",
)
def for_machine_b10(t):
    from ..operators.catalog import for_machine

    docs = t.documents.withColumn("machine_code", F.array("lang", "source"))
    return for_machine(docs, "machine_code", "src1").select("doc_id", "source")


@query(
    "where_filter_b11",
    """SELECT doc_id, lang FROM documents WHERE lang <> 'de' AND source IN ('src1', 'src2', 'src3', 'src4')
       AND list_contains([lang, source], source) AND (contains(text, 'the') OR contains(text, 'de '))""",
)
def where_filter_b11(t):
    from ..operators.catalog import where_filter

    docs = t.documents.withColumn("machine_code", F.array("lang", "source"))
    where = {"$and": [{"lang": {"$ne": "de"}}, {"source": {"$in": ["src1", "src2", "src3", "src4"]}}]}
    text = {"$or": [{"$contains": "the"}, {"$contains": "de "}]}
    return where_filter(docs, where, "text", text).select("doc_id", "lang")


ROUTE_SQL = f"""SELECT item_id, q,
  CASE WHEN regexp_matches(lower(q), '보수\\s*(매뉴얼|메뉴얼|설명서)') THEN 'maintenance'
       WHEN regexp_matches(lower(q), '(장비|기계)\\s*(매뉴얼|메뉴얼|설명서|파라미터)') THEN 'any'
       WHEN regexp_matches(lower(q), '파라미터|파라메[터타]|매개변수|parameter') THEN 'parameter'
       WHEN regexp_matches(lower(q), '조작|운전\\s*순서') THEN 'operation' END AS purpose,
  CASE WHEN regexp_matches(lower(q), '보수\\s*(매뉴얼|메뉴얼|설명서)') THEN CASE WHEN regexp_matches(lower(q), '컨트롤러|제어기|cnc|fanuc|화낙') THEN 'controller' ELSE 'manual' END
       WHEN regexp_matches(lower(q), '(장비|기계)\\s*(매뉴얼|메뉴얼|설명서|파라미터)') THEN 'manual'
       WHEN regexp_matches(lower(q), '파라미터|파라메[터타]|매개변수|parameter') THEN 'controller'
       WHEN regexp_matches(lower(q), '컨트롤러|제어기|cnc|fanuc|화낙') THEN 'controller' ELSE 'manual' END AS doc_group
  FROM (SELECT item_id, text || ' ' || {sql_phrase('item_id')} AS q FROM benchmark)"""


def manual_catalog(t):
    """Suppliers as registered manuals: group and purpose from the key."""
    return t.supplier.select(
        F.col("s_name").alias("filename"),
        F.when(F.col("s_suppkey") % 2 == 0, "manual").otherwise("controller").alias("doc_group"),
        F.element_at(
            F.array(*map(F.lit, ("operation", "maintenance", "parameter"))), (F.col("s_suppkey") % 3 + 1).cast("int")
        ).alias("manual_type"),
    )


@query(
    "route_manual_b12",
    f"""WITH r AS ({ROUTE_SQL}), c AS (
          SELECT s_name AS filename, CASE WHEN s_suppkey % 2 = 0 THEN 'manual' ELSE 'controller' END AS doc_group,
                 list_extract(['operation', 'maintenance', 'parameter'], CAST(s_suppkey % 3 + 1 AS INT)) AS manual_type FROM supplier)
        SELECT r.item_id, r.doc_group, r.purpose, c.filename FROM r LEFT JOIN c
          ON c.doc_group = r.doc_group AND (r.purpose = 'any' OR r.purpose = c.manual_type)""",
)
def route_manual_b12(t):
    from ..operators.catalog import route_manual

    q = t.benchmark.select("item_id", F.concat("text", F.lit(" "), phrase(F.col("item_id"))).alias("q"))
    return route_manual(q, "q", manual_catalog(t)).select("item_id", "doc_group", "purpose", "filename")


@query(
    "rule_intent_b13",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(q), '반복|계속|재발|패턴|근본 원인|원인 분석') THEN 'root_cause_analysis'
          WHEN regexp_matches(lower(q), '부품|도면|좌표|주소|km|fr|qf|sq|yv|[xy][0-9]+') THEN 'part_identification'
          WHEN regexp_matches(lower(q), '뜻|의미|설명|개념|무슨 말|뭐야') THEN 'concept_explanation'
          WHEN regexp_matches(lower(q), '지금|바로|먼저|뭐 해야|어떻게|조치|멈췄|멈춤|안돼|안 돼') THEN 'emergency_action' END AS intent
        FROM {CHAT_SQL}""",
)
def rule_intent_b13(t):
    return chat_questions(t).select("conv_id", "turn", rules.rule_intent(F.col("q")).alias("intent"))


@query(
    "expand_query_b14",
    f"""SELECT item_id, profile, search_terms, md5(CASE WHEN search_terms IS NULL THEN q ELSE q || chr(10) || search_terms END) AS expanded
        FROM (SELECT *, CASE profile WHEN 'gun_coolant' THEN 'CLTGUN GUN CLT GUNCLT' WHEN 'through_coolant' THEN 'THR CLT THRU CLT SP THR CLT'
                WHEN 'jet_coolant' THEN 'JET CLT JETCLT' WHEN 'coolant_cooler' THEN 'CLT COOLER CLTCLR'
                WHEN 'standard_coolant' THEN 'CLTON CLTOF CLT PM M08 M09 CLTPMILK CLTPMON X102.2 X102.3 R590.0 R592.0 R32.1 Y0.1' END AS search_terms
          FROM (SELECT *, CASE WHEN regexp_matches(lower(q), '건클린|건 절삭유|건절삭유|gun coolant|cltgun|clt gun') THEN 'gun_coolant'
                WHEN regexp_matches(lower(q), '관통|스루|through|thru|tsc') THEN 'through_coolant'
                WHEN regexp_matches(lower(q), '젯|jet') THEN 'jet_coolant' WHEN regexp_matches(lower(q), '쿨러|냉각기|cooler') THEN 'coolant_cooler'
                WHEN regexp_matches(lower(q), '절삭유|coolant|clt') THEN 'standard_coolant' END AS profile
            FROM (SELECT item_id, text || ' ' || {sql_phrase('item_id')} AS q FROM benchmark)))""",
)
def expand_query_b14(t):
    q = t.benchmark.select("item_id", F.concat("text", F.lit(" "), phrase(F.col("item_id"))).alias("q"))
    out = rules.expand_query(q, "q")
    return out.select("item_id", "profile", "search_terms", F.md5("expanded_query").alias("expanded"))


ADDR_SQL = "substr('XYRFGATCKDEPZ', CAST(p_partkey % 13 + 1 AS INT), 1) || lpad(CAST(p_size AS VARCHAR), 3, '0') || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || (p_partkey % 8) END"


def part_addresses(t):
    return t.part.select("p_partkey", "p_name", F.expr(ADDR_SQL.replace("VARCHAR", "STRING")).alias("raw"))


@query(
    "address_b15",
    f"""SELECT p_partkey, upper(dev) || w || CASE WHEN b = '' THEN '' ELSE '.' || b END AS address,
          dev || CASE WHEN length(w) < 3 THEN lpad(w, 3, '0') ELSE w END || b AS drawing_code,
          CASE dev WHEN 'X' THEN 'input' WHEN 'Y' THEN 'output' WHEN 'R' THEN 'internal_relay' WHEN 'F' THEN 'cnc_to_pmc'
            WHEN 'G' THEN 'pmc_to_cnc' WHEN 'A' THEN 'alarm' WHEN 'T' THEN 'timer' WHEN 'C' THEN 'counter' WHEN 'K' THEN 'keep_relay'
            WHEN 'D' THEN 'data_register/data_memory' WHEN 'E' THEN 'shared_memory' WHEN 'P' THEN 'program/parameter/etc' ELSE 'unknown' END AS signal_type
        FROM (SELECT p_partkey, substr(raw, 1, 1) AS dev, CAST(CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS w,
                regexp_extract(raw, '\\.([0-9]+)$', 1) AS b FROM (SELECT p_partkey, {ADDR_SQL} AS raw FROM part))""",
)
def address_b15(t):
    raw = F.col("raw")
    return part_addresses(t).select(
        "p_partkey",
        T.address(raw).alias("address"),
        T.drawing_code(raw).alias("drawing_code"),
        T.signal_type(F.substring(raw, 1, 1)).alias("signal_type"),
    )


@query(
    "term_rlike_b16",
    r"""SELECT doc_id, regexp_matches(lower(text), '(?:^|[^a-z0-9])on\s+the(?:$|[^a-z0-9])|(?:^|[^a-z0-9])of(?:$|[^a-z0-9])|비[^\S\n]*상[^\S\n]*정[^\S\n]*지') AS hit
        FROM documents""",
)
def term_rlike_b16(t):
    return t.documents.select("doc_id", T.term_rlike(F.col("text"), ["on the", "of", "비상 정지"]).alias("hit"))


@query(
    "clean_alarm_b20",
    """SELECT event_id, CASE WHEN raw IS NULL THEN 'missing' END AS problem, CASE WHEN c NOT IN ('', '-') THEN c END AS code
       FROM (SELECT event_id, raw, trim(replace(raw, chr(1), '')) AS c FROM (SELECT event_id,
         CASE event_type WHEN 'error' THEN ' AL' || user_id || chr(1) || ' ' WHEN 'view' THEN ' - ' WHEN 'click' THEN '' WHEN 'signup' THEN NULL ELSE 'OP' END AS raw FROM events))""",
)
def clean_alarm_b20(t):
    from ..streaming.alarms import clean_tag

    raw = F.expr(
        "CASE event_type WHEN 'error' THEN ' AL' || user_id || chr(1) || ' ' WHEN 'view' THEN ' - ' "
        "WHEN 'click' THEN '' WHEN 'signup' THEN NULL ELSE 'OP' END"
    )
    tag = clean_tag(raw, control="\\x01")
    return t.events.select("event_id", tag.problem.alias("problem"), tag.code.alias("code"))


@query(
    "rate_band_b21",
    """SELECT o_orderkey, CASE WHEN r < 30 THEN 'danger' WHEN r < 50 THEN 'warning' ELSE 'good' END AS report,
              CASE WHEN r = 0 THEN 'idle' WHEN r < 30 THEN 'warn' WHEN r < 70 THEN 'watch' ELSE 'good' END AS equipment
       FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 100 AS r FROM orders)""",
)
def rate_band_b21(t):
    r = F.floor("o_totalprice") % 100
    return t.orders.select("o_orderkey", bands.report_band(r).alias("report"), bands.equipment_band(r).alias("equipment"))


@query(
    "risk_label_b22",
    """SELECT o_orderkey, CASE WHEN d < 0 THEN '+' || abs(d) || '일' WHEN d = 0 THEN 'D-DAY' ELSE 'D-' || d END AS label,
              CASE WHEN d < 0 THEN 'overdue' WHEN d <= 7 THEN 'danger' ELSE 'watch' END AS tone,
              CASE WHEN done = 0 THEN 'not-started' WHEN done / 7.0 >= 0.8 THEN 'near-complete' WHEN done / 7.0 >= 0.5 THEN 'progress' ELSE 'early' END AS progress
       FROM (SELECT o_orderkey, date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS d, o_custkey % 8 AS done FROM orders)""",
)
def risk_label_b22(t):
    d = F.date_diff(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date"))
    return t.orders.select(
        "o_orderkey",
        bands.risk_label(d).alias("label"),
        bands.risk_tone(d).alias("tone"),
        bands.progress_tone(F.col("o_custkey") % 8, F.lit(7)).alias("progress"),
    )


@query(
    "duration_text_b23",
    """SELECT event_id, (m // 60) || '시간 ' || (m % 60) || '분' AS hours,
         CASE WHEN s >= 3600 THEN (s // 3600) || '시간 ' || ((s % 3600) // 60) || '분' WHEN s >= 60 THEN (s // 60) || '분 ' || (s % 60) || '초'
              ELSE s || '초' END AS duration,
         CASE WHEN s = 3600 THEN 'neutral' WHEN s > 3600 THEN 'danger' ELSE 'good' END AS direction,
         CASE WHEN s > 3600 THEN '+' WHEN s < 3600 THEN '-' ELSE '' END || (d // 60) || '시간 ' || (d % 60) || '분' AS change
       FROM (SELECT event_id, s, CAST(round_even(s / 60.0, 0) AS BIGINT) AS m, CAST(floor(abs(CAST(s - 3600 AS DOUBLE) / 3600) * 60 + 0.5) AS BIGINT) AS d FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events))""",
)
def duration_text_b23(t):
    s = F.floor(F.col("value") * 60)
    return t.events.select(
        "event_id",
        bands.hours_text(s).alias("hours"),
        bands.duration_text(s).alias("duration"),
        bands.delta_direction(s - 3600, False).alias("direction"),
        bands.delta_text((s - 3600) / 3600, "hours").alias("change"),
    )


@query(
    "kst_label_b24",
    """SELECT event_id, CASE WHEN raw = '' THEN '미확인' WHEN raw = 'bad' THEN '시각 확인 불가' WHEN NOT ends_with(raw, 'Z') THEN '시간대 확인 불가'
         ELSE year(k) || '년 ' || month(k) || '월 ' || day(k) || '일 ' || CASE WHEN hour(k) < 12 THEN '오전 ' ELSE '오후 ' END
              || CASE WHEN hour(k) % 12 = 0 THEN 12 ELSE hour(k) % 12 END || '시 ' || strftime(k, '%M분 %S초 (한국 시간)') END AS label
       FROM (SELECT event_id, ts + INTERVAL 9 HOUR AS k, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'bad'
              WHEN 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS raw FROM events)""",
)
def kst_label_b24(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(F.col("event_type") == "view", "")
        .when(F.col("event_type") == "click", "bad")
        .when(F.col("event_type") == "signup", stamp)
        .otherwise(F.concat(stamp, F.lit("Z")))
    )
    return t.events.select("event_id", bands.kst_label(raw).alias("label"))


@query(
    "prev_report_date_b25",
    """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - CASE WHEN isodow(o_orderdate) = 1 THEN 3 ELSE 1 END, '%Y-%m-%d') AS previous,
         CAST(o_orderdate AS DATE) <= DATE '1995-06-30' AS allowed FROM orders""",
)
def prev_report_date_b25(t):
    now = F.lit("1995-06-30 16:00:00").cast("timestamp")  # already the first of July in UTC+9
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", bands.prev_report_date(day).cast("string").alias("previous"), bands.report_date_allowed(day, now).alias("allowed"))


@query(
    "anonymise_b26",
    """SELECT doc_id, md5(trim(replace(replace(text, source, ''), lang, ''))) AS work FROM documents""",
)
def anonymise_b26(t):
    from ..operators.catalog import anonymise

    docs = t.documents.withColumn("document", F.concat("source", F.lit(" 작업내용:"), "text"))
    return anonymise(docs, "document", ["source", "lang"]).select("doc_id", F.md5("document").alias("work"))


@query(
    "is_period_question_b27",
    rf"""SELECT conv_id, turn, regexp_matches(q, '[0-9]{{4}}\s*[-./년]\s*[0-9]{{1,2}}\s*[-./월]\s*[0-9]{{1,2}}|[0-9]{{4}}\s*년|[0-9]{{1,2}}\s*월|(^|[^0-9])(0?[1-9]|1[0-2])[/\-](0?[1-9]|[12][0-9]|3[01])([^0-9]|$)')
           OR regexp_matches(q, '언제|날짜|일자|며칠|몇\s*년|몇\s*월|수집일|생성일|저장일|오늘|어제|그제|내일|지난\s*(주|달|월)|이번\s*(주|달|월)|금주|전주|부터|까지|기준일(은|이)?\s*(뭐|무엇|알려|말해|확인)')
           OR contains(replace(q, '지속기간', ''), '기간') AS period
         FROM {CHAT_SQL}""",
)
def is_period_question_b27(t):
    return chat_questions(t).select("conv_id", "turn", rules.is_period_question(F.col("q")).alias("period"))


@query(
    "parse_command_b28",
    rf"""SELECT conv_id, turn, CASE WHEN NOT (c <> '' OR regexp_matches(lower(q), '(열어|보여|띄워|펼쳐|(열람|표시|오픈)해)\s*(줘|주세요|줄래)|(열어|보여|띄워|펼쳐|열기|열람)[.!?]?\s*$|\bopen\b|\bshow\b'))
             OR regexp_matches(q, '(열|띄울|보여줄)\s*필요\s*없|(열지|띄우지|보여주지)\s*(마|말)') THEN 'none' WHEN c <> '' THEN 'choice' ELSE 'open' END AS kind,
           CAST(coalesce(NULLIF(regexp_extract(lower(q), '(-?[0-9]+)\s*(?:페이지|쪽)|(?:페이지|page|p\.)\s*(-?[0-9]+)', 1), ''),
                NULLIF(regexp_extract(lower(q), '(-?[0-9]+)\s*(?:페이지|쪽)|(?:페이지|page|p\.)\s*(-?[0-9]+)', 2), '')) AS BIGINT) AS page,
           CASE WHEN regexp_matches(q, '첫\s*번째') THEN 1 WHEN regexp_matches(q, '두\s*번째') THEN 2 WHEN regexp_matches(q, '세\s*번째') THEN 3 END AS ordinal
         FROM (SELECT *, regexp_extract(q, '^\s*([0-9]+)\s*번?$', 1) AS c FROM {CHAT_SQL})""",
)
def parse_command_b28(t):
    command = rules.parse_command(F.col("q"))
    return chat_questions(t).select(
        "conv_id", "turn", command.kind.alias("kind"), command.page.alias("page"), command.ordinal.alias("ordinal")
    )


@query(
    "excerpt_b29",
    r"""SELECT doc_id, md5(CASE WHEN length(text) <= 700 THEN text ELSE
          regexp_replace(CASE WHEN p > 0 AND 700 - p >= 350 THEN substr(text, 1, 700 - p) ELSE substr(text, 1, 700) END, '\s+$', '') || chr(10) || '[...]' END) AS excerpt
        FROM (SELECT doc_id, text, instr(reverse(substr(text, 1, 700)), chr(10)) AS p FROM documents)""",
)
def excerpt_b29(t):
    return t.documents.select("doc_id", F.md5(T.excerpt(F.col("text"), 700, "\n[...]")).alias("excerpt"))


@query(
    "clean_titles_b30",
    r"""SELECT doc_id, md5(regexp_replace(body, '(?m)^.*\.{3,}\s*[\d-]+[ \t]*$', '', 'g')) AS body,
          CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 AND first_line <> '' THEN substr(first_line, 1, 120) ELSE 'p.' || doc_id END AS title
        FROM (SELECT doc_id, source, 'intro ..... 12' || chr(10) || text AS body,
                trim(coalesce(list_extract(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '[\x00-\x08\x0b-\x1f\x7f-\x9f\x{FFFD}]')), 1), '')) AS first_line FROM documents)""",
)
def clean_titles_b30(t):
    body = F.concat(F.lit("intro ..... 12\n"), F.col("text"))
    titles = (
        F.when(F.col("doc_id") % 3 == 0, F.array("source"))
        .when(F.col("doc_id") % 3 == 1, F.array(F.lit("\x01")))
        .otherwise(F.array(F.lit("")))
    )
    fallback = F.concat(F.lit("p."), F.col("doc_id").cast("string"))
    return t.documents.select(
        "doc_id",
        F.md5(T.drop_contents_lines(body)).alias("body"),
        T.readable_title(titles, F.split("text", "\n"), fallback).alias("title"),
    )


@query(
    "passage_b31",
    """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'passage: ' || source || chr(10) || text ELSE 'passage: ' || text END) AS passage FROM documents""",
)
def passage_b31(t):
    section = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(" "))
    return t.documents.select("doc_id", F.md5(T.passage(section, F.col("text"))).alias("passage"))


@query(
    "warning_icon_modes_b32",
    f"""SELECT conv_id, turn, regexp_matches(label, '^(warning|caution|danger)( (sign|icon))*$') AS icon, mode, active FROM (
          SELECT conv_id, turn, CASE role WHEN 'user' THEN 'warning sign' WHEN 'system' THEN 'danger zone diagram' ELSE 'caution' END AS label,
            CASE WHEN contains(q, 'AUTO 모드') THEN 'AUTO' ELSE '' END AS mode,
            regexp_matches(lower(q), '(^|[^a-z0-9])auto\\s*모드에서') AND NOT regexp_matches(lower(q), '아니|아닌|않|꺼|해제|인지|라면|가정|\\bif\\b|disabled|not ') AS active FROM {CHAT_SQL})""",
)
def warning_icon_modes_b32(t):
    label = (
        F.when(F.col("role") == "user", "warning sign: by the door")
        .when(F.col("role") == "system", "danger zone diagram")
        .otherwise("caution")
    )
    q = F.col("q")
    return chat_questions(t).select(
        "conv_id",
        "turn",
        rules.is_warning_icon(label).alias("icon"),
        F.array_join(rules.modes(q), ",").alias("mode"),
        rules.mode_active(q, F.lit("AUTO")).alias("active"),
    )
