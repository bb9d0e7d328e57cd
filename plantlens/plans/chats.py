"""Bindings of the conversation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import citation_labels
from ..operators import chat
from .bindings import top_sql
from .registry import query

MSG_SQL = """(SELECT conv_id AS session, turn AS pos, role, CASE WHEN role = 'system' THEN '[SUMMARY] ' || text ELSE text END AS text,
    CASE WHEN conv_id % 7 = 3 THEN 'cancelled' WHEN conv_id % 7 = 4 THEN 'completed' END AS status, (conv_id + turn) % 11 = 0 AS failed FROM conversations)"""


def messages(t):
    text = F.when(F.col("role") == "system", F.concat(F.lit("[SUMMARY] "), F.col("text"))).otherwise(F.col("text"))
    status = F.when(F.col("conv_id") % 7 == 3, "cancelled").when(F.col("conv_id") % 7 == 4, "completed")
    return t.conversations.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", text.alias("text"), status.alias("status"),
        ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("failed"),
    )


PAIR_SQL = f"""SELECT session, pos, a_pos, md5(text) AS question, md5(answer) AS answer FROM (SELECT *, lead(role) OVER w AS r2, lead(pos) OVER w AS a_pos, lead(text) OVER w AS answer,
    lead(status) OVER w AS s2, lead(failed) OVER w AS f2 FROM {MSG_SQL} WINDOW w AS (PARTITION BY session ORDER BY pos))
    WHERE role = 'user' AND r2 = 'assistant' AND text <> '' AND answer <> '' AND coalesce(s2, 'completed') = 'completed' AND NOT f2"""


@query("completed_turns_f10", PAIR_SQL)
def completed_turns_f10(t):
    out = chat.completed_turns(messages(t))
    return out.select("session", "pos", "a_pos", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


SLOT_SQL = f"""WITH m AS (SELECT *, starts_with(text, '[SUMMARY]') AS sm FROM {MSG_SQL}), p AS (SELECT *, lag(role) OVER w AS pr, lag(sm) OVER w AS ps FROM m WINDOW w AS (PARTITION BY session ORDER BY pos)),
    s AS (SELECT *, sum(CASE WHEN role = 'assistant' AND NOT sm AND coalesce(pr = 'user' AND NOT ps, false) THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY pos) AS slot FROM p)
    SELECT session, pos, role FROM (SELECT *, max(slot) OVER (PARTITION BY session) AS top FROM s) WHERE slot > top - {{k}}"""


@query("last_slots_f11", SLOT_SQL.format(k=2))
def last_slots_f11(t):
    return chat.last_slots(messages(t), 2).select("session", "pos", "role")


@query("context_window_p5", SLOT_SQL.format(k=3).replace("SELECT session, pos, role FROM (", "SELECT session, count(*) AS n_messages, min(pos) AS from_pos FROM (") + " GROUP BY session")
def context_window_p5(t):
    return chat.last_slots(messages(t), 3).groupBy("session").agg(F.count("*").alias("n_messages"), F.min("pos").alias("from_pos"))


SESSION_SQL = """(SELECT conv_id AS session, CASE WHEN conv_id % 3 = 0 THEN 'plant_a' ELSE 'plant_b' END AS factory, conv_id % 25 AS machine_code, conv_id % 6 AS prompt_no,
    min(substr(text, 1, 40)) FILTER (WHERE turn = 0) AS title, CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'user' || (conv_id % 4) END AS questioner, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"""


def sessions(t):
    c = F.col("conv_id")
    return t.conversations.groupBy("conv_id").agg(
        F.min(F.when(F.col("turn") == 0, F.substring("text", 1, 40))).alias("title"), F.max("turn").alias("updated_at")
    ).select(
        c.alias("session"), F.when(c % 3 == 0, "plant_a").otherwise("plant_b").alias("factory"), (c % 25).alias("machine_code"), (c % 6).alias("prompt_no"), "title",
        F.when(c % 5 == 0, "").when(c % 5 != 1, F.concat(F.lit("user"), (c % 4).cast("string"))).alias("questioner"), "updated_at",
    )


@query(
    "session_list_p1",
    f"""SELECT session, updated_at, title, r_name AS prompt_name, n_name AS machine_name FROM {SESSION_SQL} LEFT JOIN region ON r_regionkey = prompt_no LEFT JOIN nation ON n_nationkey = machine_code WHERE factory = 'plant_a'""",
)
def session_list_p1(t):
    prompts = t.region.select(F.col("r_regionkey").cast("bigint").alias("prompt_no"), F.col("r_name").alias("prompt_name"))
    names = t.nation.select(F.col("n_nationkey").cast("bigint").alias("machine_code"), F.col("n_name").alias("machine_name"))
    return chat.session_list(sessions(t), prompts, names, "plant_a", "ALL").select("session", "updated_at", "title", "prompt_name", "machine_name")


@query(
    "customer_of_order_d11",
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'MACHINERY'",
)
def customer_of_order_d11(t):
    names = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(names, "o_custkey", "left").select("o_orderkey", "c_name")


FEED_SQL = "(SELECT doc_id AS session, 1 AS pos, quality AS feedback, CASE WHEN toxic = 1 THEN ' reason ' || doc_id ELSE '' END AS reason FROM labels)"


def feedback(t):
    reason = F.when(F.col("toxic") == 1, F.concat(F.lit(" reason "), F.col("doc_id").cast("string"))).otherwise("")
    return t.labels.select(F.col("doc_id").alias("session"), F.lit(1).cast("bigint").alias("pos"), F.col("quality").alias("feedback"), reason.alias("reason"))


ANSWER_SQL = f"""(SELECT a.session, a.pos, q.pos AS question_order, substr(q.text, 1, 300) AS question_preview, substr(a.text, 1, 300) AS answer_preview, feedback, reason
    FROM {MSG_SQL} a ASOF LEFT JOIN (SELECT * FROM {MSG_SQL} WHERE role = 'user') q ON q.session = a.session AND a.pos > q.pos LEFT JOIN {FEED_SQL} f ON f.session = a.session AND f.pos = a.pos WHERE a.role = 'assistant')"""


@query("answer_list_p2", f"SELECT session, pos, question_order, md5(question_preview) AS question, md5(answer_preview) AS answer FROM {ANSWER_SQL} WHERE feedback = 1")
def answer_list_p2(t):
    out = chat.answer_list(messages(t), feedback(t), 1)
    return out.select("session", "pos", "question_order", F.md5("question_preview").alias("question"), F.md5("answer_preview").alias("answer"))


@query("latest_reason_f12", f"SELECT session, coalesce(arg_max(trim(reason), pos) FILTER (WHERE trim(reason) <> ''), '') AS reason FROM {ANSWER_SQL} GROUP BY session")
def latest_reason_f12(t):
    return chat.latest_reason(chat.answer_list(messages(t), feedback(t))).withColumn("reason", F.coalesce("reason", F.lit("")))


@query(
    "history_search_p3",
    f"""SELECT session, title, coalesce(r, '') AS reason FROM {SESSION_SQL} JOIN (SELECT session, arg_max(trim(reason), pos) FILTER (WHERE trim(reason) <> '') AS r FROM {ANSWER_SQL} WHERE feedback = 1 GROUP BY session) USING (session)
        WHERE contains(lower(title), 'en') OR contains(lower(coalesce(questioner, '')), 'en')""",
)
def history_search_p3(t):
    answers = chat.answer_list(messages(t), feedback(t), 1)
    out = chat.history_search(sessions(t), answers, "sessions", "EN")
    return out.select("session", "title", F.coalesce("reason", F.lit("")).alias("reason"))


@query("history_messages_p3b", f"SELECT session, pos, questioner FROM {ANSWER_SQL} JOIN {SESSION_SQL} USING (session) WHERE trim(reason) <> '' AND (contains(lower(title), 'user') OR contains(lower(coalesce(questioner, '')), 'user'))")
def history_messages_p3b(t):
    answers = chat.answer_list(messages(t), feedback(t)).filter("trim(reason) <> ''")
    return chat.history_search(sessions(t), answers, "messages", "user").select("session", "pos", "questioner")


@query("questioner_counts_e10", f"SELECT coalesce(NULLIF(trim(questioner), ''), '-') AS questioner, count(*) AS n_sessions FROM {SESSION_SQL} GROUP BY 1")
def questioner_counts_e10(t):
    return chat.questioner_counts(sessions(t))


@query(
    "questioner_page_p4",
    f"""SELECT questioner, n_sessions, 1 AS page, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 3.0) AS INT) AS pages FROM (SELECT coalesce(NULLIF(trim(questioner), ''), '-') AS questioner, count(*) AS n_sessions
        FROM {SESSION_SQL} GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n_sessions DESC, questioner) <= 3""",
)
def questioner_page_p4(t):
    return chat.page_of(chat.questioner_counts(sessions(t)), [F.col("n_sessions").desc(), F.col("questioner")], 0, 3)


@query(
    "questioner_sessions_p4b",
    f"""WITH s AS (SELECT session, row_number() OVER (ORDER BY updated_at DESC, session DESC) AS r, count(*) OVER () AS total FROM {SESSION_SQL} WHERE trim(questioner) = 'user2'),
         n AS (SELECT *, CAST(ceil(total / 4.0) AS INT) AS pages FROM s)
       SELECT session, least(2, pages) AS page, total, pages FROM n WHERE (r - 1) // 4 + 1 = least(2, pages)""",
)
def questioner_sessions_p4b(t):
    order = [F.col("updated_at").desc(), F.col("session").desc()]
    return chat.questioner_sessions(sessions(t), " user2 ", order, 2, 4).select("session", "page", "total", "pages")


@query(
    "pagination_g4",
    """SELECT o_orderkey, 4 AS page, total, CAST(ceil(total / 25.0) AS INT) AS pages FROM (SELECT o_orderkey, count(*) OVER () AS total,
         row_number() OVER (ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r BETWEEN 76 AND 100""",
)
def pagination_g4(t):
    o = t.orders.withColumn("pinned", F.col("o_orderpriority") == "1-URGENT")
    order = [F.col("pinned").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return chat.page_of(o, order, 4, 25).select("o_orderkey", "page", "total", "pages")


@query(
    "clamped_page_g4b",
    """WITH n AS (SELECT count(*) AS total, CAST(ceil(count(*) / 100.0) AS INT) AS pages FROM customer)
       SELECT c_custkey, pages AS page, total, pages FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), n WHERE r > (pages - 1) * 100""",
)
def clamped_page_g4b(t):
    """A page far past the end, found by position."""
    order = [F.col("c_acctbal").desc(), F.col("c_custkey")]
    return chat.page_of(t.customer, order, 10**9, 100).select("c_custkey", "page", "total", "pages")


CITED = "text || ' [chunk:' || (turn % 3 + 1) || '] x [chunk:' || (conv_id % 4 + 1) || ']'"


@query(
    "used_chunks_p6",
    """WITH c AS (SELECT conv_id AS session, turn AS pos, unnest([turn % 3 + 1, conv_id % 4 + 1]) AS ci, unnest([1, 2]) AS p FROM conversations WHERE role = 'assistant'),
         l AS (SELECT session, pos, ci, CAST(row_number() OVER (PARTITION BY session, pos ORDER BY min(p)) AS INT) AS label FROM c GROUP BY session, pos, ci),
         h AS (SELECT session, pos, ci, label, CASE WHEN ci = 4 THEN 'chunk:4' ELSE 'img' || (ci // 2) END AS a FROM l)
       SELECT session, pos, arg_min(ci, label) AS chunk_index, min(label) AS label FROM h GROUP BY session, pos, a""",
)
def used_chunks_p6(t):
    answers = t.conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.expr(CITED).alias("answer"))
    cited = citation_labels(answers, ["session", "pos"], "answer")
    every = answers.select("session", "pos", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("chunk_index"))
    path = F.when(F.col("chunk_index") == 4, "").otherwise(F.concat(F.lit("img"), F.floor(F.col("chunk_index") / 2).cast("string")))
    return chat.used_chunks(cited, every.withColumn("asset_path", path)).select("session", "pos", "chunk_index", "label")


@query(
    "recent_plus_p7",
    f"SELECT session, pos FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS r FROM {MSG_SQL}) WHERE r <= 3 OR pos = session % 4",
)
def recent_plus_p7(t):
    m = messages(t).select("session", "pos", "role")
    selected = m.filter(F.col("pos") == F.col("session") % 4).select("session", "pos")
    return chat.recent_plus(m, selected, 3).select("session", "pos")


@query(
    "answer_status_p8",
    """SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS elapsed_ms, CASE WHEN trim(text) = '' THEN 'failed' WHEN conv_id % 7 = 3 THEN 'cancelled' ELSE 'completed' END AS answer_status,
         trim(text) = '' OR conv_id % 7 = 3 AS retry FROM conversations WHERE role = 'assistant'""",
)
def answer_status_p8(t):
    a = t.conversations.filter("role = 'assistant'").select(
        "conv_id", "turn", "text", F.when(F.col("conv_id") % 7 == 3, "cancelled").alias("status"), (F.col("turn") * 1000).alias("started_ms"),
        (F.col("turn") * 1000 + F.length("text")).cast("bigint").alias("finished_ms"),
    )
    return chat.answer_status(a).select("conv_id", "turn", "elapsed_ms", "answer_status", "retry")


@query(
    "answer_figures_p9",
    """SELECT conv_id AS session, turn AS pos, unnest(['a' || turn, 'r' || conv_id, 's1', 'i' || conv_id]) AS path FROM conversations WHERE role = 'assistant'""",
)
def answer_figures_p9(t):
    meta = F.expr(
        """'{"chunks":[{"index":1,"metadata":{"container_type":"pictures","asset_path":"a' || turn || '","related_assets":[{"container_type":"pictures","asset_path":"r' || conv_id ||
           '"},{"container_type":"tables","asset_path":"t"}]}},{"index":"2","metadata":{"container_type":"texts","asset_path":"no","source_kind":"paddleocr","page_image_paths":["s1"]}}],"images":["i' || conv_id || '"]}'"""
    )
    m = t.conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), meta.alias("meta"))
    return chat.answer_figures(m, "meta")


@query(
    "filter_questions_i18",
    rf"""WITH s AS (SELECT conv_id AS session, turn, turn % 2 AS source, unnest(string_split(text, '. ')) AS text, unnest(range(len(string_split(text, '. ')))) AS i FROM conversations),
          c AS (SELECT *, turn * 1000000 + i AS pos, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key FROM s),
          a AS (SELECT DISTINCT session, key FROM c WHERE turn = 2), k AS (SELECT * FROM c WHERE length(trim(text)) <= 200)
        SELECT session, pos, question_no FROM {top_sql(top_sql('(SELECT * FROM k ANTI JOIN a USING (session, key) WHERE key <> chr(32) AND length(key) > 0 AND (source = 0 OR session % 2 = 0))', 1, 'session, key', 'pos', 'r1'), 3, 'session', 'pos', 'question_no')}""",
)
def filter_questions_i18(t):
    """Every sentence is a candidate; those of the third turn are asked already; odd sessions know one source only."""
    said = t.conversations.select(
        F.col("conv_id").alias("session"), "turn", (F.col("turn") % 2).alias("source"), F.posexplode(F.split("text", r"\. ")).alias("i", "text"))
    c = said.withColumn("pos", F.col("turn") * 1000000 + F.col("i"))
    s = t.conversations.select(F.col("conv_id").alias("session")).distinct()
    sources = s.withColumn("source", F.lit(0).cast("bigint")).unionByName(s.filter("session % 2 = 0").withColumn("source", F.lit(1).cast("bigint")))
    return chat.filter_questions(c.drop("turn", "i"), said.filter("turn = 2").select("session", "text"), sources).select("session", "pos", "question_no")


@query(
    "collapse_progress_s7",
    """SELECT user_id, event_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n IS NULL OR n <> event_type""",
)
def collapse_progress_s7(t):
    log = t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("pos"), F.col("event_type").alias("message"))
    return chat.collapse_progress(log).select(F.col("job").alias("user_id"), F.col("pos").alias("event_id"), F.col("message").alias("event_type"))


@query(
    "run_bounds_s7b",
    """WITH f AS (SELECT *, event_type <> coalesce(lag(event_type) OVER w, '') AS st, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT user_id, event_id, (SELECT max(g.event_id) FROM f g WHERE g.user_id = f.user_id AND g.event_id <= f.event_id AND g.st) AS run_start FROM f WHERE n IS NULL OR n <> event_type""",
)
def run_bounds_s7b(t):
    log = t.events.select(F.col("user_id").alias("job"), F.col("event_id").alias("pos"), F.col("event_type").alias("message"))
    return chat.run_bounds(log).select(F.col("job").alias("user_id"), F.col("pos").alias("event_id"), "run_start")
