"""How the driver's tables stand for the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

LANGS_SQL = "(SELECT list_sort(list(DISTINCT lang)) FROM documents WHERE lang IS NOT NULL)"
LABELS_SQL = "(SELECT list_sort(list(DISTINCT label)) FROM embeddings)"

# questions: one row per benchmark passage, its own machine (language) and the mean vector of one label
CENTROID_SQL = """(SELECT label, list(round(a, 6) ORDER BY pos) AS cvec FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS a FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)"""
QUESTION_SQL = f"""(SELECT item_id AS qid, text AS qtext, 'ALL' AS part, list_extract({LANGS_SQL}, CAST(item_id % len({LANGS_SQL}) + 1 AS INT)) AS machine, cvec AS qvec
    FROM benchmark LEFT JOIN {CENTROID_SQL} ON label = list_extract({LABELS_SQL}, CAST(item_id % len({LABELS_SQL}) + 1 AS INT)))"""
DOCS_SQL = "(SELECT doc_id AS id, text, source AS doc, lang AS machine, 'ALL' AS part, doc_id // 20 AS page FROM documents)"
VECS_SQL = """(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, lang AS machine, source AS doc, label, 'ALL' AS part
    FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"""


def centroids(t):
    """Mean vector per label; a list has as many entries as the vectors have dimensions."""
    pos = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = pos.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("a"))
    return mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("v")).select(
        "label", F.transform("v", lambda e: e.a).alias("cvec")
    )


def questions(t):
    """Languages and labels in turn, as many as the tables have."""

    def in_turn(df, name):
        values = df.agg(F.array_sort(F.collect_set(name)).alias("v")).scalar()
        return F.get(values, (F.col("item_id") % F.size(values)).cast("int"))

    q = t.benchmark.select(
        F.col("item_id").alias("qid"), F.col("text").alias("qtext"), F.lit("ALL").alias("part"), in_turn(t.documents, "lang").alias("machine"),
        in_turn(t.embeddings, "label").alias("label"),
    )
    return q.join(centroids(t), "label", "left").select("qid", "qtext", "part", "machine", F.col("cvec").alias("qvec"))


def docs(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("doc"), F.col("lang").alias("machine"),
        F.lit("ALL").alias("part"), F.floor(F.col("doc_id") / 20).alias("page"),
    )


def vecs(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("machine"), F.col("source").alias("doc"))
    v = t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label", F.lit("ALL").alias("part")
    )
    return v.join(d, "id", "left")


TOKEN_SQL = r"'[A-Za-z]+\.?\d*\.?\d*|[가-힣]+|\d+'"


def bm25_sql(q: str, d: str, part: str, keep_zero: bool = True) -> str:
    """CTEs ending in bm(part, qid, id, score) over relations q(qid, qtext, part) and d(id, text, part)."""
    every = f"SELECT q.{part} AS part, qid, id, 0.0 AS z FROM {q} q JOIN {d} d ON q.{part} = d.{part}"
    final = (
        f"SELECT part, qid, id, coalesce(score, 0.0) AS score FROM ({every}) LEFT JOIN sc USING (part, qid, id)"
        if keep_zero
        else "SELECT part, qid, id, score FROM sc WHERE score > 0"
    )
    return rf"""tk AS (SELECT {part} AS part, id, regexp_extract_all(lower(text), {TOKEN_SQL}) AS tk FROM {d}),
      dl AS (SELECT part, id, len(tk) AS dl FROM tk), tot AS (SELECT part, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY part),
      tf AS (SELECT part, id, term, count(*) AS tf FROM (SELECT part, id, unnest(tk) AS term FROM tk) GROUP BY ALL),
      raw AS (SELECT part, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT part, term, count(*) AS df FROM tf GROUP BY ALL) JOIN tot USING (part)),
      idf AS (SELECT part, term, df, CASE WHEN r < 0 THEN f ELSE r END AS idf FROM raw JOIN (SELECT part, 0.25 * avg(r) AS f FROM raw GROUP BY part) USING (part)),
      qt AS (SELECT part, qid, term, count(*) AS c FROM (SELECT {part} AS part, qid, unnest(regexp_extract_all(lower(qtext), {TOKEN_SQL})) AS term FROM {q}) GROUP BY ALL),
      sc AS (SELECT part, qid, id, round(sum(c * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 6) AS score
             FROM qt JOIN idf USING (part, term) JOIN tf USING (part, term) JOIN dl USING (part, id) JOIN tot USING (part) GROUP BY ALL),
      bm AS ({final})"""


def cosine_sql(q: str, v: str, part: str) -> str:
    """CTE vs(qid, id, score) of every query and vector of the same part."""
    return f"vs AS (SELECT qid, id, round(list_dot_product(qvec, vec), 6) AS score FROM {q} q JOIN {v} v ON q.{part} = v.{part})"


def top_sql(rel: str, k: int, keys: str = "qid", order: str = "score DESC, id", rank: str = "rank") -> str:
    return f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS INT) AS {rank} FROM {rel}) WHERE {rank} <= {k})"""


def near_sql(k: int, rel: str = "vs") -> str:
    """Top k with the larger id kept at the cut and the smaller id first in the output."""
    kept = f"(SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS r0 FROM {rel}) WHERE r0 <= {k})"
    return top_sql(kept, k)


# status history: one row per event
STATUS_SQL = """(SELECT event_id, user_id AS machine_code, ts AS occur_date, CAST(floor(value * 60) AS BIGINT) AS operate_period,
    CASE event_type WHEN 'view' THEN '0' WHEN 'purchase' THEN '1' WHEN 'error' THEN '2' ELSE '3' END AS status,
    CASE WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INT) % 10 > 0 THEN 'AL' || json_extract_string(props, '$.k') END AS alarm_code FROM events)"""


def status_history(t):
    k = F.get_json_object("props", "$.k")
    status = (
        F.when(F.col("event_type") == "view", "0").when(F.col("event_type") == "purchase", "1")
        .when(F.col("event_type") == "error", "2").otherwise("3")
    )
    alarm = F.when((F.col("event_type") == "error") & (k.cast("int") % 10 > 0), F.concat(F.lit("AL"), k))
    return t.events.select(
        "event_id", F.col("user_id").alias("machine_code"), F.col("ts").cast("timestamp").alias("occur_date"),
        F.floor(F.col("value") * 60).alias("operate_period"), status.alias("status"), alarm.alias("alarm_code"),
    )
