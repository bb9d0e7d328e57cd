"""Bindings of markup, model-output, citation and chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import let, match_text
from ..operators import chunking
from .registry import query

SPEC = {
    "order_no": {"source": "o_orderkey", "type": "int", "default": 0},
    "amount": {"source": ["missing_amount", "price_text"], "type": "float", "default": 0.0},
    "priority": {"source": "o_orderpriority", "type": "str", "default": "-"},
    "pieces": {"source": "pieces_text", "type": "int", "default": -1},
    "note": {"source": "missing_note", "type": "str", "default": "none"},
}


@query(
    "project_spec_b9",
    """SELECT o_orderkey AS order_no, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount, trim(o_orderpriority) AS priority,
         CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE 1000 + o_custkey % 3 END AS pieces, 'none' AS note FROM orders""",
)
def project_spec_b9(t):
    df = (
        t.orders.withColumn("price_text", F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
        .withColumn(
            "pieces_text",
            F.when(F.col("o_custkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit("1,00"), (F.col("o_custkey") % 3).cast("string"), F.lit(".7"))),
        )
    )
    return parse.project_spec(df, SPEC)


PICTURES = ("Warning sign: hot", "Diagram of a warning: pump", "경고 표지", "Fuse &amp; box &copy;", "")
PAGE_SQL = f"""(SELECT page_id, '<td>k</td><IMG src="a.png" alt="' || label || '"/>' || html || chr(10) || '**[그림] ' || label || '** note' || chr(10) || '  - more' || chr(10)
    || 'rest ![' || label || '](x.png) end' AS html FROM (SELECT *, list_extract({list(PICTURES)}, CAST(page_id % 5 + 1 AS INT)) AS label FROM pages))"""
MARKUP_SQL = PAGE_SQL
for _pattern, _text in (
    (r"(?s)<!--.*?-->", ""), (r"(?is)<script\b[^>]*>.*?</script\s*>", ""), (r"(?is)<style\b[^>]*>.*?</style\s*>", ""), ("<![^>]*>", ""),
    (r'(?i)<img src="a.png" alt="(?:Warning sign: hot|경고 표지|)"/>', ""), (r'(?i)<img src="a.png" alt="([^"]*)"/>', r"\n[그림 설명] \1\n"),
    (r"(?i)<(tr|div|p|br|table)(\s[^>]*)?/?>", r"\n"), (r"(?i)</(td|th)\s*>", " | "), (r"(?i)</(tr|div|p|table)\s*>", r"\n"), ("</?[a-zA-Z][^>]*>", ""),
    ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;?", "&"),
    (r"\*\*\[그림\] (Warning sign: hot|경고 표지)\*\* note\n  - more", ""), (r"!\[(Warning sign: hot|경고 표지)\]\(x.png\)", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", r"[그림 설명] \1"), (r"\n[ \t]*\n([ \t]*\n)+", r"\n\n"), (r"^\s+|\s+$", ""),
):  # newlines are written as chr(10), since the engine reads \n in patterns only
    _to = "'" + _text.replace("\\n", "' || chr(10) || '") + "'"
    MARKUP_SQL = f"(SELECT page_id, regexp_replace(html, '{_pattern}', {_to}, 'g') AS html FROM {MARKUP_SQL})"


@query("page_text_b17", f"SELECT page_id, md5(html) AS body, CAST(length(html) AS BIGINT) AS n FROM {MARKUP_SQL}")
def page_text_b17(t):
    """Pages between an image in front and an annotation and a Markdown image behind, warning icons among them."""
    label = F.get(F.array(*map(F.lit, PICTURES)), (F.col("page_id") % 5).cast("int"))
    html = F.concat(
        F.lit('<td>k</td><IMG src="a.png" alt="'), label, F.lit('"/>'), "html", F.lit("\n**[그림] "), label, F.lit("** note\n  - more\nrest !["), label, F.lit("](x.png) end"))
    body = parse.page_text(html)
    return t.pages.select("page_id", F.md5(body).alias("body"), F.length(body).cast("bigint").alias("n"))


@query(
    "table_cells_b18",
    r"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, '<table><tr><th colspan="2">Line ' || l_linenumber || '</th></tr><tr><td>' || l_returnflag
          || '</td><td rowspan="2"><b>' || l_linestatus || '</b></td></tr></table>' AS html FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, 0 AS grid_row, c AS grid_col, 'Line ' || l_linenumber AS text FROM r, (VALUES (0), (1)) v(c)
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, 0, regexp_extract(html, '<td>([A-Z])</td>', 1) FROM r
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, g, 1, regexp_extract(html, '<b>([A-Z])</b>', 1) FROM r, (VALUES (1), (2)) v(g)""",
)
def table_cells_b18(t):
    rows = t.lineitem.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"),
        F.expr(
            """'<table><tr><th colspan="2">Line ' || l_linenumber || '</th></tr><tr><td>' || l_returnflag
               || '</td><td rowspan="2"><b>' || l_linestatus || '</b></td></tr></table>'"""
        ).alias("html"),
    )
    cells = parse.table_cells(rows, "k", "html").withColumnRenamed("cell_no", "col_no")
    return parse.spread_cells(cells, ["k"]).select("k.*", "grid_row", "grid_col", "text")


@query(
    "coordinate_cells_b18b",
    """SELECT p_partkey, 0 AS row_no, 1 AS col_no, p_name AS text FROM part WHERE p_size % 7 <> 0
       UNION ALL SELECT p_partkey, 0, 3, p_brand FROM part WHERE p_size % 7 <> 0
       UNION ALL SELECT p_partkey, 1, 2, p_type FROM part WHERE p_size % 7 <> 0""",
)
def coordinate_cells_b18b(t):
    good = F.expr("'R1 | C1: ' || p_name || ' | C3: ' || p_brand || '\\nR2 | C2: ' || p_type")
    text = F.when(F.col("p_size") % 7 == 0, F.concat(good, F.lit("\nplain line"))).otherwise(good)
    return parse.coordinate_cells(t.part.select("p_partkey", text.alias("body")), "p_partkey", "body")


@query(
    "flatten_meta_b19",
    """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events)
       SELECT event_id, unnest(['meta__type', 'meta__k', 'meta__tags__type', 'meta__tags__length', 'meta__tags__000', 'meta__tags__001__is_null']) AS path,
              unnest(['dict', k, 'list', '2', event_type, 'true']) AS value FROM e""",
)
def flatten_meta_b19(t):
    doc = F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "tags": ["'), F.col("event_type"), F.lit('", null]}')
    )
    return parse.flatten_meta(t.events.select("event_id", doc.alias("doc")), "event_id", "doc", "meta")


RAW_SQL = """CASE p_partkey % 3 WHEN 0 THEN '[["' || p_name || '","is a","' || p_type || '"],["' || p_name || '","is a","' || p_type || '"]]'
  WHEN 1 THEN 'Triples: [ ["' || p_brand || '", "makes", " ' || p_name || ' "], ["x", "y"], ["", "b", "c"] ] end' ELSE 'no triples here' END"""


@query(
    "parse_triples_b33",
    """SELECT p_partkey, p_name AS s, 'is a' AS p, p_type AS o FROM part WHERE p_partkey % 3 = 0
       UNION ALL SELECT p_partkey, p_brand, 'makes', p_name FROM part WHERE p_partkey % 3 = 1""",
)
def parse_triples_b33(t):
    raw = t.part.select("p_partkey", parse.parse_triples(F.expr(RAW_SQL)).alias("x"))
    return raw.select("p_partkey", F.explode("x").alias("r")).select(
        "p_partkey", F.col("r")[0].alias("s"), F.col("r")[1].alias("p"), F.col("r")[2].alias("o")
    )


@query(
    "paren_triples_b33b",
    """SELECT p_partkey, p_name AS s, 'has size' AS p, CAST(p_size AS VARCHAR) AS o FROM part
       UNION ALL SELECT p_partkey, p_brand, 'makes', p_name || ', ' || p_type FROM part""",
)
def paren_triples_b33b(t):
    raw = F.expr("""'(' || p_name || ', has size, \"' || p_size || '\"); (' || p_brand || ' , makes , ' || p_name || ', ' || p_type || ')'""")
    x = t.part.select("p_partkey", F.explode(parse.parse_paren_triples(raw)).alias("r"))
    return x.select("p_partkey", F.col("r")[0].alias("s"), F.col("r")[1].alias("p"), F.col("r")[2].alias("o"))


CITED_SQL = "text || ' [chunk:' || (turn + 2) || '] ok [3, 1] [chunk:' || (turn + 1) || '] [chunk:3]'"


@query(
    "citation_labels_b34",
    r"""WITH n AS (SELECT conv_id, turn, unnest([turn + 2, 3, 1, turn + 1, 3]) AS chunk_index, unnest([1, 2, 3, 4, 5]) AS p FROM conversations),
          f AS (SELECT conv_id, turn, chunk_index, min(p) AS p FROM n GROUP BY ALL)
        SELECT conv_id, turn, chunk_index, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) AS INT) AS label FROM f""",
)
def citation_labels_b34(t):
    answers = t.conversations.select("conv_id", "turn", F.expr(CITED_SQL).alias("answer"))
    return parse.citation_labels(answers, ["conv_id", "turn"], "answer")


@query(
    "claim_lines_b34b",
    r"""SELECT conv_id, turn, 'Claim ' || role || ' done' AS claim FROM conversations""",
)
def claim_lines_b34b(t):
    answer = F.expr(r"'> **Claim ' || role || '** done [chunk:2]\nother [chunk:1]\n검토한 도면 페이지: 1 [chunk:2]'")
    return t.conversations.select("conv_id", "turn", parse.claim_lines(answer, 2).alias("claim"))


@query("split_recursive_c1")
def split_recursive_c1(t):
    return chunking.split_recursive(t.documents, ["doc_id"], "text")


@query(
    "split_windows_c2",
    r"""WITH RECURSIVE w AS (
          SELECT doc_id, text, 0 AS s, 0 AS e, 0 AS step FROM documents
          UNION ALL
          SELECT doc_id, text, s2, CASE WHEN s2 + 1600 < length(text) AND nl > s2 + 200 THEN nl + 1 ELSE least(s2 + 1600, length(text)) END, step + 1
          FROM (SELECT doc_id, text, step, s2, CASE WHEN position(chr(10) IN reverse(substr(text, s2 + 801, 800))) = 0 THEN -1
                    ELSE s2 + 800 + 800 - position(chr(10) IN reverse(substr(text, s2 + 801, 800))) END AS nl
                FROM (SELECT *, CASE WHEN step = 0 THEN 0 ELSE e - 200 END AS s2 FROM w WHERE (step = 0 AND length(text) > 0) OR (step > 0 AND e < length(text)))))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INT) AS part, md5(body) AS chunk
        FROM (SELECT doc_id, step, regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS body FROM w WHERE step > 0) WHERE body <> ''""".replace(
        "SELECT doc_id, text, s2, CASE", "SELECT doc_id, text, s2 AS s, CASE"
    ),
)
def split_windows_c2(t):
    return chunking.split_windows(t.documents, ["doc_id"], "text").withColumn("chunk", F.md5("chunk"))


@query("refine_c3")
def refine_c3(t):
    d = F.col("doc_id")
    blocks = t.documents.select(
        F.concat(F.lit("b"), d.cast("string")).alias("chunk_id"),
        F.when(d % 11 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.when(d % 5 == 0, "tables").otherwise("texts").alias("container_type"),
        F.when(d % 22 == 0, F.concat(F.lit("img/"), d.cast("string"))).alias("asset_path"),
        F.col("source").alias("source_doc_name"),
    )
    return chunking.refine(blocks)


LABELS = "['text', 'number', 'table', 'header', 'paragraph_title', 'footer', 'aside_text']"


@query(
    "searchable_c4",
    f"""SELECT doc_id, label FROM (SELECT doc_id, list_extract({LABELS}, CAST(doc_id % 7 + 1 AS INT)) AS label FROM documents)
        WHERE label NOT IN ('number', 'header', 'footer', 'header_image', 'footer_image', 'footnote', 'aside_text')""",
)
def searchable_c4(t):
    label = F.expr(f"element_at(array{LABELS.replace('[', '(').replace(']', ')')}, cast(doc_id % 7 + 1 as int))")
    return chunking.searchable(t.documents.select("doc_id", label.alias("label")), "label")


WINDOWS_SQL = """SELECT {k}, CASE WHEN n <= 18 THEN [plain] ELSE list_distinct(list_transform(list_concat(range(0, n - 17, 9), [n - 18]),
       lambda s: array_to_string(w[s + 1:s + 18], ' '))) END AS windows
  FROM (SELECT {k}, plain, string_split(plain, ' ') AS w, len(string_split(plain, ' ')) AS n FROM (
    SELECT {k}, trim(regexp_replace(lower({text}), '[^0-9a-z가-힣]+', ' ', 'g')) AS plain FROM {table})) WHERE plain <> ''"""


@query(
    "word_windows_c5",
    "SELECT item_id, unnest(windows) AS w FROM (" + WINDOWS_SQL.format(k="item_id", text="text", table="benchmark") + ")",
)
def word_windows_c5(t):
    return t.benchmark.select("item_id", F.explode(chunking.word_windows(F.col("text"))).alias("w"))


@query(
    "char_shingles_c6",
    r"""SELECT doc_id, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(list_sort(g), '|')) AS shingles FROM (
          SELECT doc_id, list_distinct(list_transform(range(1, CAST(length(c) AS BIGINT) - 6), lambda i: substr(c, i, 8))) AS g FROM (
            SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS c FROM documents))""",
)
def char_shingles_c6(t):
    counted = lambda g: F.struct(F.size(g).cast("bigint").alias("n"), F.md5(F.array_join(F.sort_array(g), "|")).alias("shingles"))
    return t.documents.select("doc_id", let(chunking.char_shingles(F.col("text")), counted).alias("g")).select("doc_id", "g.*")


@query(
    "parse_items_b33c",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE json_extract_string(props, '$.k') || ':' || event_type || ',a:b' END AS items FROM events""",
)
def parse_items_b33c(t):
    """Replies as a fenced list of objects with incomplete and foreign items; a reply for an error is cut short."""
    item = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "kind": " '), "event_type", F.lit('"}'))
    reply = F.concat(F.lit("```json\n["), item, F.lit(', {"k": "", "kind": "x"}, 3, {"kind": "y"}, {"k": " a ", "kind": "b"}]\n```'))
    text = F.when(F.col("event_type") == "error", F.substring(reply, 1, 20)).otherwise(reply)
    items = F.transform(parse.parse_items(text, ["k", "kind"]), lambda x: F.concat_ws(":", x["k"], x["kind"]))
    return t.events.select("event_id", F.array_join(items, ",").alias("items"))
