"""Bindings of the listing operators. The listing lines are derived from lineitem: one block per order."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import ladder
from ..operators.ordered import topk
from .registry import query
from .bindings import top_sql

BASE_SQL = "(SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber)"
OP = "CASE n WHEN 1 THEN 'RD' WHEN 2 THEN 'AND' WHEN 3 THEN 'OR.NOT' WHEN 4 THEN 'RD.STK' WHEN 5 THEN 'AND.STK' WHEN 6 THEN 'WRT' ELSE 'SUB' END"
ADDR = "CASE n WHEN 1 THEN 'X' WHEN 6 THEN 'Y' ELSE 'R' END || (p % 100) || '.' || (p % 8)"
STEP_SQL = f"""(SELECT o, n, p, s, 'F' || (o % 10) AS file, 'N' || o AS block, o * 100 + n * 10 AS line_no, {OP} AS op,
    CASE n WHEN 1 THEN 'read' WHEN 2 THEN 'condition_and' WHEN 3 THEN 'condition_or_not' WHEN 4 THEN 'stack_read' WHEN 5 THEN 'stack_and' WHEN 6 THEN 'write' ELSE 'sub_instruction' END AS role,
    CASE n WHEN 4 THEN 'start_stack_group' WHEN 5 THEN 'merge_stack_group_with_and' END AS stack_op,
    CASE WHEN n NOT IN (5, 7) THEN {ADDR} END AS address,
    CASE WHEN n NOT IN (5, 7) THEN CASE n WHEN 1 THEN 'X' WHEN 6 THEN 'Y' ELSE 'R' END || lpad(CAST(p % 100 AS VARCHAR), 3, '0') || (p % 8) END AS drawing_code,
    CASE WHEN n NOT IN (5, 7) THEN CASE n WHEN 1 THEN 'input' WHEN 6 THEN 'output' ELSE 'internal_relay' END END AS signal_type,
    CASE WHEN n NOT IN (5, 7) THEN 'SYM' || p END AS symbol,
    CASE WHEN n IN (5, 7) THEN NULL WHEN p % 2 = 0 THEN 'desc ' || p WHEN p % 5 = 0 THEN 'inl ' || p END AS description,
    CASE WHEN n = 7 THEN CAST(p % 90 AS INT) END AS sub_code, CASE WHEN n = 7 THEN 'FN' || s END AS sub_name FROM {BASE_SQL})"""


def listing(t):
    """Lines of ten listings: labels, steps, descriptions, function lines with arguments."""
    rows = t.lineitem.filter("l_orderkey is not null").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey")
    base = rows.repartition("o").groupBy("o", "n").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))  # rows move once, by order
    base = base.withColumn("n0", F.min("n").over(Window.partitionBy("o")))
    head = "CASE WHEN n = n0 THEN 'N' || o || ': ' ELSE '' END"
    inline = "CASE WHEN p % 2 = 1 AND p % 5 = 0 THEN ' \"inl ' || p || '\"' ELSE '' END"
    main = f"""{head} || CASE n WHEN 5 THEN 'AND.STK' WHEN 7 THEN 'SUB ' || (p % 90) || ' ; FN' || s
               ELSE ({OP}) || ' ' || ({ADDR}) || ' ;(SYM' || p || ')' || {inline} END"""
    note = "CASE WHEN n NOT IN (5, 7) AND p % 2 = 0 THEN '  ;[desc ' || p || ']' END"
    arg = lambda text: f"CASE WHEN n = 7 THEN {text} END"
    rows = [main, note, arg("'R' || p || ' ;(ARG' || s || ')'"), arg("';[about ' || p || ']'"), arg("''"), arg("'' || s")]
    lines = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(x).alias("line")) for k, x in enumerate(rows)])
    return base.select("o", "n", F.explode(lines).alias("l")).filter("l.line is not null").select(
        F.concat(F.lit("F"), (F.col("o") % 10).cast("string")).alias("file"),
        (F.col("o") * 100 + F.col("n") * 10 + F.col("l.k")).alias("line_no"), "l.line",
    )


STEP_COLS = "file, block, line_no, op, role, stack_op, address, drawing_code, signal_type, symbol, description, coalesce(sub_code, -1) AS sub_code, sub_name"


@query("steps_l1", f"SELECT {STEP_COLS} FROM {STEP_SQL}")
def steps_l1(t):
    return ladder.steps(listing(t)).withColumn("sub_code", F.coalesce("sub_code", F.lit(-1)))


@query(
    "function_args_l2",
    f"""SELECT file, block, line_no AS sub_line, line_no + 2 AS line_no, 'R' || p AS value, 'ARG' || s AS symbol, 'about ' || p AS description FROM {STEP_SQL} WHERE n = 7
        UNION ALL SELECT file, block, line_no, line_no + 5, CAST(s AS VARCHAR), NULL, NULL FROM {STEP_SQL} WHERE n = 7""",
)
def function_args_l2(t):
    return ladder.function_args(listing(t)).select("file", "block", "sub_line", "line_no", "value", "symbol", "description")


def dictionary_lines(t):
    """Symbol and alarm sections of one listing per brand, derived from part."""
    entry = "substr('XYRA', CAST(p_partkey % 4 + 1 AS INT), 1) || p_partkey || '.' || (p_partkey % 8)"
    rows = [
        f"{entry} || ' ' || replace(p_name, ' ', '_')",
        "CASE WHEN p_size % 2 = 0 THEN '$1 ''' || p_name || '''' END",
        "CASE WHEN p_size % 3 = 0 THEN '$1 ''' || p_type || '''' END",
        "'A' || p_size || '.1 ' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '' END",
    ]
    lines = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(x).alias("line")) for k, x in enumerate(rows)])
    return t.part.select(F.col("p_brand").alias("file"), "p_partkey", F.explode(lines).alias("l")).filter("l.line is not null").select(
        "file", (F.col("p_partkey") * 10 + F.col("l.k")).alias("line_no"), "l.line", F.col("l.k").alias("k")
    )


@query(
    "symbols_l3",
    """SELECT p_brand AS file, substr('XYRA', CAST(p_partkey % 4 + 1 AS INT), 1) || p_partkey || '.' || (p_partkey % 8) AS address, replace(p_name, ' ', '_') AS symbol,
         CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 2 = 0 THEN p_name END AS description FROM part""",
)
def symbols_l3(t):
    return ladder.symbols(dictionary_lines(t).filter("k < 3").drop("k"))


@query(
    "alarms_l3b",
    """SELECT p_brand AS file, 'A' || p_size || '.1' AS address, 'AL' || p_partkey AS alarm_code, CASE WHEN p_size % 2 = 0 THEN p_name END AS message FROM part""",
)
def alarms_l3b(t):
    return ladder.alarms(dictionary_lines(t).filter("k = 3").drop("k"))


@query(
    "search_text_l4",
    f"""SELECT file, block, md5(block || ' ' || string_agg(concat_ws(' ', role, address, drawing_code, signal_type, symbol, description), ' | ' ORDER BY n)) AS search_text
        FROM {STEP_SQL} GROUP BY file, block""",
)
def search_text_l4(t):
    return ladder.search_text(ladder.steps(listing(t))).withColumn("search_text", F.md5("search_text"))


def logic_sql() -> str:
    """Steps come in the fixed order RD, AND, OR.NOT, RD.STK, AND.STK, WRT, SUB; any of them may be missing."""
    lab = lambda n: f"max(CASE WHEN n = {n} THEN address || '(' || symbol || ')' END)"
    return f"""WITH b AS (SELECT file, block, {lab(1)} AS rd, {lab(2)} AS an, {lab(3)} AS orn, {lab(4)} AS rs, bool_or(n = 5) AS st, {lab(6)} AS wr,
        max(CASE WHEN n = 7 THEN 'SUB ' || sub_code || ' (' || sub_name || ')' END) AS fn, count(stack_op) AS n_stack FROM {STEP_SQL} GROUP BY ALL),
      c AS (SELECT *, CASE WHEN rd IS NOT NULL AND an IS NOT NULL THEN '(' || rd || ' AND ' || an || ')' ELSE coalesce(rd, an) END AS e1,
        (rd IS NOT NULL AND an IS NOT NULL) AS e1and FROM b),
      d AS (SELECT *, CASE WHEN e1 IS NOT NULL AND orn IS NOT NULL THEN '(' || e1 || ' OR NOT ' || orn || ')' WHEN orn IS NOT NULL THEN 'NOT ' || orn ELSE e1 END AS e2,
        (orn IS NULL AND e1and) AS e2and FROM c),
      f AS (SELECT *, CASE WHEN rs IS NOT NULL THEN rs ELSE e2 END AS cur, CASE WHEN rs IS NOT NULL THEN e2 END AS stk FROM d),
      g AS (SELECT *, st AND (cur IS NULL OR stk IS NULL) AS broken,
        CASE WHEN st AND stk IS NOT NULL THEN CASE WHEN e2and THEN substr(stk, 1, length(stk) - 1) || ' AND ' || cur || ')' ELSE '(' || stk || ' AND ' || cur || ')' END ELSE cur END AS e3,
        CASE WHEN st THEN NULL ELSE stk END AS left_over FROM f),
      h AS (SELECT *, CASE WHEN fn IS NOT NULL AND left_over IS NOT NULL THEN fn || ' [stack: ' || left_over || ']' ELSE fn END AS called FROM g)
      SELECT file, block, CASE WHEN broken OR (left_over IS NOT NULL AND fn IS NULL) OR (fn IS NULL AND wr IS NULL) THEN NULL ELSE concat_ws(' -> ', e3, called, wr) END AS logic,
        CASE WHEN n_stack > 0 THEN 'pattern_based' ELSE 'simple' END AS confidence FROM h"""


@query("logic_expr_l5", logic_sql())
def logic_expr_l5(t):
    return ladder.logic_expr(ladder.steps(listing(t)))


@query(
    "nets_l7",
    f"""SELECT file, block, line_no, CAST(sum(CASE WHEN op = 'RD' AND pe THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS net FROM (
          SELECT *, coalesce(lag(op) OVER (PARTITION BY file ORDER BY line_no) IN ('WRT', 'SUB'), false) AS pe FROM (SELECT *, 'all' AS whole FROM {STEP_SQL}))""",
)
def nets_l7(t):
    """The whole listing as one run of steps, so nets continue across labels."""
    s = ladder.steps(listing(t))
    out = ladder.nets(s.withColumn("label", F.col("block")).withColumn("block", F.lit("all")))
    return out.select("file", F.col("label").alias("block"), "line_no", "net")


@query(
    "decode_cells_l8",
    f"""SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY n) - 1 AS BIGINT) AS idx,
          CASE n WHEN 7 THEN 'param' WHEN 5 THEN 'func' ELSE 'basic' END AS kind,
          CASE n WHEN 1 THEN 'RD' WHEN 2 THEN 'RD.NOT' WHEN 3 THEN 'AND' WHEN 4 THEN 'AND.NOT' WHEN 5 THEN 'SUB' WHEN 6 THEN 'OR.NOT' END AS op,
          CASE WHEN n NOT IN (5, 7) THEN 'R' || (p % 65536) || '.' || (p % 8) END AS address, CASE WHEN n = 7 THEN p ELSE -1 END AS constant FROM {STEP_SQL}""",
)
def decode_cells_l8(t):
    """Cells packed from lineitem, then decoded."""
    base = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    byte = lambda e: f"lpad(hex({e}), 2, '0')"
    cell = f"""CASE n WHEN 5 THEN '8003' || '00000000' WHEN 7 THEN '8101' || {byte('p % 256')} || {byte('floor(p / 256) % 256')} || {byte('floor(p / 65536) % 256')} || '00'
               ELSE '00' || {byte('n')} || '85' || {byte('p % 256')} || {byte('floor(p / 256) % 256')} || {byte('p % 8')} END"""
    packed = base.withColumn("c", F.expr(cell)).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("x"))
    count = F.lpad(F.hex(F.size("x")), 2, "0")
    data = F.unhex(F.concat(count, F.lit("000000"), F.array_join(F.transform("x", lambda e: e.c), "")))
    rows = packed.select(F.concat(F.lit("N"), "o").alias("block"), data.alias("data"))
    return ladder.decode_cells(rows, "block", "data").select("block", "idx", "kind", "op", "address", F.coalesce("constant", F.lit(-1)).alias("constant"))


USES = f"(SELECT DISTINCT file, block, address, CASE WHEN role = 'write' THEN 'write' ELSE 'read' END AS use FROM {STEP_SQL} WHERE address IS NOT NULL)"
# the same address space for reads and writes, so that blocks really feed each other
SHARED = f"(SELECT DISTINCT file, block, 'R' || (p % 400) AS address, CASE WHEN n % 2 = 0 THEN 'write' ELSE 'read' END AS use FROM {STEP_SQL})"


def shared_steps(t):
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return base.select(
        F.concat(F.lit("F"), (F.col("l_orderkey") % 10).cast("string")).alias("file"), F.concat(F.lit("N"), "l_orderkey").alias("block"),
        F.concat(F.lit("R"), (F.col("p") % 400).cast("string")).alias("address"), F.when(F.col("l_linenumber") % 2 == 0, "write").otherwise("read").alias("role"),
    )


@query(
    "block_summary_e11",
    f"""SELECT file, block, coalesce(array_to_string(list_sort(list(DISTINCT address) FILTER (WHERE role <> 'write')), ','), '') AS reads,
          coalesce(array_to_string(list_sort(list(DISTINCT drawing_code) FILTER (WHERE signal_type = 'internal_relay')), ','), '') AS internals FROM {STEP_SQL} WHERE address IS NOT NULL GROUP BY ALL""",
)
def block_summary_e11(t):
    out = ladder.block_summary(ladder.steps(listing(t)))
    return out.select("file", "block", F.array_join("reads", ",").alias("reads"), F.array_join("internals", ",").alias("internals"))


@query(
    "xref_l9",
    f"""SELECT file, block, address, use, n_writers, n_readers FROM {SHARED} JOIN (SELECT file, address, count(*) FILTER (WHERE use = 'write') AS n_writers,
          count(*) FILTER (WHERE use = 'read') AS n_readers FROM {SHARED} GROUP BY ALL) USING (file, address)""",
)
def xref_l9(t):
    return ladder.xref(shared_steps(t))


@query(
    "related_counts_d14",
    f"""WITH u AS {SHARED}, k AS (SELECT DISTINCT file, block, address FROM u)
       SELECT k.file, k.block, k.address,
         coalesce(CASE WHEN EXISTS (SELECT 1 FROM u x WHERE x.file = k.file AND x.address = k.address AND x.block = k.block AND x.use = 'write')
              THEN (SELECT count(*) FROM u x WHERE x.file = k.file AND x.address = k.address AND x.use = 'read' AND x.block <> k.block) END, 0) AS other_readers,
         coalesce(CASE WHEN EXISTS (SELECT 1 FROM u x WHERE x.file = k.file AND x.address = k.address AND x.block = k.block AND x.use = 'read')
              THEN (SELECT count(*) FROM u x WHERE x.file = k.file AND x.address = k.address AND x.use = 'write' AND x.block <> k.block) END, 0) AS other_writers FROM k""",
)
def related_counts_d14(t):
    return ladder.related_counts(ladder.xref(shared_steps(t)))


ROOTS_SQL = f"(SELECT file, min(block) AS block FROM {SHARED} GROUP BY file)"


def trace_sql(near: str, far: str) -> str:
    hop = lambda f: f"""SELECT DISTINCT f.file, f.root, m.address, x.block FROM {f} f JOIN u m ON m.file = f.file AND m.block = f.block AND m.use = '{near}'
        JOIN u x ON x.file = m.file AND x.address = m.address AND x.use = '{far}' AND x.block <> m.block"""  # noqa: E731
    return f"""WITH u AS MATERIALIZED (SELECT * FROM {SHARED}), f0 AS (SELECT file, block AS root, block FROM {ROOTS_SQL}), e1 AS ({hop('f0')}),
      f1 AS (SELECT DISTINCT file, root, block FROM e1 ANTI JOIN f0 USING (file, root, block)), e2 AS ({hop('f1')})
      SELECT file, root, 1 AS level, address, block FROM e1 UNION ALL SELECT file, root, 2, address, block FROM e2 ANTI JOIN e1 USING (file, root, address, block)"""


def trace_roots(t):
    return shared_steps(t).groupBy("file").agg(F.min("block").alias("block"))


@query("trace_up_l10", trace_sql("read", "write"))
def trace_up_l10(t):
    return ladder.trace(ladder.xref(shared_steps(t)), trace_roots(t), True)


@query("trace_down_l10b", trace_sql("write", "read"))
def trace_down_l10b(t):
    return ladder.trace(ladder.xref(shared_steps(t)), trace_roots(t), False)


@query("trace_lines_l10c")
def trace_lines_l10c(t):
    return ladder.trace_lines(ladder.xref(shared_steps(t)), trace_roots(t), True)


@query(
    "rerank_l11",
    f"""WITH s AS (SELECT file, block, list(DISTINCT address) AS addresses FROM {SHARED} GROUP BY ALL),
      lk AS (SELECT 'F' || s_nationkey % 10 AS qid, list(DISTINCT 'R' || (s_suppkey * 4)) AS linked FROM supplier GROUP BY 1),
      h AS (SELECT 'F' || (o % 10) AS qid, 'F' || (o % 10) AS file, 'N' || o AS block, o AS rank, o % 997 = 0 AS seed FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem)),
      m AS (SELECT h.qid, h.file, h.block, seed, rank, coalesce(len(list_intersect(addresses, linked)), 0) AS matches FROM h LEFT JOIN s USING (file, block) LEFT JOIN lk ON lk.qid = h.qid)
      SELECT qid, block, seed, CAST(matches AS INT) AS matches, row_number() OVER (PARTITION BY qid ORDER BY seed DESC, matches > 0 DESC, matches DESC, rank) AS new_rank FROM m""",
)
def rerank_l11(t):
    steps = shared_steps(t)
    summary = steps.select("file", "block", "address").distinct().groupBy("file", "block").agg(F.collect_set("address").alias("addresses"))
    linked = t.supplier.groupBy(F.concat(F.lit("F"), (F.col("s_nationkey") % 10).cast("string")).alias("qid")).agg(
        F.collect_set(F.concat(F.lit("R"), (F.col("s_suppkey") * 4).cast("string"))).alias("addresses")
    )
    orders = t.lineitem.select(F.col("l_orderkey").alias("o")).distinct()
    file = F.concat(F.lit("F"), (F.col("o") % 10).cast("string"))
    hits = orders.select(file.alias("qid"), file.alias("file"), F.concat(F.lit("N"), "o").alias("block"), F.col("o").alias("rank"))
    seeds = orders.filter("o % 997 = 0").select(file.alias("qid"), F.concat(F.lit("N"), "o").alias("block"))
    return ladder.rerank(hits, summary, linked, seeds).select("qid", "block", "seed", "matches", "new_rank")


@query(
    "with_values_l12",
    f"""SELECT file, block, line_no, s.address, CAST(coalesce((v >> CAST(split_part(s.address, '.', 2) AS INT)) & 1, -1) AS INT) AS value FROM {STEP_SQL} s
        LEFT JOIN (SELECT substr('XYR', CAST(s_suppkey % 3 + 1 AS INT), 1) AS area, s_suppkey AS b, s_nationkey * 7 % 256 AS v FROM supplier)
          ON s.address LIKE area || b || '.%' WHERE s.address IS NOT NULL""",
)
def with_values_l12(t):
    bytes_ = t.supplier.select(
        F.expr("substr('XYR', CAST(s_suppkey % 3 + 1 AS INT), 1)").alias("area"), F.col("s_suppkey").alias("b"), (F.col("s_nationkey") * 7 % 256).cast("int").alias("v")
    )
    bits = bytes_.select("area", "b", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).select(
        F.concat(F.col("area"), F.col("b").cast("string"), F.lit("."), F.col("bit").cast("string")).alias("address"),
        F.expr("shiftright(v, bit)").bitwiseAND(1).alias("value"),
    )
    out = ladder.with_values(ladder.steps(listing(t)).filter("address is not null"), bits)
    return out.select("file", "block", "line_no", "address", F.coalesce("value", F.lit(-1)).alias("value"))


@query(
    "address_ranges_f6",
    """WITH a AS (SELECT DISTINCT l_linenumber AS area, l_partkey * 2 - l_partkey // 3 AS number FROM lineitem),
      i AS (SELECT area, number, number - row_number() OVER (PARTITION BY area ORDER BY number) AS isl FROM a),
      k AS (SELECT area, number, isl, (number - min(number) OVER (PARTITION BY area, isl)) // 200 AS k FROM i)
      SELECT area, min(number) AS "start", max(number) AS "end" FROM k GROUP BY area, isl, k""",
)
def address_ranges_f6(t):
    a = t.lineitem.select(F.col("l_linenumber").alias("area"), (F.col("l_partkey") * 2 - F.floor(F.col("l_partkey") / 3)).alias("number"))
    return ladder.address_ranges(a)


@query(
    "dense_ranges_f6b",
    """WITH a AS (SELECT DISTINCT l_linenumber AS area, l_partkey AS number FROM lineitem), i AS (SELECT area, number, number - row_number() OVER (PARTITION BY area ORDER BY number) AS isl FROM a),
      k AS (SELECT area, number, isl, (number - min(number) OVER (PARTITION BY area, isl)) // 200 AS k FROM i) SELECT area, min(number) AS "start", max(number) AS "end" FROM k GROUP BY area, isl, k""",
)
def dense_ranges_f6b(t):
    return ladder.address_ranges(t.lineitem.select(F.col("l_linenumber").alias("area"), F.col("l_partkey").alias("number")))


@query(
    "multi_key_rerank_g6",
    f"SELECT l_returnflag AS qid, block, n, rank FROM {top_sql('(SELECT l_returnflag, ' + chr(39) + 'N' + chr(39) + ' || l_orderkey AS block, count(*) AS n, min(l_linenumber) = 1 AS seed FROM lineitem GROUP BY ALL)', 20, 'l_returnflag', 'seed DESC, n DESC, block')}",
)
def multi_key_rerank_g6(t):
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("qid"), F.concat(F.lit("N"), "l_orderkey").alias("block")).agg(
        F.count("*").alias("n"), (F.min("l_linenumber") == 1).alias("seed")
    )
    return topk(g, ["qid"], [F.col("seed").desc(), F.col("n").desc(), F.col("block")], 20).select("qid", "block", "n", "rank")


@query(
    "natural_lookup_g7",
    """SELECT p_brand, address, rank FROM (SELECT p_brand, address, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY substr(address, 1, 1), CAST(regexp_extract(address, '([0-9]+)', 1) AS INT),
          CAST(regexp_extract(address, '\\.([0-9]+)', 1) AS INT)) AS INT) AS rank FROM (SELECT DISTINCT p_brand, 'X' || (p_partkey % 150) || '.' || (p_partkey % 8) AS address FROM part WHERE contains(upper(p_name), 'RING'))
          WHERE starts_with(address, 'X1')) WHERE rank <= 10""",
)
def natural_lookup_g7(t):
    a = t.part.filter(F.upper("p_name").contains("RING")).select(
        "p_brand", F.concat(F.lit("X"), (F.col("p_partkey") % 150).cast("string"), F.lit("."), (F.col("p_partkey") % 8).cast("string")).alias("address")
    ).distinct()
    return topk(a.filter(F.col("address").startswith("X1")), ["p_brand"], ladder.natural_order(F.col("address")), 10).select("p_brand", "address", "rank")


@query(
    "shared_addresses_h3",
    f"""SELECT file, block, len(list_intersect(a, ['R4', 'R8', 'R12', 'R16', 'R100', 'R200', 'R300'])) AS n FROM (SELECT file, block, list(DISTINCT address) AS a FROM {SHARED} GROUP BY ALL)""",
)
def shared_addresses_h3(t):
    s = shared_steps(t).select("file", "block", "address", "role").distinct().groupBy("file", "block").agg(
        F.collect_set(F.when(F.col("role") == "read", F.col("address"))).alias("r"), F.collect_set(F.when(F.col("role") == "write", F.col("address"))).alias("w")
    )
    wanted = F.array(*[F.lit(x) for x in ("R4", "R8", "R12", "R16", "R100", "R200", "R300")])
    return s.select("file", "block", F.size(F.array_intersect(F.array_union("r", "w"), wanted)).cast("bigint").alias("n"))


@query(
    "listing_sections_a8",
    """SELECT p_brand AS file, p_partkey * 10 + k AS line_no, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '%@' || (1 + p_partkey % 3) END AS section FROM part, (VALUES (1), (2)) v(k) WHERE p_partkey % 3 <> 0""",
)
def listing_sections_a8(t):
    mark = F.when(F.col("p_partkey") % 3 == 0, "%").otherwise(F.concat(F.lit("%@"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-C")))
    lines = F.array(F.struct(F.lit(0).alias("k"), mark.alias("line")), F.struct(F.lit(1).alias("k"), F.col("p_name").alias("line")), F.struct(F.lit(2).alias("k"), F.col("p_type").alias("line")))
    d = t.part.select(F.col("p_brand").alias("file"), "p_partkey", F.explode(lines).alias("l")).select(
        "file", (F.col("p_partkey") * 10 + F.col("l.k")).alias("line_no"), "l.line"
    )
    return ladder.listing_sections(d).select("file", "line_no", "section")
