"""Hand-made cases and brute-force checks for operators without an SQL twin, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.functions import bands, parse, rules, tables
from plantlens.operators import audit, chat, chunking, fusion, graph, intervals, ladder, lexical, pages, reports, sync, vectors


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_split_recursive_keeps_the_overlap(spark):
    assert chunking.cut_text("ab cd ef", 5, 2) == ["ab cd", "cd ef"]
    df = spark.createDataFrame([(1, "ab cd ef"), (2, "x")], "id int, t string")
    assert values(chunking.split_recursive(df, ["id"], "t", 5, 2)) == [(1, 1, 2, "ab cd"), (1, 2, 2, "cd ef"), (2, 1, 1, "x")]


def test_split_recursive_loses_no_word(spark):
    text = "\n\n".join(". ".join(f"word{i}x{j}" for j in range(30)) for i in range(9))
    chunks = chunking.cut_text(text, 200, 40)
    assert set(f"word{i}x{j}" for i in range(9) for j in range(30)) <= set(" ".join(chunks).replace(".", " ").split())
    assert max(map(len, chunks)) <= 200 + 40


def test_windows_at_line_ends():
    assert chunking.cut_windows("0123456789", 6, 2) == ["012345", "456789"]
    assert chunking.cut_windows("abcd\nefgh", 6, 1) == ["abcd", "efgh"]
    with pytest.raises(ValueError):
        chunking._splitter(chunking.cut_windows, 5, 5)


def test_split_windows_table_function(spark):
    tables.register_table_functions(spark)
    spark.createDataFrame([(1, "0123456789")], "id int, t string").createOrReplaceTempView("texts")
    assert values(spark.sql("SELECT id, w.part, w.chunk FROM texts, LATERAL split_windows(t, 6, 2) w")) == [(1, 0, "012345"), (1, 1, "456789")]


def test_refine_ids_and_assets(spark):
    blocks = spark.createDataFrame(
        [("a", "one two three", "texts", ""), ("b", " ", "texts", "img"), ("c", "", "texts", None), ("d", "long table text", "tables", None)],
        "chunk_id string, text string, container_type string, asset_path string",
    )
    out = values(chunking.refine(blocks, 7, 0).select("id", "page_content", "chunk_part"))
    assert out == [("a_p1", "one two", "1/2"), ("a_p2", "three", "2/2"), ("b", "", "1/1"), ("d", "long table text", "1/1")]


def test_bounded_topk_tie(spark):
    v = spark.createDataFrame([("a", [0.9]), ("b", [0.9]), ("c", [0.9])], "id string, v array<double>")
    q = spark.createDataFrame([(1, [1.0])], "q int, v array<double>")
    assert [r["id"] for r in vectors.vector_topk(q, "q", "v", v, "id", "v", 2).orderBy("rank").collect()] == ["b", "c"]


def test_vector_topk_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(data)], "id int, v array<double>, part int").repartition(5)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 70)
    got = {(r["qid"], r["rank"]): r["id"] for r in vectors.vector_topk(df, "id", "v", df, "id", "v", 4, "part").collect()}
    scores = np.round(data @ data.T, 6)
    for q in range(300):
        mine = [i for i in range(300) if i % 3 == q % 3]
        want = sorted(mine, key=lambda i: (-scores[q, i], i))[:4]
        assert [got[q, r] for r in range(1, 5)] == want


def test_similar_topk_with_pivots_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 10))
    data = np.concatenate([centres[0] + 0.05 * rng.normal(size=(220, 10)), centres[rng.integers(0, 6, 180)] + 0.3 * rng.normal(size=(180, 10))])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id int, v array<double>").repartition(4)
    monkeypatch.setattr(vectors, "UNIT", 16)
    got = values(vectors.similar_topk(df, "id", "v", 0.85, 5).select("id", "rank", "other"))
    sims = np.round(data @ data.T, 6)
    want = []
    for i in range(len(data)):
        near = sorted((j for j in range(len(data)) if j != i and sims[i, j] >= 0.85), key=lambda j: (-sims[i, j], j))[:5]
        want += [(i, r, j) for r, j in enumerate(near, 1)]
    assert got == sorted(want)


def test_rrf_does_not_depend_on_the_order_of_rankings(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "qid int, id string, rank int")
    cols = ["qid", "id", "rrf_score", "vector_rank", "bm25_rank"]
    assert values(fusion.rrf({"vector": a, "bm25": b}).select(cols)) != []
    one = fusion.rrf({"vector": a, "bm25": b}).select("qid", "id", "rrf_score")
    two = fusion.rrf({"bm25": b, "vector": a}).select("qid", "id", "rrf_score")
    assert values(one) == values(two)


def test_bm25_fills_with_the_smallest_unmatched_ids(spark):
    docs = spark.createDataFrame([(i, "alpha" if i == 7 else f"beta{i} gamma") for i in range(10)], "id int, text string")
    q = spark.createDataFrame([(1, "alpha")], "q int, t string")
    out = lexical.bm25_topk(q, "q", "t", docs, "id", "text", None, 3).orderBy("bm25_rank").collect()
    assert [r["id"] for r in out] == [7, 0, 1] and out[1]["score"] == 0.0
    assert lexical.bm25_topk(q, "q", "t", docs, "id", "text", None, 3, keep_zero=False).count() == 1


def test_logic_expression(spark):
    step = lambda op, label="": (op, ladder.ROLES[op], label, "SUB 3")
    cases = [
        ([step("RD", "X1.0"), step("AND", "X1.1"), step("WRT", "Y1.0")], "(X1.0 AND X1.1) -> Y1.0"),
        ([step("RD", "X1.0"), step("AND.STK"), step("WRT", "Y1.0")], None),
        ([step("RD", "A"), step("RD.STK", "B"), step("OR.NOT", "C"), step("AND.STK"), step("SUB"), step("WRT", "Y")], "(A AND (B OR NOT C)) -> SUB 3 -> Y"),
        ([step("RD", "A"), step("RD.STK", "B"), step("WRT", "Y")], None),
        ([step("RD", "A"), step("AND", "B"), step("RD.STK", "C"), step("AND", "D"), step("AND.STK"), step("WRT", "Y")], "(A AND B AND C AND D) -> Y"),
        ([step("RD", "A"), step("RD.STK", "B"), step("SUB")], "B -> SUB 3 [stack: A]"),
        ([step("RD", "A")], None),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s array<struct<op:string,role:string,label:string,f:string>>")
    got = df.orderBy("i").select(ladder.logic_text(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [want for _, want in cases]


def test_listing_with_unknown_lines_inside_a_function(spark):
    text = ["N1: RD X1.0 ;(S)", "  ;[note]", "SUB 3 ; TMR", "R1 ;(ARG)", ";[about]", "", "7", "FOO", "N2: WRT Y1.0", "BAR R2.0", ";[late]"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    got = ladder.steps(lines).orderBy("line_no").select("block", "op", "role", "address", "description").collect()
    assert [tuple(r) for r in got] == [
        ("N1", "RD", "read", "X1.0", "note"), ("N1", "SUB", "sub_instruction", None, None),
        ("N2", "WRT", "write", "Y1.0", None), ("N2", "BAR", "unknown", "R2.0", "late"),
    ]
    args = ladder.function_args(lines).orderBy("line_no").select("value", "symbol", "description").collect()
    assert [tuple(r) for r in args] == [("R1", "ARG", "about"), ("7", None, None), ("FOO", None, None)]


def test_address_ranges_and_width(spark):
    a = spark.createDataFrame([("X", n) for n in (1, 2, 3, 9)] + [("R", n) for n in range(450)], "area string, number long")
    assert values(ladder.address_ranges(a)) == [("R", 0, 199), ("R", 200, 399), ("R", 400, 449), ("X", 1, 3), ("X", 9, 9)]


def test_trace_lines_equals_a_plain_walk(spark):
    rng = np.random.default_rng(1)
    rows = sorted({("f", f"N{rng.integers(0, 30):02d}", f"R{rng.integers(0, 12):02d}", str(rng.choice(["read", "write"]))) for _ in range(160)})
    index = spark.createDataFrame(rows, "file string, block string, address string, use string")
    roots = sorted({r[1] for r in rows})
    reads, writers = {}, {}
    for _, block, address, use in rows:
        (reads.setdefault(block, []) if use == "read" else writers.setdefault(address, [])).append(address if use == "read" else block)
    want = []
    for root in roots:
        seen = []

        def walk(block, level):
            if level >= 2 or len(seen) >= 12:
                return
            for a in sorted(reads.get(block, [])):
                for other in sorted(writers.get(a, [])):
                    if other != block and (block, a, other) not in seen:
                        seen.append((block, a, other))
                        walk(other, level + 1)
                        if len(seen) >= 12:
                            return

        walk(root, 0)
        want += [(root, n, *e) for n, e in enumerate(seen, 1)]
    r = spark.createDataFrame([("f", b) for b in roots], "file string, block string")
    assert values(ladder.trace_lines(index, r, True).drop("file")) == sorted(want)


def test_best_first_equals_a_plain_walk(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(200, 4))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    edges = [(i, f"n{rng.integers(0, 25)}", f"n{rng.integers(0, 25)}", vecs[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(edges, "edge_id int, src string, dst string, vec array<double>")
    query = np.array([1.0, 0, 0, 0])
    seeds = spark.createDataFrame([(1, "n3"), (1, "n8")], "qid int, node string")
    q = spark.createDataFrame([(1, query.tolist())], "qid int, qvec array<double>")
    score = {i: round(float(v @ query), 6) for i, _, _, v in [(e[0], 0, 0, np.array(e[3])) for e in edges]}
    open_, seen, picked = {}, set(), []

    def visit(node, depth):
        if node not in seen:
            seen.add(node)
            for i, s, d, _ in edges:
                if s == node:
                    open_.setdefault(i, (s, d, depth))

    for n in ("n3", "n8"):
        visit(n, 0)
    while open_ and len(picked) < 10:
        best = min(open_, key=lambda i: (-score[i], i))
        s, d, depth = open_.pop(best)
        if score[best] < 0.3:
            break
        picked.append(best)
        if depth < 4:
            visit(s, depth + 1)
            visit(d, depth + 1)
    got = graph.best_first(df, seeds, q, max_triples=10).orderBy("pick").collect()
    assert [r["edge_id"] for r in got] == picked


def test_ppr_mass_is_one_and_stuck_mass_returns(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a", 2.0), (1, "d", 1.0)], "qid int, node string, weight double")
    got = {r["node"]: r["score"] for r in graph.ppr(edges, seeds).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    order = ["a", "b", "c", "d"]
    walk = np.array([[0, 1, 0, 0], [0.5, 0, 0.5, 0], [0, 0, 0, 0], [0, 0, 0, 0]])
    seed = np.array([2 / 3, 0, 0, 1 / 3])
    x = seed.copy()
    for _ in range(graph.rounds_needed()):
        x = 0.7 * seed + 0.3 * (walk.T @ x + seed * x[2:].sum())
    assert np.allclose([got.get(n, 0) for n in order], x, atol=1e-9)


def test_evidence_page_needs_a_single_best(spark):
    c = spark.createDataFrame([(1, "d", 1, 9, "abcdefghij"), (2, "d", 1, 9, "zzzzyyyyxxxx")], "cid int, doc string, first int, last int, excerpt string")
    p = spark.createDataFrame([("d", 1, "abcdefghij"), ("d", 2, "abcdefghij"), ("d", 3, "zzzzyyyyxx"), ("d", 4, "zzzzyyyy")], "doc string, page int, text string")
    assert values(pages.evidence_page(c, p)) == [(2, 3, 3)]


@pytest.mark.parametrize("segment", [40, 90, 100000])
def test_highlight_over_segments_equals_a_text_search(spark, segment):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    pages_ = {p: [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(40)] for p in range(4)}
    passages = {i: " ".join(" ".join(pages_[i % 4]).split(" ")[10 * i + 3:10 * i + 3 + 5 + i]) for i in range(8)}
    passages[8] = passages[0][1:-1]  # starts and ends inside a word
    items = spark.createDataFrame([(p, i, x) for p, xs in pages_.items() for i, x in enumerate(xs)], "page int, pos int, text string")
    asked = spark.createDataFrame(list(passages.items()), "pid int, text string")
    want = set()
    for p, xs in pages_.items():
        body, spans = "", []
        for i, x in enumerate(xs):
            body += " " if body else ""
            spans.append((i, len(body), len(body) + len(x)))
            body += x
        for pid, text in passages.items():
            ws = text.split(" ")
            n = min(6, len(ws))
            starts = [0] if len(ws) <= 6 else [*range(0, len(ws) - n + 1, 6), len(ws) - n]
            for s0 in starts:
                w = " ".join(ws[s0:s0 + n])
                at = body.find(w)
                if at >= 0:
                    want |= {(pid, p, i) for i, a, b in spans if a < at + len(w) and b > at}
    assert set(values(pages.highlight(items, asked, 6, segment))) == want


def test_item_coverage_prefers_the_excerpt_with_more_items(spark):
    body = "power off: alpha here." + " x" * 900 + " power off alpha and beta together"
    df = spark.createDataFrame([(1, body, 0.1), (2, "power off beta", 0.9), (3, "alpha without condition", 5.0)], "id int, t string, score double")
    out = pages.item_coverage(df, "id", "t", "score", {"A": ["alpha"], "B": ["beta"]}, ["power off"]).select("item", "rank", "id", "coverage")
    assert values(out) == [("A", 1, 1, 2), ("B", 1, 1, 2), ("B", 2, 2, 1)]


def test_report_days_and_forecast(spark):
    day = spark.createDataFrame([("2026-10-19",), ("2026-10-20",)], "d string").select(F.to_date("d").alias("d"))
    assert [str(r[0]) for r in day.select(bands.prev_report_date(F.col("d"))).collect()] == ["2026-10-16", "2026-10-19"]
    one = spark.createDataFrame([("2026-10-19", 7)], "d string, result_count long").select(F.to_date("d").alias("day"), "result_count")
    assert [r["forecast"] for r in reports.forecast_weekday(one).collect()] == [7.0] * 7


def test_clipped_seconds_fit_the_day(spark):
    rows = [(i, 1, f"2024-01-0{1 + i % 3} 2{i % 4}:30:00", 90000, "1", None) for i in range(9)]
    s = spark.createDataFrame(rows, "event_id int, machine_code int, o string, operate_period long, status string, alarm_code string")
    parts = intervals.split_by(s.withColumn("occur_date", F.to_timestamp("o")), "day", 8)
    assert parts.filter("seconds < 0 or seconds > 86400").count() == 0
    assert values(parts.groupBy("event_id").agg(F.sum("seconds"))) == [(i, 90000) for i in range(9)]


def test_sync_twice_changes_nothing(spark):
    a = spark.createDataFrame([(1, "x", "m"), (2, "y", "m"), (3, "z", None)], "id int, t string, meta string")
    assert values(sync.sync_plan(a, a, "id", "t", ["meta"]).groupBy("action").count()) == [("unchanged", 3)]
    b = spark.createDataFrame([(1, "x", "n"), (2, "q", "m"), (4, "w", None)], "id int, t string, meta string")
    assert values(sync.sync_plan(b, a, "id", "t", ["meta"])) == [(1, "metadata"), (2, "text"), (3, "stale"), (4, "new")]


def test_last_slots_counts_pairs_once(spark):
    roles = ["system", "user", "assistant", "assistant", "user", "user", "assistant"]
    rows = [(1, i, r, "[SUMMARY] s" if r == "system" else f"t{i}") for i, r in enumerate(roles)]
    m = spark.createDataFrame(rows, "session int, pos long, role string, text string")
    assert [r[1] for r in values(chat.last_slots(m, 3).select("session", "pos"))] == [3, 4, 5, 6]
    assert [r[1] for r in values(chat.last_slots(m, 2).select("session", "pos"))] == [4, 5, 6]


def test_rules(spark):
    df = spark.createDataFrame([("3쪽 열어줘",), ("그냥 질문",), ("open the manual page 7",), ("2번",), ("열지 마",)], "q string")
    got = [tuple(r) for r in df.select(rules.parse_command(F.col("q")).alias("c")).select("c.*").collect()]
    assert got == [("open", 3, None, None), ("none", None, None, None), ("open", 7, None, None), ("choice", None, None, 2), ("none", None, None, None)]
    label = spark.createDataFrame([("warning sign",), ("warning sign: door",), ("warnings in a diagram",), ("고압 위험 표지",)], "t string")
    assert [r[0] for r in label.select(rules.is_warning_icon(F.col("t"))).collect()] == [True, True, False, True]


def test_markup_and_triples(spark):
    df = spark.createDataFrame([('<p>A<br>B</p><table><tr><td>1</td><td>2</td></tr></table><img alt="pump" src="x">',)], "h string")
    assert df.select(parse.page_text(F.col("h"))).first()[0].split("\n")[0] == "A"
    assert "1 | 2 |" in df.select(parse.page_text(F.col("h"))).first()[0]
    assert "[그림 설명] pump" in df.select(parse.page_text(F.col("h"))).first()[0]
    long = "x" * 121
    t = spark.createDataFrame([(f'[["a","b","c"],["a","b","c"],["{long}","b","c"],["a",""," "]]',), ("nothing",)], "t string")
    assert [r[0] for r in t.select(parse.parse_triples(F.col("t"))).collect()] == [[["a", "b", "c"]], []]


def test_unknown_filter_operator_is_refused(spark):
    from plantlens.operators.catalog import where_filter

    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        where_filter(df, {"a": {"$gt": 0}})


def test_resolve_documents_by_containment(spark):
    from plantlens.operators.catalog import resolve_documents

    docs = spark.createDataFrame([("guide m1",), ("m10",), ("pump",), ("m1 manual extra",)], "doc_key string")
    registry = spark.createDataFrame([("m1", "A"), ("m10", "B"), ("m1 manual extra long", "C")], "doc_key string, machine string")
    assert values(resolve_documents(docs, registry, "doc_key", "machine")) == [
        ("guide m1", "A"), ("m1 manual extra", "A"), ("m1 manual extra", "C"), ("m10", "B"),
    ]


def test_verify_quotes_collapses_space(spark):
    claims = spark.createDataFrame([(1, "s", "a  b"), (2, "s", "c"), (3, "none", "a"), (4, "s", " ")], "claim int, source string, quote string")
    sources = spark.createDataFrame([("s", "x a\nb y")], "source string, text string")
    assert values(audit.verify_quotes(claims, sources).select("claim", "verified")) == [(1, True), (2, False), (3, False), (4, False)]


def test_caller_supplied_batch_functions(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "aa"), (2, "b")], "id int, p string")
    embed_fn = lambda batches: (pd.DataFrame({"id": b["id"], "vec": [[float(len(p))] for p in b["p"]]}) for b in batches)
    assert values(tables.embed(df, embed_fn, "id", "p")) == [(1, [2.0]), (2, [1.0])]


def test_sync_plan_compares_nulls(spark):
    schema = "id int, t string, meta string"
    a = spark.createDataFrame([(1, None, "m"), (2, "x", "m"), (3, None, "m")], schema)
    b = spark.createDataFrame([(1, None, "m"), (2, None, "m"), (4, None, "m")], schema)
    assert values(sync.sync_plan(b, a, "id", "t", ["meta"])) == [(1, "unchanged"), (2, "text"), (3, "stale"), (4, "new")]


def test_revisions_and_fingerprints_see_where_a_null_stands(spark):
    from plantlens.operators.assembly import fingerprint

    one = spark.createDataFrame([("d", 1, None, "b")], "doc string, n int, x string, y string")
    two = spark.createDataFrame([("d", 1, "b", None)], "doc string, n int, x string, y string")
    revision = lambda df: sync.revisions(df, "doc", ["n", "x", "y"]).first().revision
    finger = lambda df: fingerprint(df, "n", ["n", "x", "y"]).first().fingerprint
    assert revision(one) != revision(two) and finger(one) != finger(two)


def test_two_identifiers_do_not_repeat_an_item(spark):
    from plantlens.operators.catalog import keep_identified

    items = spark.createDataFrame([(1, "pictures", "see A1 and B2"), (1, "pictures", "none"), (1, "text", "x")], "q int, kind string, t string")
    wanted = spark.createDataFrame([(1, "A1"), (1, "B2")], "q int, identifier string")
    assert values(keep_identified(items, "q", "t", "kind", wanted)) == [(1, "pictures", "see A1 and B2"), (1, "text", "x")]


def test_windows_end_at_lines():
    from plantlens.operators.chunking import cut_windows

    rng = np.random.default_rng(2)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n"), rng.integers(0, 60)))
        size = int(rng.integers(2, 20))
        overlap = int(rng.integers(0, size))
        want, at = [], 0
        while at < len(text):
            stop = at + size
            if stop < len(text):
                ends = [i + 1 for i in range(at + size // 2, stop) if text[i] == "\n" and i > at + overlap]
                stop = ends[-1] if ends else stop
            want.append(text[at:stop].strip())
            if stop >= len(text):
                break
            at = stop - overlap
        assert cut_windows(text, size, overlap) == [w for w in want if w]


def test_delta_text(spark):
    from plantlens.functions.bands import delta_text

    df = spark.createDataFrame([(0, 1.25), (1, -1250.5), (2, 0.0), (3, None)], "i int, d double")
    rows = df.orderBy("i").select(delta_text(F.col("d"), "point"), delta_text(F.col("d"), "hours")).collect()
    assert [tuple(r) for r in rows] == [("+1.3%p", "+1시간 15분"), ("-1250.5%p", "-1,250시간 30분"), ("0.0%p", "0시간 0분"), ("전일 데이터 없음", "전일 데이터 없음")]


def test_pictures_that_hits_show_are_not_offered_again(spark):
    hits = spark.createDataFrame([(1, "d", 3, 1), (2, "d", 3, 1)], "qid int, doc string, page int, rank int")
    figures = spark.createDataFrame([("d", 3, f"p{i}", "c") for i in range(4)] + [("d", 4, "p9", "c"), ("d", 4, "p8", " ")], "doc string, page int, path string, caption string")
    already = spark.createDataFrame([(1, "p0"), (1, "p1")], "qid int, path string")
    got = values(pages.nearby_figures(hits, figures, 3, already).select("qid", "figure_no", "path"))
    assert got == [(1, 1, "p2"), (1, 2, "p3"), (1, 3, "p9"), (2, 1, "p0"), (2, 2, "p1"), (2, 3, "p2")]


def test_page_search_by_document(spark):
    scores = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 1, 0.9), (1, "b", 2, 0.1)], "qid int, doc string, page int, score double")
    texts = spark.createDataFrame([("a", 1, "A1"), ("b", 2, "B2")], "doc string, page int, text string")
    got = values(pages.page_search(scores, texts, 2, ("doc", "page")).select("qid", "rank", "doc", "text"))
    assert got == [(1, 1, "b", ""), (1, 2, "a", "A1")]


def test_scoped_search_sees_the_routed_files_only(spark):
    docs = spark.createDataFrame([(i, f"word{i} pump valve", "xyz"[i % 3], "m" if i < 9 else "n") for i in range(12)], "id int, text string, doc string, machine string")
    vecs = docs.filter("doc <> 'z'").select("id", "doc", "machine", F.array(F.lit(1.0), F.col("id") / 10.0).alias("vec"))
    asked = [(1, "word0 word1 pump", "m"), (2, "word2 pump", "m"), (3, "word4 pump", "m"), (4, "word9 pump", "n"), (5, "word0 word3 pump", "m")]
    queries = spark.createDataFrame([(q, t, m, [0.0, 1.0]) for q, t, m in asked], "qid int, qtext string, machine string, qvec array<double>")
    scope = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "y"), (4, "x"), (5, "x")], "qid int, doc string")
    got = fusion.scoped_hybrid(queries, docs, vecs, scope, 4, "machine").collect()
    ids = {q: {r["id"] for r in got if r["qid"] == q} for q in range(1, 6)}
    assert ids[1] == {0, 3, 6} == ids[5] and ids[4] == {9, 10}
    assert {r["qid"] for r in got if r["fallback"]} == {2}
    whole = {(r["qid"], r["id"]): r["rrf_score"] for r in fusion.hybrid(queries.filter("qid in (2, 3)"), docs, vecs, 4, "machine").collect()}
    assert {(r["qid"], r["id"]): r["rrf_score"] for r in got if r["qid"] in (2, 3)} == whole


def test_items_of_model_output(spark):
    from plantlens.functions.parse import parse_items

    texts = ['```json\n[{"a": " x ", "b": 2}, {"a": "y"}, 3]\n```', '[{"a": "1", "b": "2"}]', '{"a": "1", "b": "2"}', "nothing", None, "```", "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[tuple(x) for x in r[0]] for r in df.orderBy("i").select(parse_items(F.col("t"), ["a", "b"])).collect()]
    assert got == [[("x", "2")], [("1", "2")], [], [], [], [], []]


@pytest.mark.parametrize("ids", [[5], list(range(70)), [0, 3, 64, 200, 4097], [None, 0, 9], [-70, 3], []])
def test_fingerprint_is_a_tree_of_any_height(spark, ids):
    import hashlib

    from plantlens.operators.assembly import fingerprint

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    places = [-1 if i is None else i for i in ids]
    level = {p - min(0, *places): sha(("-" if i is None else f"{len(str(i))}:{i}") + "1:x") for p, i in zip(places, ids)}
    first = True
    while level and (first or len({i for i in level}) > 1):
        blocks = {}
        for i in sorted(level):
            blocks.setdefault(i // 4, []).append(level[i])
        level, first = {b: sha("".join(h)) for b, h in blocks.items()}, False
    want = (next(iter(level.values()), sha("")), len(ids))
    df = spark.createDataFrame([(i, "x") for i in ids], "id bigint, t string")
    assert tuple(fingerprint(df, "id", ["id", "t"], 4).first()) == want
