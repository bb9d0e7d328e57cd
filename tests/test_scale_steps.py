"""Steps whose tasks must not grow with one key."""

from plantlens.operators import audit, graph, ladder, pages, vectors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rerank_moves_single_addresses(spark):
    hits = spark.createDataFrame([("q", "f", "b1", 1), ("q", "f", "b2", 2), ("q", "f", "b3", 3), ("p", "f", "b1", 1)], "qid string, file string, block string, rank int")
    summary = spark.createDataFrame([("f", "b1", ["X1"]), ("f", "b2", ["X1", "X2", "X2"])], "file string, block string, addresses array<string>")
    linked = spark.createDataFrame([("q", ["X1", "X2", "X3"])], "qid string, addresses array<string>")
    out = ladder.rerank(hits, summary, linked, spark.createDataFrame([("q", "b3")], "qid string, block string"))
    assert "array_intersect" not in plan(out)
    assert sorted((r.qid, r.block, r.matches, r.new_rank) for r in out.collect()) == [("p", "b1", 0, 1), ("q", "b1", 1, 3), ("q", "b2", 2, 2), ("q", "b3", 0, 1)]


def test_lines_do_not_move_by_question(spark):
    texts = spark.createDataFrame([("q", 1, "the a\nb\nthe c"), ("q", 2, "of")], "qid string, source int, text string")
    items = spark.createDataFrame([("q", "x", "the"), ("q", "y", "of")], "qid string, item string, pattern string")
    out = audit.item_lines(texts, items)
    assert "strategy=broadcast" in plan(out)
    assert sorted((r.item, r.source, r.pos, r.line_no) for r in out.collect()) == [("x", 1, 0, 1), ("x", 1, 2, 2), ("y", 2, 0, 1)]


def test_highlight_in_lots(spark, monkeypatch):
    items = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "e f g"), (2, 0, "x b c d y")], "page int, pos int, text string")
    passages = spark.createDataFrame([(7, "b c d e"), (8, "x b c"), (9, "g")], "pid int, text string")
    want = [(7, 1, 0), (7, 1, 1), (8, 2, 0), (9, 1, 1)]
    for lot in (1, 4096):
        monkeypatch.setattr(pages, "WINDOW_LOT", lot)
        assert sorted((r.pid, r.page, r.pos) for r in pages.highlight(items, passages).collect()) == want


def test_walk_with_vectors_apart(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1), (2, "b", "c", 2), (3, "a", "c", 9)], "edge_id long, src string, dst string, vec_id int")
    held = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6])], "vec_id int, vec array<double>")
    seeds, asked = spark.createDataFrame([("q", "a")], "qid string, node string"), spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qvec array<double>")
    got = graph.best_first(edges, seeds, asked, vectors=held)
    assert sorted((r.pick, r.edge_id, r.score) for r in got.collect()) == [(1, 1, 1.0), (2, 2, 0.8)]


def test_similar_rows_in_many_tasks(spark, monkeypatch):
    for name, size in {"CELL": 16, "UNIT": 8, "BAND": 3, "TASK": 16}.items():
        monkeypatch.setattr(vectors, name, size)
    rows = [(i, [1.0, i / 50, (i % 7) / 10]) for i in range(60)]
    unit = vectors.unit_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "v")
    got = sorted((r.id, r.other, r.rank) for r in vectors.similar_topk(unit, "id", "v", 0.9, 3).collect())
    vec = {r.id: r.v for r in unit.collect()}
    want = []
    for a in vec:
        near = sorted((-round(sum(x * y for x, y in zip(vec[a], vec[b])), 6), b) for b in vec if b != a)
        want += [(a, b, n) for n, (s, b) in enumerate([x for x in near if -x[0] >= 0.9][:3], 1)]
    assert got == sorted(want)


def test_similar_rows_are_stored_once(spark, monkeypatch):
    for name, size in {"CELL": 4, "UNIT": 8, "BAND": 5, "TASK": 16}.items():
        monkeypatch.setattr(vectors, name, size)
    stored, keep = [], vectors.cut_lineage

    def counted(df):
        df = keep(df)
        if "vec" in df.columns:
            stored.append(df.count())
        return df

    monkeypatch.setattr(vectors, "cut_lineage", counted)
    rows = [(i // 2 if i < 10 else i, [1.0, (i % 9) / 10, (i % 7) / 10]) for i in range(60)]  # repeated ids, equal vectors
    unit = vectors.unit_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "v")
    got = sorted((r.id, r["rank"], r.score) for r in vectors.similar_topk(unit, "id", "v", 0.1, 3).collect())
    vec = [(r.id, r.v) for r in unit.collect()]
    want = []
    for a in {i for i, _ in vec}:
        near = sorted((-round(sum(x * y for x, y in zip(v, w)), 6), b) for i, v in vec if i == a for b, w in vec if b != a)
        want += [(a, n, -s) for n, (s, b) in enumerate(near[:3], 1)]
    assert got == sorted(want) and stored == [60]


def test_listing_lines_move_once(spark, monkeypatch):
    """Arguments, notes and labels are found across bucket borders, and a hand-over between them is one row a bucket."""
    text = {
        0: "N1: RD X1.0 ;(A)", 1: ";[first]", 2: ";[second]", 5: "SUB 7 ; FN", 6: "R1 ;(P)", 9: ";[about]", 13: ";[later]", 14: "", 15: "R2", 21: "N2: WRT Y2.1", 22: "AND X3.0",
        30: ";[far]", 38: ";[farther]", 39: "SUB 8", 47: ";[no argument yet]", 55: "R9",
    }
    lines = spark.createDataFrame([(f, n, line) for f in ("f", "g", None) for n, line in text.items()], "file string, line_no long, line string")

    def found():
        steps = {(r.file, r.line_no): (r.block, r.op, r.description) for r in ladder.steps(lines).collect()}
        args = {(r.file, r.line_no): (r.block, r.sub_line, r.value, r.symbol, r.description) for r in ladder.function_args(lines).collect()}
        nets = sorted((str(r.file), r.line_no, r.net) for r in ladder.nets(ladder.steps(lines)).collect())
        return steps, args, nets

    whole = found()
    assert whole[0]["f", 0] == ("N1", "RD", "second") and whole[0]["g", 22] == ("N2", "AND", "farther") and whole[0][None, 0][2] is None
    assert whole[1]["f", 6] == ("N1", 5, "R1", "P", "later") and whole[1]["f", 55][4] is None
    for size in (1, 8):
        monkeypatch.setattr(ladder, "LINE_BUCKET", size)
        assert found() == whole
    for out in (ladder.steps(lines), ladder.function_args(lines)):
        exchanges = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
        assert len(out.columns) and not any("coalesce" in x for x in exchanges) and sum("REPARTITION_BY_COL" in x for x in exchanges) >= 1


def test_passages_without_a_join_by_position(spark):
    rows = [(1, 1, " A", "r", "b", "S"), (1, 2, " A", "r", "b", "S"), (2, 1, "b", "r", "C", "S"), (2, 1, "b", "q", "C", "S"), (None, 0, "b", "r", "C", "S"), (3, 1, " ", "r", "d", "S")]
    triples = spark.createDataFrame(rows, "chunk_id long, pos long, s string, p string, o string, section string")
    edges = graph.build_kg(triples.filter("chunk_id is not null"), surfaces=True)[1]
    wanted = triples.select("s", "p", "o").distinct().select("p", "s", "p", "o").toDF("qid", "s", "p", "o")
    out = graph.triple_passages(wanted, edges)
    assert plan(out).count("Join") == 2
    assert sorted((r.qid, r.s, r.o, r.chunk_id, r.passage) for r in out.collect()) == [
        ("q", "b", "C", 2, "passage::2"), ("r", " A", "b", 1, "passage::1"), ("r", "b", "C", 2, "passage::2")]
