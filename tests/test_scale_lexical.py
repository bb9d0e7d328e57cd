"""Scoring in units: the k best of each query, or of each query and group, as they stand in the full scores."""

from pyspark.sql import functions as F

from plantlens.operators import lexical

WORDS = ["pump", "oil", "valve", "motor", "belt", "fan", "gear"]


def tables(spark):
    docs = [(i, " ".join(WORDS[j % 7] for j in range(i % 5, i % 5 + 1 + i % 4)), "ab"[i % 2]) for i in range(40)]
    docs += [(3, "oil oil fan", "b"), (None, "gear pump", "a"), (41, None, "a")]
    asked = [(1, "pump oil"), (2, "pump oil"), (3, "gear gear fan"), (4, None), (5, "nothing"), (1, "oil")]
    return spark.createDataFrame(asked, "q int, t string"), spark.createDataFrame(docs, "id int, text string, grp string")


def best(rows, k):
    held = {}
    for r in sorted(rows, key=lambda r: (-r.score, r.id is not None, r.id or 0)):
        held.setdefault(r.qid, []).append((r.id, r.score))
    return {q: x[:k] for q, x in held.items()}


def test_best_of_units(spark, monkeypatch):
    monkeypatch.setattr(lexical, "POSTING_BLOCK", 8)
    monkeypatch.setattr(lexical, "CELLS", 4)
    q, docs = tables(spark)
    every = lexical.bm25_scores(q, "q", "t", docs, "id", "text").collect()
    assert {r.qid for r in every} == {1, 2, 3}
    assert best([r for r in every if r.score], 4) == best(lexical.bm25_scores(q, "q", "t", docs, "id", "text", k=4).collect(), 4)
    grouped = lexical.bm25_scores(q, "q", "t", docs, "id", "text", k=2, group="grp").collect()
    for name in "ab":
        ids = {r.id for r in docs.filter(F.col("grp") == name).collect()}
        inside = lambda rows: best([r for r in rows if r.id in ids and r.score > 0], 2)  # noqa: E731, B023
        assert inside(grouped) == inside(every)


def test_tfidf_best_of_units(spark, monkeypatch):
    monkeypatch.setattr(lexical, "POSTING_BLOCK", 8)
    q, docs = tables(spark)
    every = lexical.tfidf_scores(q, "q", "t", docs, "id", "text").collect()
    assert best(every, 3) == best(lexical.tfidf_topk(q, "q", "t", docs, "id", "text", 3).collect(), 3)


def test_equal_queries_are_scored_once(spark):
    q, _ = tables(spark)
    classes, members = lexical._classes(q.filter("q in (2, 9) or q = 3").unionByName(spark.createDataFrame([(9, "pump oil")], q.schema)), None, "q", "t")
    assert (classes.count(), members.count()) == (2, 3)


def test_repeated_ids_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c d"), (2, "a"), (3, None)], "id int, text string")
    rows = lexical.index(docs, "id", None, "text").filter("term is not null").collect()
    assert sorted((r.id, r.dl, r.term, r.tf) for r in rows) == [(1, 3, "a", 2), (1, 3, "b", 2), (1, 3, "c", 1), (1, 3, "d", 1), (2, 1, "a", 1)]
