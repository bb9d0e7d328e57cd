"""Page-level retrieval: context expansion, figures, evidence pages, highlights, evidence rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import excerpt, let, match_text
from ..session import cut_lineage, fresh_path, small
from .chunking import char_shingles, word_windows
from .ordered import first_per_key, neighbour, running_sum, topk

PAGE_LIMIT = 6000  # fixed value: larger pages keep the original hit


def expand_pages(hits: DataFrame, blocks: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """Replace hits by their whole page, each page once per query, unless the page text exceeds the limit.

    ``hits``: qid, id, doc, page, text, rank; ``blocks``: doc, page, position, text. Only pages within the
    limit are ever gathered into one row.
    """
    size = blocks.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("page_chars"))
    small = size.filter(F.col("page_chars") <= limit).join(hits.select("doc", "page").distinct(), ["doc", "page"], "left_semi")
    whole = (
        blocks.filter(F.trim("text") != "")
        .join(small, ["doc", "page"])
        .groupBy("doc", "page")
        .agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("__b"))
        .select("doc", "page", F.array_join(F.transform("__b", lambda b: b.text), "\n\n").alias("page_text"))
    )
    joined = hits.join(whole, ["doc", "page"], "left")
    pages = first_per_key(joined.filter(F.col("page_text").isNotNull()), ["qid", "doc", "page"], [F.col("rank"), F.col("id")])
    single = joined.filter(F.col("page_text").isNull())
    row = lambda df, scope, text: df.select("qid", "doc", "page", "id", "rank", F.lit(scope).alias("scope"), text.alias("text"))
    return row(pages, "page", F.col("page_text")).unionByName(row(single, "hit", F.col("text")))


def page_search(scores: DataFrame, texts: DataFrame, k: int, page: Sequence[str] = ("page",)) -> DataFrame:
    """The k best pages of each query with their text, empty where a page has none.

    ``scores``: qid, the ``page`` columns, score; ``texts``: the ``page`` columns, text. Pages of several documents are
    told apart with page=("doc", "page").
    """
    best = topk(scores, ["qid"], [F.col("score").desc(), *[F.col(c) for c in page]], k)
    return best.join(texts, list(page), "left").select("qid", *page, "score", "rank", F.coalesce("text", F.lit("")).alias("text"))


def nearby_figures(hits: DataFrame, figures: DataFrame, limit: int = 5, already: DataFrame | None = None) -> DataFrame:
    """Figures with a caption on a hit's page or the next one; first mention of a path counts; at most ``limit``.

    ``hits``: qid, doc, page (null unless the hit covers one page), rank; ``figures``: doc, page, path, caption;
    ``already``: qid, path of the pictures that the hits show themselves, which are not offered again.
    """
    shown = figures.filter((F.coalesce(F.trim("caption"), F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))
    shown = first_per_key(shown, ["doc", "page", "path"], [F.col("caption")])
    asked = first_per_key(hits.filter(F.col("page").isNotNull()), ["qid", "doc", "page"], [F.col("rank")])
    wanted = asked.select("qid", "doc", "rank", F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page"))
    found = wanted.join(shown, ["doc", "page"])
    if already is not None:
        found = found.join(already.select("qid", "path").distinct(), ["qid", "path"], "left_anti")
    order = [F.col("rank"), F.col("page"), F.col("path"), F.col("doc")]
    return topk(first_per_key(found, ["qid", "path"], order), ["qid"], order, limit, "figure_no").select(
        "qid", "figure_no", "doc", "page", "path", "caption"
    )


def evidence_page(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of a range sharing most text fragments with the excerpt; a tie or no overlap gives none.

    ``candidates``: cid, doc, first, last, excerpt; ``pages``: doc, page, text.
    """
    cut = candidates.select("cid", "doc", "first", "last", char_shingles(F.col("excerpt")).alias("__p"))
    wanted = cut.select("cid", "doc", "first", "last", F.explode_outer("__p").alias("piece"))
    near = pages.join(small(candidates.select("doc").distinct()), "doc", "left_semi")
    held = near.select("doc", "page", char_shingles(F.col("text")).alias("__p")).select("doc", "page", F.explode_outer("__p").alias("piece"))
    overlap = (
        held.join(small(wanted), ["doc", "piece"])
        .filter(F.col("page").between(F.col("first"), F.col("last")))
        .groupBy("cid", "page")
        .agg(F.count("*").alias("overlap"))
    )
    top = overlap.groupBy("cid").agg(F.max("overlap").alias("overlap"))
    best = overlap.join(top, ["cid", "overlap"])
    single = best.groupBy("cid", "overlap").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    return single.filter("n = 1").select("cid", "page", "overlap")


SEED_WORDS = 3
WINDOW_LOT = 4096  # windows of one lot


def highlight(items: DataFrame, passages: DataFrame, width: int = 18, segment: int = 65536) -> DataFrame:
    """Page items touched by the first occurrence of a passage window on the page.

    ``items``: page, pos, text; ``passages``: pid, text. A page is read in segments of about ``segment`` characters,
    each with the last ``width`` words before it, so no page has to fit into one task. The inner words of a window
    must stand on the page as whole words, so segments are found by an equi join on the hash of the first of them; the inner
    words and then the window itself are located as plain text. Windows of one or two words are matched on whole words only.
    """
    plain = items.select("page", "pos", match_text(F.col("text")).alias("t"))
    path = fresh_path(items.sparkSession, "lines")  # stored, so each line is normalised once and not in every step below
    plain.write.parquet(path)
    plain = items.sparkSession.read.schema(plain.schema).parquet(path).filter(F.col("t") != "")
    spans = running_sum(plain, ["page"], ["pos"], F.floor(F.col("pos") / 4096), F.length("t") + 1, "__end")
    spans = cut_lineage(spans.select("page", "pos", "t", (F.col("__end") - F.length("t") - 1).alias("a"), (F.col("__end") - 1).alias("b")))
    cell = lambda c: F.floor(c / segment)
    bodies = _segments(spans.withColumn("seg", cell(F.col("a"))), width)

    windows = passages.select("pid", word_windows(F.col("text"), width).alias("__w")).select("pid", F.explode_outer("__w").alias("window"))
    words = F.split("window", " ")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(words)
    seed = F.slice(inner, 1, SEED_WORDS)
    windows = windows.filter("window is not null").select(
        "pid", "window", F.array_join(inner, " ").alias("inner"), F.size(seed).alias("n"), F.xxhash64(F.array_join(seed, " ")).alias("seed"))

    bodies = cut_lineage(bodies)
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most SEED_WORDS values
    runs = bodies.withColumn("w", F.split("body", " ")).select("page", "offset", F.explode(_seeds(F.col("w"), sizes)).alias("s"))
    windows = cut_lineage(windows)
    lots = windows.count() // WINDOW_LOT + 1
    met = runs.select("page", "offset", "s.n", "s.seed").join(small(windows), ["n", "seed"])
    # a segment meets its windows once for each lot of them
    met = met.groupBy("page", "offset", F.pmod(F.xxhash64("window"), F.lit(lots)).alias("lot")).agg(F.collect_list(F.struct("pid", "window", "inner")).alias("ws"))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    place = lambda w, b: F.when(F.contains(b, padded(w.inner)), F.instr(F.col("body"), w.window)).otherwise(0)
    each = let(padded(F.col("body")), lambda b: F.filter(
        F.transform("ws", lambda w: F.struct(w.pid.alias("pid"), w.window.alias("window"), place(w, b).alias("at"))), lambda x: x["at"] > 0))
    near = met.join(bodies, ["page", "offset"]).select("page", "offset", F.explode(each).alias("x"))
    found = near.select("page", "x.pid", "x.window", (F.col("offset") + F.col("x.at") - 1).alias("s"))
    hit = found.groupBy("page", "pid", "window").agg(F.min("s").alias("s")).select("page", "pid", "s", (F.col("s") + F.length("window")).alias("e"))
    over = hit.withColumn("cell", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e")))))
    held = spans.select("page", "pos", "a", "b", F.explode(F.sequence(cell(F.col("a")), cell(F.col("b")))).alias("cell"))
    touched = held.join(over, ["page", "cell"]).filter((F.col("a") < F.col("e")) & (F.col("b") > F.col("s")))
    return touched.select("pid", "page", "pos").distinct()


def _segments(spans: DataFrame, width: int) -> DataFrame:
    """Text of each segment behind the last ``width`` words of the text before it, with its place on the page."""
    last = lambda words: F.slice(words, F.greatest(F.size(words) - width + 1, F.lit(1)), F.lit(width))
    parts = spans.groupBy("page", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("__i"), F.min("a").alias("a"))
    parts = parts.select("page", "seg", "a", F.array_join(F.transform("__i", lambda i: i.t), " ").alias("body"))
    tails = parts.select("page", "seg", last(F.split("body", " ")).alias("__t"))
    keys, order, bucket = ["page"], ["seg"], F.floor(F.col("seg") / 1024)
    # a short segment stands between longer ones, so two steps back always reach ``width`` words
    for name, source in (("__p", "__t"), ("__q", "__p")):
        tails = neighbour(tails, keys, order, bucket, {name: F.col(source)})
    none = F.array().cast("array<string>")
    before = F.array_join(last(F.concat(F.coalesce("__q", none), F.coalesce("__p", none))), " ")
    d = parts.join(tails.select("page", "seg", before.alias("__b")), ["page", "seg"])
    full = F.when(F.col("__b") == "", F.col("body")).otherwise(F.concat_ws(" ", "__b", "body"))
    lead = F.when(F.col("__b") == "", 0).otherwise(F.length("__b") + 1)
    return d.select("page", full.alias("body"), (F.col("a") - lead).alias("offset"))


def _seeds(words: Column, sizes: Sequence[int]) -> Column:
    """Distinct hashes of all runs of the given numbers of words, with that number."""

    def runs(n: int) -> Column:
        last = F.size(words) - n + 1
        hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " ")))
        hashes = F.when(last > 0, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("seed")))

    return F.concat(*[runs(n) for n in sizes or (SEED_WORDS,)])


BEFORE, AFTER = 650, 500  # fixed values: characters of an excerpt around a mention


def item_coverage(
    scored: DataFrame, key: str, text: str, score: str, items: dict[str, Sequence[str]], condition: Sequence[str], best: int = 2
) -> DataFrame:
    """Per item the ``best`` passages, with the excerpt around a mention that covers most items under the condition."""
    patterns = {label: re.compile(_guarded(terms), re.I) for label, terms in items.items()}
    needed = re.compile(_guarded(condition), re.I) if condition else None

    def holds(pattern: re.Pattern | None, passage: str) -> bool:
        return pattern is None or pattern.search(passage) is not None

    def cover(body: str) -> list[dict]:
        out = []
        for label, pattern in patterns.items() if holds(needed, body) else ():
            around = [body[max(0, m.start() - BEFORE):m.end() + AFTER] for m in pattern.finditer(body)]
            counted = [(sum(holds(p, x) for p in patterns.values()), x) for x in around if holds(needed, x)]
            if counted:
                coverage, passage = max(counted, key=itemgetter(0))  # the first of the best
                out.append({"item": label, "coverage": coverage, "excerpt": passage})
        return out

    @F.pandas_udf("array<struct<item:string,coverage:int,excerpt:string>>")
    def covers(bodies: pd.Series) -> pd.Series:
        return bodies.map(cover)

    hits = scored.select(key, score, F.explode(covers(F.col(text))).alias("__c")).select(key, score, "__c.*")
    hits = hits.withColumn("item_score", F.round(F.col(score) + F.col("coverage"), 6))
    return topk(hits, ["item"], [F.col("item_score").desc(), F.col(key)], best)


def _guarded(terms: Sequence[str]) -> str:
    return "|".join(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])" if t.isascii() else re.escape(t) for t in terms)


def supporting_evidence(hits: DataFrame, linked: DataFrame, n: int, chars: int = 1800) -> DataFrame:
    """First n text hits of linked, non-electrical documents, cut to ``chars``.

    ``hits``: qid, id, doc, kind, text, rank; ``linked``: doc.
    """
    electrical = r"(?i)electrical|circuit\s*diagram|전기\s*(도면|회로)"
    good = hits.filter(
        (F.trim("text") != "") & ~F.col("kind").isin("ladder", "pictures", "tables") & ~F.col("doc").rlike(electrical)
    ).join(linked.select("doc").distinct(), "doc", "left_semi")
    kept = topk(good, ["qid"], [F.col("rank"), F.col("id")], n, "evidence_no")
    return kept.select("qid", "evidence_no", "id", "doc", F.substring("text", 1, chars).alias("text"))


def answer_sources(hits: DataFrame, limit: int = 700, marker: str = "\n[이하 생략]") -> DataFrame:
    """Numbered source rows: passage text, or caption, header and rows of a table, cut to ``limit``.

    ``hits``: qid, corpus, rank, kind, text, caption, header, rows. Numbers run on across the corpora of a query.
    """
    table = F.concat_ws("\n", "caption", "header", "rows")
    content = F.trim(F.when(F.col("kind") == "table", table).otherwise(F.col("text")))
    kept = hits.withColumn("content", excerpt(content, limit, marker)).filter(F.col("content") != "")
    numbered = kept.withColumn("__one", F.lit(1))
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy("corpus", "rank")
    return numbered.withColumn("source_no", F.row_number().over(w)).select("qid", "source_no", "corpus", "kind", "content")
