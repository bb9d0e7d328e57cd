"""Lexical statistics and ranking: BM25 and TF-IDF over whole corpora.

Queries and documents are tables. ``part`` (a machine code, or one constant for the whole corpus)
keeps statistics per machine. Scores are rounded to 6 places before ranking; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let, tokens
from ..session import cut_lineage, fresh_path, small
from .ordered import topk
from .vectors import grid, in_units

# Fixed values of the ranking formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
# Stop words of the word analyser (the common English function words).
STOP_WORDS = (
    "a about after again all also an and any are as at be been before but by can could did do does for from had has "
    "have he her here him his how i if in into is it its me more most my no nor not of on only or other our out over "
    "own same she so some such than that the their them then there these they this those through to too under up very "
    "was we were what when where which while who whom why will with would you your"
).split()


def _keys(part: str | None) -> list[str]:
    return ["part"] if part else []


def _tokenised(df: DataFrame, part: str | None, **columns: Column) -> DataFrame:
    held = [F.col(part).alias("part")] if part else []
    return df.select(*held, *[c.alias(n) for n, c in columns.items()])


def index(docs: DataFrame, id: str, part: str | None, text: str, terms: Callable[[Column], Column] = tokens) -> DataFrame:
    """Stored postings ([part,] id, dl, term, tf), and a row without a term for each document; dl is the number of its tokens.

    Texts are read and cut once, and a document's tokens are counted in its own row, so nothing moves. Rows that share an id are counted together:
    only theirs are grouped.
    """
    keys = _keys(part)
    rows = _tokenised(docs, part, id=F.col(id), text=F.col(text))
    twice = cut_lineage(rows.groupBy(*keys, "id").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    null = F.lit(None).cast("string")

    def cut(some: DataFrame) -> DataFrame:
        return some.select(*keys, "id", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("tk"))

    def of_twice(how: str) -> DataFrame:
        other = small(twice.select(*[F.col(c).alias(f"__{c}") for c in twice.columns]))
        same = [rows[c].eqNullSafe(other[f"__{c}"]) for c in twice.columns]
        return cut(rows.join(other, same, how))

    some = not twice.isEmpty()
    once = (of_twice("left_anti") if some else cut(rows)).select(*keys, "id", F.size("tk").cast("bigint").alias("dl"), _counted("tk").alias("c"))
    held = once.select(*keys, "id", "dl", F.explode(F.array_append("c", F.struct(null.alias("term"), F.lit(1).cast("bigint").alias("tf")))).alias("c"))
    held = held.select(*keys, "id", "dl", "c.term", "c.tf")
    if some:
        more = of_twice("left_semi").select(*keys, "id", F.size("tk").cast("bigint").alias("dl"), F.explode(F.array_append("tk", null)).alias("term"))
        held = held.unionByName(more.groupBy(*keys, "id", "dl", "term").agg(F.count("*").alias("tf")))
    path = fresh_path(docs.sparkSession, "postings")
    held.write.parquet(path)
    return docs.sparkSession.read.schema(held.schema).parquet(path)


def _counted(column: str) -> Column:
    """(term, tf) of each distinct term of a list: runs of the sorted list, from one run's last place to the next one's."""

    def runs(tk: Column) -> Column:
        places = F.when(F.size(tk) > 0, F.sequence(F.lit(0), F.size(tk) - 1)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(places, lambda i: (i == F.size(tk) - 1) | (F.get(tk, i) != F.get(tk, i + 1)))
        return let(ends, lambda at: F.transform(
            at, lambda i, n: F.struct(F.get(tk, i).alias("term"), (i - F.coalesce(F.get(at, n - 1), F.lit(-1))).cast("bigint").alias("tf"))))

    return let(F.sort_array(column), runs)


def index_stats(postings: DataFrame, part: str | None) -> tuple[DataFrame, DataFrame]:
    """Per part (or for the whole corpus): document count and mean length; per term: document frequency and idf."""
    keys = _keys(part)
    totals = cut_lineage(postings.filter("term is null").groupBy(*keys).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))
    df = cut_lineage(postings.filter("term is not null").groupBy(*keys, "term").agg(F.count("*").alias("df")))
    return totals, _with_idf(df, totals, part)


def _with_idf(df: DataFrame, totals: DataFrame, part: str | None) -> DataFrame:
    """([part,] term, df, idf); a negative idf becomes EPSILON times the mean idf over all terms, negatives included."""
    keys = _keys(part)
    raw = _with_totals(df, totals, part).withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floors = raw.groupBy(*keys).agg((EPSILON * F.avg("raw_idf")).alias("floor_idf"))
    raw = _with_totals(raw, floors, part)
    idf = F.when(F.col("raw_idf") < 0, F.col("floor_idf")).otherwise(F.col("raw_idf"))
    return raw.select(*keys, "term", "df", idf.alias("idf"))


def corpus_stats(docs: DataFrame, id: str, part: str | None, text: str) -> tuple[DataFrame, DataFrame]:
    """``index_stats`` of documents that are not searched, so no postings are stored.

    One pass over the texts: every document adds its distinct terms and one row without a term that carries its
    length, so the map side combines both kinds. The result is stored once, as the statistics of an index are.
    """
    keys = _keys(part)
    toks = _tokenised(docs, part, tk=tokens(F.col(text)))
    rows = toks.select(*keys, F.size("tk").cast("bigint").alias("dl"), F.array_append(F.array_distinct("tk"), F.lit(None)).alias("tk"))
    rows = rows.select(*keys, "dl", F.explode_outer("tk").alias("term"))
    stats = cut_lineage(rows.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("dl").alias("len")))
    totals = stats.filter("term is null").select(*keys, F.col("df").alias("n_docs"), (F.col("len") / F.col("df")).alias("avgdl"))
    return totals, _with_idf(stats.filter("term is not null").select(*keys, "term", "df"), totals, part)


def _with_totals(df: DataFrame, totals: DataFrame, part: str | None) -> DataFrame:
    """Columns of a one-row-per-part table beside each row; for the whole corpus they are scalars."""
    if part:
        return df.join(small(totals), "part")  # a part may hold most rows
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})


POSTING_BLOCK = 1 << 19  # postings in one unit
CELLS = 1 << 22  # numbers that one matrix of a unit holds


def _classes(queries: DataFrame, part: str | None, qid: str, qtext: str) -> tuple[DataFrame, DataFrame]:
    """Queries with the same texts ask for the same: classes ([part,] c, texts) and their members ([part,] c, qid)."""
    keys = _keys(part)
    asked = _tokenised(queries, part, qid=F.col(qid), qtext=F.col(qtext))
    asked = cut_lineage(asked.groupBy(*keys, "qid").agg(F.sort_array(F.collect_list("qtext")).alias("texts")))
    classes = cut_lineage(asked.select(*keys, "texts").distinct().withColumn("c", F.monotonically_increasing_id()))
    return classes, asked.join(classes, [*keys, "texts"]).select(*keys, "c", "qid")


def _times(classes: DataFrame, part: str | None, terms: Callable[[Column], Column]) -> DataFrame:
    """([part,] c, term, times) of the terms of the classes."""
    keys = _keys(part)
    one = classes.select(*keys, "c", F.explode("texts").alias("text")).select(*keys, "c", F.explode(terms(F.col("text"))).alias("term"))
    return one.groupBy(*keys, "c", "term").agg(F.count("*").alias("times"))


def _products(
    weights: DataFrame, postings: DataFrame, gain: Column, part: str | None, k: int | None, factors: tuple[str, ...] = (),
    lengths: DataFrame | None = None, groups: DataFrame | None = None,
) -> DataFrame:
    """([part,] c, id, score): sum over the shared terms of the class's weight times the ``gain`` of the posting, rounded.

    ``weights``: [part,] c, term, weight and ``factors`` of the term, which ``gain`` may use. Postings of other terms are dropped before anything moves. The
    others meet the classes in the units of a grid, a document's postings in one unit, where the rows of a matrix of terms and classes are summed. With ``k`` a unit
    hands on its k best per class, or per class and group; products of zero are left out. ``lengths`` (id, len) divides by both lengths; ``groups`` (id, grp)
    names the groups of an id.
    """
    keys = _keys(part)
    own = (F.col("part") if part else F.lit("")).cast("string").alias("part")
    weights = cut_lineage(weights)
    numbered = cut_lineage(weights.select(*keys, "term", *factors).distinct().withColumn("t", F.monotonically_increasing_id()))
    vectors = weights.join(small(numbered), [*keys, "term"]).groupBy(own, "c").agg(F.sort_array(F.collect_list(F.struct("t", "weight"))).alias("v"))
    vectors = cut_lineage(vectors.select("part", "c", F.col("v.t").alias("ts"), F.col("v.weight").alias("ws")))
    none = lambda kind: F.lit(None).cast(kind)
    met = postings.join(small(numbered), [*keys, "term"])
    rows = met.select(own, "id", "t", gain.alias("gain"), none("string").alias("grp"))
    if lengths is not None:
        rows = rows.unionByName(lengths.select(F.lit("").alias("part"), "id", none("bigint").alias("t"), F.col("len").alias("gain"), none("string").alias("grp")))
    if groups is not None:
        rows = rows.unionByName(groups.select(F.lit("").alias("part"), "id", F.lit(-1).cast("bigint").alias("t"), none("double").alias("gain"), F.col("grp").cast("string")))
    id_type = rows.schema["id"].dataType.simpleString()
    found = in_units(
        *grid(vectors, rows, ["c"], ["id"], POSTING_BLOCK), _unit(k, lengths is not None, groups is not None), f"part string, c bigint, id {id_type}, grp string, score double")
    if k is not None:
        best = [F.col("score").desc(), F.col("id").asc()]
        if groups is None:
            found = topk(found, ["part", "c"], best, k, "__r")
        else:
            found = cut_lineage(found)
            above = topk(found.filter("score >= 0"), ["part", "c", "grp"], best, k, "__r").drop("__r")
            found = above.unionByName(found.filter("score < 0")).drop("grp").distinct()
        found = cut_lineage(found)
    back = [F.col("part").cast(postings.schema["part"].dataType)] if part else []
    return found.select(*back, "c", "id", "score")


def _unit(k: int | None, divided: bool, grouped: bool):
    """The products of one unit of ``_products``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["part", "c", "id", "grp", "score"]
        t = right["t"].to_numpy().astype(float)  # NaN: the length of a document; -1: a group of it
        is_term = t >= 0
        schema = pa.schema([("part", pa.string()), ("c", pa.int64()), ("id", right.schema.field("id").type), ("grp", pa.string()), ("score", pa.float64())])
        if not left.num_rows or not is_term.any():
            return schema.empty_table()
        coded = right["id"].combine_chunks().dictionary_encode(null_encoding="encode")
        every, ids = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        at = np.empty(len(ids), np.int64)
        at[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))  # place of an id in their order
        gain = right["gain"].to_numpy()
        order = np.flatnonzero(is_term)[np.argsort(every[is_term], kind="stable")]
        doc, first = np.unique(every[order], return_index=True)
        terms, column = np.unique(t[order].astype(np.int64), return_inverse=True)
        gain_of, bounds = gain[order][:, None], np.append(first, len(order))
        length = None
        if divided:
            length = np.full(len(ids), np.nan)
            length[every[np.isnan(t)]] = gain[np.isnan(t)]
        members = [(None, np.arange(len(doc)))]
        if grouped:
            pairs: dict = {}
            for i, g in zip(every[t == -1], right["grp"].filter(pa.array(t == -1)).to_pylist()):
                pairs.setdefault(g, set()).add(i)
            members = [(g, np.flatnonzero(np.isin(doc, list(m)))) for g, m in pairs.items()]
        queries = left["c"].to_numpy()
        counts = pc.list_value_length(left["ts"]).to_numpy().astype(np.int64)
        starts = np.append(0, np.cumsum(counts))
        ts, ws = left["ts"].combine_chunks().flatten().to_numpy(), left["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        step = max(1, CELLS // max(len(terms), len(doc)))
        out = []
        for q in range(0, len(queries), step):
            n = min(step, len(queries) - q)
            mine = slice(starts[q], starts[q + n])
            asked, row = ts[mine], np.repeat(np.arange(n), counts[q:q + n])
            place = np.searchsorted(terms, asked).clip(max=len(terms) - 1)
            there = terms[place] == asked
            weight = np.zeros((len(terms), n))
            weight[place[there], row[there]] = ws[mine][there]
            shared = np.zeros((len(terms), n), bool)
            shared[place[there], row[there]] = True
            score, hit = np.empty((len(doc), n)), None if k is not None else np.empty((len(doc), n), bool)
            take = max(1, CELLS // n)  # postings at once
            low = 0
            while low < len(doc):
                high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + take, side="right")) - 1)
                span = slice(bounds[low], bounds[high])
                cuts = bounds[low:high] - bounds[low]
                score[low:high] = np.add.reduceat(weight[column[span]] * gain_of[span], cuts, axis=0)
                if hit is not None:
                    hit[low:high] = np.logical_or.reduceat(shared[column[span]], cuts, axis=0)
                low = high
            if divided:
                size = np.sqrt(np.bincount(row, ws[mine] ** 2, n))
                score = score / (length[doc][:, None] * size[None, :])
            score = np.round(score, 6) + 0.0
            for group, rows in members:
                for x in range(n):
                    s = score[rows, x]
                    good = np.flatnonzero(hit[rows, x] if k is None else s != 0)
                    if k is not None and len(good) > k:
                        below = good[s[good] < 0] if grouped else good[:0]
                        cut = np.partition(s[good], len(good) - k)[len(good) - k]
                        near = good[s[good] >= cut]
                        near = near[np.lexsort((at[doc[rows[near]]], -s[near]))][:k]
                        good = np.union1d(near, below)
                    if len(good):
                        out.append((np.full(len(good), queries[q + x]), doc[rows[good]], s[good], group))
        if not out:
            return schema.empty_table()
        flat = lambda i: np.concatenate([o[i] for o in out])
        total = sum(len(o[0]) for o in out)
        groups = pa.array([o[3] for o in out for _ in o[0]], pa.string()) if grouped else pa.nulls(total, pa.string())
        return pa.table([
            pa.array([left["part"][0].as_py()] * total, pa.string()), pa.array(flat(0)), ids.take(pa.array(flat(1))), groups, pa.array(flat(2))], names=names)

    return run


def bm25_scores(
    queries: DataFrame, qid: str, qtext: str, docs: DataFrame, id: str, text: str, part: str | None = None, k: int | None = None, group: str | None = None
) -> DataFrame:
    """([part,] qid, id, score) of every document sharing a term with a query of the same part.

    The corpus is indexed once; statistics and scoring read the postings (see ``_products``). With ``k`` only the k best of a query leave the scoring, without those at score 0; with ``group`` (a column of docs, for the whole corpus)
    the k best of each group, and all below 0.
    """
    best = _bm25_classes(queries, qid, qtext, docs, id, text, part, k, group)
    return best[1].join(best[0], [*_keys(part), "c"]).select(*_keys(part), "qid", "id", "score")


def _bm25_classes(queries, qid, qtext, docs, id, text, part, k, group=None) -> tuple[DataFrame, DataFrame]:
    keys = _keys(part)
    postings = index(docs, id, part, text)
    totals, idf = index_stats(postings, part)
    classes, members = _classes(queries, part, qid, qtext)
    weights = _times(classes, part, tokens).join(idf, [*keys, "term"]).select(*keys, "c", "term", (F.col("times") * F.col("idf")).alias("weight"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    groups = docs.select(F.col(id).alias("id"), F.col(group).alias("grp")).distinct() if group else None
    posted = _with_totals(postings.filter("term is not null"), totals, part)
    return _products(weights, posted, F.col("tf") * (K1 + 1) / norm, part, k, groups=groups), members


def bm25_topk(
    queries: DataFrame,
    qid: str,
    qtext: str,
    docs: DataFrame,
    id: str,
    text: str,
    part: str | None,
    k: int,
    keep_zero: bool = True,
) -> DataFrame:
    """Best k documents per query. With ``keep_zero`` a query with fewer matches is filled up with the
    smallest ids that share no term, at score 0, as a full score vector would give them."""
    keys = _keys(part)
    scores = cut_lineage(bm25_scores(queries, qid, qtext, docs, id, text, part, k))
    best = [F.col("score").desc(), F.col("id").asc()]
    if not keep_zero:
        return topk(scores.filter(F.col("score") > 0), [*keys, "qid"], best, k, "bm25_rank")
    held = topk(scores, [*keys, "qid"], best, k, "__r").drop("__r")
    # A query short of k matches leaves at most k - 1 of the 2k smallest ids taken, so k others are among them.
    # Where a document is both held and filler, the sum keeps its own score.
    ids = _tokenised(docs, part, id=F.col(id))
    asked = _tokenised(queries, part, qid=F.col(qid)).distinct()
    if part:
        filler = asked.join(topk(ids, keys, [F.col("id")], 2 * k, "__r"), "part")
    else:
        first = ids.orderBy("id").limit(2 * k).agg(F.collect_list("id").alias("ids")).scalar()
        filler = asked.select("qid", F.explode(first).alias("id"))
    both = held.unionByName(filler.select(*keys, "qid", "id", F.lit(0.0).alias("score")))
    whole = both.groupBy(*keys, "qid", "id").agg(F.sum("score").alias("score"))
    return cut_lineage(topk(whole, [*keys, "qid"], best, k, "bm25_rank"))


def word_terms(text: Column) -> Column:
    """Lower-case words of two or more characters without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def gram_terms(low: int = 2, high: int = 4) -> Callable[[Column], Column]:
    """Analyser for character pieces of low..high characters over single-spaced lower-case text."""
    from .chunking import char_ngrams

    def terms(text: Column) -> Column:
        plain = F.regexp_replace(F.lower(text), r"\s+", " ")
        return char_ngrams(plain, low, high)

    return terms


def tfidf_scores(
    queries: DataFrame, qid: str, qtext: str, docs: DataFrame, id: str, text: str, terms: Callable[[Column], Column] = word_terms,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Cosine of sublinear tf times smoothed idf, for every document sharing a term with a query.

    The corpus is indexed once; document frequencies, lengths and the products with the queries are read from the postings. ``statistics`` (the same text column) gives the frequencies where they are those of another corpus;
    terms that it lacks count for nothing.
    """
    scores, members = _tfidf_classes(queries, qid, qtext, docs, id, text, terms, statistics)
    return members.join(scores, "c").select("qid", "id", "score")


def _tfidf_classes(queries, qid, qtext, docs, id, text, terms, statistics=None, k=None) -> tuple[DataFrame, DataFrame]:
    postings = index(docs, id, None, text, terms)
    tf = postings.filter("term is not null")
    if statistics is None:
        held = postings
    else:
        held = index(statistics.withColumn("id", F.monotonically_increasing_id()), "id", None, "text", terms)
    n = held.filter("term is null").agg(F.count("*").alias("n")).scalar()
    df = held.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    idf = cut_lineage(df.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    weighted = tf.join(small(idf), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    classes, members = _classes(queries, None, qid, qtext)
    weights = _times(classes, None, terms).join(idf, "term").select("c", "term", ((1 + F.log("times")) * F.col("idf")).alias("weight"), "idf")
    named = tf.filter("id is not null")
    return _products(weights, named, (1 + F.log("tf")) * F.col("idf"), None, k, ("idf",), length), members.filter("qid is not null")


def tfidf_topk(queries, qid, qtext, docs, id, text, k, terms=word_terms) -> DataFrame:
    scores, members = _tfidf_classes(queries, qid, qtext, docs, id, text, terms, k=k)
    best = topk(scores, ["c"], [F.col("score").desc(), F.col("id").asc()], k)
    return members.join(cut_lineage(best), "c").select("qid", "id", "score", "rank")
