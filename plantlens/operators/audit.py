"""Data-quality rules and grounding checks. Each returns the rows that pass or the violations, never a verdict alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapse, identifiers
from ..session import small
from .ordered import carry_last, neighbour, running_sum

# Fixed values
CHECK_WORDS = r"(?i)감지|검출|표시|신호|확인|점검|진단|측정|check|detect|indicat|signal|inspect|diagnos|measure"
DETECTION_WORDS = r"(?i)감지|검출|표시등|indicator|detect"
ALARM_HEADER = r"(?i)alarm|알람|경보"
SIGNAL_LINE = r"^(?:\(\d+\)\s*)?([A-Za-z0-9_.-]+\s*[:：]\s*\S.*)$"
LINE_BUCKET = 4096


def assert_invariants(chunks: DataFrame, catalog: DataFrame, vectors: DataFrame, factories: Sequence[str]) -> DataFrame:
    """Violations of: unique ids, one type per document, registered documents only, as many vectors as chunks,
    declared factories. ``chunks``: id, doc_key, document_type, factory; ``catalog``: doc_key; ``vectors``: id."""
    item = lambda c: c.cast("string").alias("item")
    rule = lambda name: F.lit(name).alias("rule")
    twice = chunks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(rule("unique id"), item(F.col("id")))
    typed = chunks.groupBy("doc_key").agg(F.min("document_type").alias("a"), F.max("document_type").alias("b")).filter("a <> b")
    types = typed.select(rule("one type"), item(F.col("doc_key")))
    unknown = chunks.select("doc_key").distinct().join(catalog, "doc_key", "left_anti").select(rule("registered"), item(F.col("doc_key")))
    bare = chunks.select("id").distinct().join(vectors.select("id"), "id", "left_anti").select(rule("vector"), item(F.col("id")))
    foreign = chunks.filter(~F.col("factory").isin(*factories)).select("factory").distinct().select(rule("factory"), item(F.col("factory")))
    return twice.unionByName(types).unionByName(unknown).unionByName(bare).unionByName(foreign)


def verify_quotes(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each quote occurs in the source it cites, whitespace collapsed.
    ``claims``: claim, source, quote; ``sources``: source, text."""
    quote = collapse(F.col("quote"))
    held = claims.join(sources, "source", "left")
    found = (quote != "") & F.coalesce(collapse(F.col("text")).contains(quote), F.lit(False))
    return held.select("claim", "source", found.alias("verified"))


def table_rows_cited(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The one table row a quote hits; quotes hitting none or several rows give nothing."""
    rows = sources.select("source", F.explode(F.split("text", "\n")).alias("row")).filter(F.col("row").contains("|"))
    hits = claims.join(rows, "source").filter((collapse(F.col("quote")) != "") & collapse(F.col("row")).contains(collapse(F.col("quote"))))
    return hits.groupBy("claim", "source").agg(F.count("*").alias("n"), F.min(F.trim("row")).alias("row")).filter("n = 1").drop("n")


def condition_split(conditions: DataFrame, questions: DataFrame) -> DataFrame:
    """Conditions of a claim with whether the question states them; a claim stands when it states all.
    ``conditions``: qid, claim, label, quote; ``questions``: qid, question."""
    met = (F.trim("quote") != "") & F.col("question").contains(F.col("quote"))
    d = conditions.join(questions, "qid").withColumn("met", met)
    stands = d.groupBy("qid", "claim").agg(F.bool_and("met").alias("claim_stands"))
    return d.join(stands, ["qid", "claim"]).select("qid", "claim", "label", "met", "claim_stands")


def unsupported_ids(claims: DataFrame, support: DataFrame) -> DataFrame:
    """Identifiers of a claim that occur neither in the question nor in the evidence.
    ``claims``: claim, text; ``support``: claim, text (any number of rows)."""
    ids = lambda df: df.select("claim", F.explode(F.transform(identifiers(F.col("text")), lambda w: F.lower(w))).alias("identifier")).distinct()
    return ids(claims).join(ids(support), ["claim", "identifier"], "left_anti")


def citation_audit(paragraphs: DataFrame, sources: DataFrame) -> DataFrame:
    """Violations in a merged answer: paragraphs without citations, numbers out of range, sources never cited.

    ``paragraphs``: answer, para, citations (array of local numbers) and source_no; ``sources``: answer, source_no, n_chunks.
    Local numbers are shifted by the chunk counts of the preceding sources of the answer.
    """
    shifted = running_sum(sources, ["answer"], ["source_no"], F.floor(F.col("source_no") / 1024), F.col("n_chunks"), "__to").withColumn("offset", F.col("__to") - F.col("n_chunks"))
    d = paragraphs.join(shifted.select("answer", "source_no", "offset", "n_chunks"), ["answer", "source_no"], "left")
    cited = d.select("answer", "para", "source_no", "offset", "n_chunks", F.explode("citations").alias("number"))
    bad = cited.filter((F.col("number") < 1) | (F.col("number") > F.coalesce("n_chunks", F.lit(0))))
    empty = d.filter(F.size("citations") == 0).select("answer", F.col("para").cast("string").alias("item"), F.lit("no citation").alias("problem"))
    out = bad.select("answer", (F.coalesce("offset", F.lit(0)) + F.col("number")).cast("string").alias("item"), F.lit("out of range").alias("problem")).distinct()
    used = cited.filter((F.col("number") >= 1) & (F.col("number") <= F.col("n_chunks"))).select("answer", "source_no").distinct()
    silent = sources.filter("n_chunks > 0").join(used, ["answer", "source_no"], "left_anti")
    return empty.unionByName(out).unionByName(silent.select("answer", F.col("source_no").cast("string").alias("item"), F.lit("never cited").alias("problem")))


def group_conditions(quotes: DataFrame) -> DataFrame:
    """Same conditions across sources by compact key: one row per (key, source) with the number of sources and the
    first wording. ``quotes``: source, pos, quote."""
    bare = F.regexp_replace("quote", r"^(\d+[.)]\s+|[√✓]\s*)+", "")
    d = quotes.withColumn("key", F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", "")).filter("key <> ''")
    refs = d.select("key", "source").distinct()
    whole = refs.groupBy("key").agg(F.count("*").alias("n_sources"))
    first = d.groupBy("key").agg(F.min_by(bare, F.struct("source", "pos")).alias("wording"))
    return refs.join(whole, "key").join(first, "key")


def page_gaps(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Missing, doubled and unexpected pages. ``pages``: doc, page; ``expected``: doc, n_pages."""
    want = expected.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_pages").cast("bigint"))).alias("page"))
    counts = pages.groupBy("doc", "page").agg(F.count("*").alias("n"))
    missing = want.join(counts, ["doc", "page"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = counts.join(want, ["doc", "page"], "left_anti").select("doc", "page", F.lit("unexpected").alias("problem"))
    return missing.unionByName(extra).unionByName(counts.filter("n > 1").select("doc", "page", F.lit("twice").alias("problem")))


def step_rows(tables: DataFrame) -> DataFrame:
    """Steps of numbered step tables: rows under a ``순서 | 조작`` header as long as the first cell is a number.
    ``tables``: table, text (lines; the header is the second line)."""
    lines = tables.select("table", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    good = tables.filter(F.get(F.split("text", "\n"), F.lit(1)).startswith("순서 | 조작")).select("table")
    cells = F.split("line", r" \| ")
    d = lines.filter("pos >= 2").join(good, "table", "left_semi").withColumn("c", cells)
    action = F.trim(F.coalesce(F.get("c", F.lit(1)), F.lit("")))
    is_step = F.trim(F.get("c", F.lit(0))).rlike(r"^\d+$") & (action != "")
    broken = d.filter(~is_step).groupBy("table").agg(F.min("pos").alias("__stop"))
    kept = d.join(broken, "table", "left").filter(F.coalesce(F.col("pos") < F.col("__stop"), F.lit(True)))
    return kept.select("table", F.trim(F.get("c", F.lit(0))).cast("int").alias("step_no"), action.alias("action"))


def cause_actions(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """Actions under ``[조치]`` right after the quoted cause, and signals under a following ``[신호]`` when the cause
    stands under ``[원인]``. ``lines``: source, pos, line; ``quotes``: source, quote."""
    keys, order, bucket = ["source"], ["pos"], F.floor(F.col("pos") / LINE_BUCKET)
    text = F.trim("line")
    d = neighbour(lines, keys, order, bucket, {"__before": text})
    head = F.when(text.startswith("["), F.struct(F.col("pos").alias("at"), text.alias("name"), F.col("__before").alias("cause")))
    stop = F.when(text == "", F.col("pos"))
    d = carry_last(d.withColumn("__t", text), keys, order, bucket, {"__h": head, "__blank": stop})
    body = d.filter((F.col("__t") != "") & ~F.col("__t").startswith("[") & (F.coalesce("__blank", F.lit(-1)) < F.col("__h.at")))
    body = body.select("source", "pos", "__t", F.col("__h.at").alias("at"), F.col("__h.name").alias("name"))
    heads = d.filter(F.col("__t").startswith("[")).select("source", F.col("pos").alias("at"), "__t", F.col("__before").alias("cause"))
    action_heads = heads.filter(F.col("__t") == "[조치]").join(quotes, "source").filter(F.col("cause").contains(F.col("quote")) & ~F.col("cause").startswith("["))
    actions = body.filter(F.col("name") == "[조치]").join(action_heads.select("source", "at", "quote"), ["source", "at"])
    out = actions.select("source", "quote", F.lit("action").alias("kind"), "pos", F.col("__t").alias("text"))
    # the signal block belongs to the action block directly before it
    prev = neighbour(heads, keys, ["at"], F.floor(F.col("at") / LINE_BUCKET), {"__p_at": F.col("at"), "__p": F.col("__t")})
    cause_head = carry_last(lines, keys, order, bucket, {"__x": F.when(text == "[원인]", F.col("pos"))}).select("source", F.col("pos").alias("cause_pos"), "__x")
    causes = action_heads.withColumn("cause_pos", F.col("at") - 1).join(cause_head, ["source", "cause_pos"]).filter(F.col("__x") == F.col("cause_pos") - 1)
    signal_heads = prev.filter((F.col("__t") == "[신호]") & (F.col("__p") == "[조치]")).select("source", F.col("at").alias("s_at"), F.col("__p_at").alias("at"))
    wanted = causes.select("source", "at", "quote").join(signal_heads, ["source", "at"]).select("source", "quote", F.col("s_at").alias("at"))
    sig = body.filter(F.col("name") == "[신호]").withColumn("__ok", F.col("__t").rlike(SIGNAL_LINE))
    first_bad = sig.filter("not __ok").groupBy("source", "at").agg(F.min("pos").alias("__stop"))
    sig = sig.join(first_bad, ["source", "at"], "left").filter("__ok and (__stop is null or pos < __stop)").join(wanted, ["source", "at"])
    return out.unionByName(sig.select("source", "quote", F.lit("signal").alias("kind"), "pos", F.regexp_extract("__t", SIGNAL_LINE, 1).alias("text")))


def alarm_rows(tables: DataFrame, codes: DataFrame) -> DataFrame:
    """Table lines with a cell naming an alarm code, reduced to their descriptive cells.
    ``tables``: source, text; ``codes``: source, code."""
    lines = tables.select("source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    d = lines.join(codes, "source").withColumn("cells", F.transform(F.split("line", r"\|"), lambda c: F.trim(c)))
    names = F.regexp_like("line", F.concat(F.lit(r"(?i)(^|[^\w#])"), F.replace(F.col("code"), F.lit("."), F.lit(r"\.")), F.lit(r"($|\W)")))
    words = F.filter("cells", lambda c: (F.length(c) > F.length("code")) & ~c.rlike(r"^[A-Z]?[0-9.]+$"))
    return d.filter(names).select("source", "code", "pos", F.array_join(words, " · ").alias("description")).filter("description <> ''")


def checkable_lines(sources: DataFrame, question: Column) -> DataFrame:
    """Lines that can be checked after a failed remedy; lines about detection alone when there are any.
    Lines of an alarm table count only when they hold a number the question names. ``sources``: qid, source, text and
    the question column."""
    parts = F.split("text", "\n")
    is_table = F.get(parts, F.lit(0)).rlike(ALARM_HEADER) & F.get(parts, F.lit(0)).contains("|")
    d = sources.select("qid", "source", question.alias("q"), is_table.alias("t"), F.posexplode(parts).alias("pos", "line"))
    numbers = F.regexp_extract_all("line", F.lit(r"\b\d{3,}\b"), F.lit(0))
    named = F.exists(numbers, lambda n: F.col("q").contains(n))
    d = d.filter((~F.coalesce("t", F.lit(False)) | named) & F.col("line").rlike(CHECK_WORDS)).withColumn("seen", F.col("line").rlike(DETECTION_WORDS))
    any_seen = d.groupBy("qid").agg(F.max("seen").alias("__any"))
    return d.join(any_seen, "qid").filter("seen or not __any").select("qid", "source", "pos", "line")


def item_lines(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Candidate lines per asked item, numbered across the sources of a question.
    ``sources``: qid, source, text; ``items``: qid, item, pattern (lower case)."""
    from .ordered import number_rows

    d = sources.select("qid", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).join(small(items), "qid")  # a question may hold most lines
    d = d.filter(F.regexp_like(F.lower("line"), F.col("pattern"))).select("qid", "item", "source", "pos", "line")
    return number_rows(d, ["qid", "item"], ["source", "pos"], F.struct(F.col("source"), F.floor(F.col("pos") / LINE_BUCKET)), "line_no")
