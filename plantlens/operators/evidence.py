"""Evidence for a question about a fault: scores raised by rules, and the excerpt of each passage that carries the evidence.

``scored`` holds a row for each passage (or each question and passage): text and score; kind ("table" or "passage"), label and grid (the
cells of a table by row, merged cells repeated) where a rule reads them. Every rule is an expression over its own row, so nothing
is shuffled. Each returns the rows with score, excerpt and, for instructions, evidence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import term_pattern
from .lexical import tfidf_scores, word_terms

# Lengths of excerpts and windows in characters.
EXCERPT, LONG_EXCERPT, BEFORE, BEFORE_TERM, NEAR, NEAR_ALARM = 1100, 1400, 160, 200, 100, 120


class Wording(NamedTuple):
    """The words by which manuals mark steps, checks, warnings and emergencies (regular expressions)."""

    steps: str = r"순서|절차|step"
    check: str = r"반드시|확인한\s*후|확인하신\s*후|확인하고|before proceeding|make sure"
    operate: str = r"(?:해제|복귀|조작)할\s*때(?:는|에).*(?:버튼|스위치)"
    caution: str = r"주의|확인|해제|준비|반드시|caution|check|release"
    section: str = r"[①-⑳]"
    condition: str = (
        r"의심스러운 상황|긴급.{0,12}(?:정지|멈)|비상정지.{0,22}(?:누르|눌러)|(?:이상|비정상).{0,12}(?:상황|발생|발견)|"
        r"abnormal(?:ity|ities| condition)|in an emergency"
    )
    action: str = (
        r"가동.{0,4}중지|기계.{0,8}(?:정지|멈)|관리 책임자|주축.{0,12}정지|"
        r"stop the machine|stop operation|press (?:the )?emergency stop"
    )


WORDING = Wording()


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _place(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    return F.when(_has(text, pattern), F.length(F.regexp_extract(text, f"(?is)^(.*?)(?:{pattern})", 1)))


def _matches(text: Column, pattern: str, flags: str = "is") -> Column:
    """(at, size) of every match; few are expected, each costs a pass over those before it."""
    split = f"(?{flags})(.*?)({pattern})"
    parts = F.struct(F.regexp_extract_all(text, F.lit(split), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(split), F.lit(2)).alias("hit"))

    def places(p: Column) -> Column:
        before = lambda k, n: F.length(F.array_join(F.slice(p[k], F.lit(1), n), ""))
        one = lambda hit, i: F.struct((before("gap", i + 1) + before("hit", i)).alias("at"), F.length(hit).alias("size"))
        return F.transform(p["hit"], one)

    return _bound(parts, places)


def _cut(text: Column, begin: Column, size) -> Column:
    return F.substring(text, begin + 1, size if isinstance(size, Column) else F.lit(size))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _from(at: Column, before: int) -> Column:
    return F.greatest(at - before, F.lit(0))


def boost_code(scored: DataFrame, code: str, needs_alarm_word: bool = False) -> DataFrame:
    """+1 where the alarm code stands alone (its first mention beside the word alarm, when asked for), else 0.

    The excerpt is the table's lines with the code, or the text around the first mention.
    """
    alone = rf"(?<![#a-z0-9])\Q{code}\E(?![a-z0-9])"
    text = F.col("text")
    at = _place(text, alone)
    around = _cut(text, _from(at, NEAR_ALARM), at + len(code) + NEAR_ALARM - _from(at, NEAR_ALARM))
    hit = at.isNotNull() & _has(around, r"(?:alarm|\bALM\b)") if needs_alarm_word else at.isNotNull()
    table = F.substring(F.array_join(F.filter(_lines(text), lambda line: _has(line, alone)), "\n"), 1, EXCERPT)
    excerpt = F.when(F.coalesce(F.col("kind") == "table", F.lit(False)), table).otherwise(_cut(text, _from(at, BEFORE), EXCERPT))
    hit = F.coalesce(hit, F.lit(False))
    return scored.withColumns({"score": F.when(hit, F.col("score") + 1).otherwise(0.0), "excerpt": F.when(hit, excerpt)})


def boost_terms(scored: DataFrame, target: Sequence[str], state: Sequence[str] = (), wording: Wording = WORDING) -> DataFrame:
    """+1 where the target occurs, +1 more where the state stands within a line window of one of its mentions; else 0.

    The excerpt begins near the mention and ends with the numbered section of the page that it stands in. Without a target the state is
    looked for alone.
    """
    t, s = term_pattern(target), term_pattern(state)
    text = F.col("text")

    def beside(line: Column) -> Column:
        """First mention in the line whose window holds the state."""
        window = lambda m: _cut(line, _from(m["at"], NEAR), m["at"] + m["size"] + NEAR - _from(m["at"], NEAR))
        found = F.filter(_matches(line, t), lambda m: _has(window(m), f"(?:{s})"))
        return F.when(_has(line, f"(?:{t})") & _has(line, f"(?:{s})"), F.get(found, F.lit(0))["at"])

    def first_beside(lines: Column) -> Column:
        def place(found: Column) -> Column:
            n = F.get(F.filter(F.transform(found, lambda at, i: F.when(at.isNotNull(), i)), lambda i: i.isNotNull()), F.lit(0))
            before = F.when(n == 0, 0).otherwise(F.length(F.array_join(F.slice(lines, F.lit(1), n), "\n")) + 1)
            return F.when(n.isNotNull(), before + F.get(found, n))

        return _bound(F.transform(lines, beside), place)

    first = _place(text, t or s)
    near = _bound(_lines(text), first_beside) if t and s else F.lit(None).cast("int")
    marked = scored.withColumns({"__near": near, "__at": F.coalesce(near, first)})
    at = F.col("__at")
    borders = F.when(_has(text, wording.section), F.transform(_matches(text, rf"^\s*{wording.section}", "dms"), lambda m: m["at"]))
    marked = marked.withColumn("__b", F.coalesce(borders, F.array().cast("array<int>")))
    before = F.coalesce(F.array_max(F.filter("__b", lambda b: b <= at)), F.lit(0))
    end = F.coalesce(F.array_min(F.filter("__b", lambda b: b > at)), F.length(text))
    begin = F.greatest(at - BEFORE_TERM, before, F.lit(0))
    hit = at.isNotNull()
    raised = F.col("score") + 1 + F.when(F.col("__near").isNotNull(), 1).otherwise(0)
    return marked.withColumns({
        "score": F.when(hit, raised).otherwise(0.0), "excerpt": F.when(hit, _cut(text, begin, F.least(F.lit(EXCERPT), end - begin)))
    }).drop("__near", "__at", "__b")


def _column_under(grid: Column, target: str) -> Column:
    """The lines of a comparison table's column that one of its three first rows heads with the target: label | value."""
    whole = rf"^(?:{target})$"

    def heads(row: Column, i: Column) -> Column:
        cells = F.transform(row, lambda cell, j: F.when((j > 0) & _has(F.trim(cell), whole), F.struct(i.alias("row"), j.alias("col"))))
        return F.filter(cells, lambda c: c.isNotNull())

    def column(head: Column) -> Column:
        row = F.get(grid, head["row"])
        differs = F.filter(F.transform(row, lambda cell, j: F.when(cell != F.get(row, F.lit(0)), j)), lambda j: j.isNotNull())
        labels = F.coalesce(F.get(differs, F.lit(0)), head["col"])
        below = F.slice(grid, head["row"] + 2, F.size(grid))
        line = lambda cells: F.concat(F.array_join(F.array_distinct(F.slice(cells, F.lit(1), labels)), " · "), F.lit(" | "), F.get(cells, head["col"]))
        return F.array_join(F.concat(F.array(F.get(row, head["col"])), F.transform(below, line)), "\n")

    rows = F.flatten(F.transform(F.slice(grid, 1, 3), heads))
    with_rows = F.filter(rows, lambda h: h["row"] + 1 < F.size(grid))
    return F.when(F.size(with_rows) > 0, _bound(F.get(with_rows, F.lit(0)), column))


def _message_rows(lines: Column, message: Column) -> Column:
    """The numbered row of a message table that names the message, up to the next numbered row."""
    numbered = F.transform(lines, lambda line, i: F.when(line.rlike(r"^\s*\d+\s*\|"), i))

    def cut(found: Column) -> Column:
        heads = F.filter(found, lambda i: i.isNotNull())
        mine = F.get(F.filter(heads, lambda i: F.contains(F.lower(F.get(lines, i)), F.lower(message))), F.lit(0))
        end = F.coalesce(F.array_min(F.filter(heads, lambda i: i > mine)), F.size(lines))
        return F.when(mine.isNotNull(), F.array_join(F.slice(lines, mine + 1, end - mine), "\n"))

    return _bound(numbered, cut)


def boost_action(scored: DataFrame, target: Sequence[str], wording: Wording = WORDING) -> DataFrame:
    """Raise passages that say what to do about the target of the row's ``question``; rows without target or message keep their score.

    +4 for the question's message (its first run of three or more words), then +2 for a sentence on operating the target, a
    comparison column, a procedure that begins with the target or a line that asks for a check, else +0.18 for words of caution. Lines of a table of contents
    score 0. ``evidence`` names what was found.
    """
    t = term_pattern(target)
    text, label, question = F.col("text"), F.coalesce("label", F.lit("")), F.coalesce("question", F.lit(""))
    grid = F.coalesce("grid", F.array().cast("array<array<string>>"))
    table = F.size(grid) > 0
    message = F.regexp_extract(question, r"\b[A-Za-z]+(?:[ \t]+[A-Za-z]+){2,}\b", 0)
    spaced = F.concat(F.lit(r"(?is)^(.*?)"), F.regexp_replace(message, r"[ \t]+", r"\\s+"))
    named = (message != "") & F.regexp_like(text, spaced)
    at = F.coalesce(F.when(named, F.length(F.call_function("regexp_extract", text, spaced, F.lit(1)))), _place(text, t))
    d = scored.withColumns({"__message": message, "__named": F.coalesce(named, F.lit(False)), "__at": at})
    at, named, message = F.col("__at"), F.col("__named"), F.col("__message")

    steps = table & _has(F.get(_lines(text), F.lit(0)), f"(?:{wording.steps})")
    section = F.regexp_replace(label, r"^[\d.()\s]+", "")
    begins = lambda c: _has(c, rf"^(?:{t})")
    procedure = steps & (begins(section) | F.exists(F.slice(grid, 2, 2), lambda row: (F.size(row) > 1) & F.coalesce(begins(F.trim(F.get(row, F.lit(1)))), F.lit(False))))
    both = lambda c, words: _has(c, f"(?:{t})") & _has(c, f"(?:{words})")
    line = F.get(F.filter(_lines(text), lambda x: both(x, wording.check)), F.lit(0))
    sentence = F.get(F.filter(F.split(text, r"(?<=[.!?])\s+|\n"), lambda x: both(x, wording.operate)), F.lit(0))
    d = d.withColumns({
        "__column": F.when(table, _column_under(grid, t)), "__steps": F.coalesce(steps, F.lit(False)), "__procedure": F.coalesce(procedure, F.lit(False)),
        "__line": F.when(~table, line), "__sentence": F.when(~table, sentence),
    })
    column, steps, procedure, line, sentence = (F.col(c) for c in ("__column", "__steps", "__procedure", "__line", "__sentence"))
    around = F.when(steps, F.substring(text, 1, LONG_EXCERPT)).otherwise(_cut(text, _from(at, BEFORE), LONG_EXCERPT))
    d = d.withColumn("__text", F.coalesce(column, F.when(procedure, text), around))
    contents = column.isNull() & ~steps & F.col("__text").rlike(r"\.{3,}\s*\d+")
    found = at.isNotNull()
    rows = F.when(named & table, _message_rows(_lines(text), message))
    plus = F.when(named, 4.0).otherwise(0.0) + F.when(sentence.isNotNull() | column.isNotNull() | procedure | line.isNotNull(), 2.0).when(
        _has(F.col("__text"), f"(?:{wording.caution})"), 0.18).otherwise(0.0)
    kind = (
        F.when(sentence.isNotNull(), "operation_detail").when(column.isNotNull(), "comparison").when(procedure, "steps")
        .when(line.isNotNull(), "precaution").when(rows.isNotNull(), "message")
    )
    excerpt = F.coalesce(
        sentence, F.when(line.isNotNull(), F.concat(section, F.lit("\n"), line)), rows, F.concat(label, F.lit("\n"), F.col("__text")))
    held = d.columns
    return d.withColumns({
        "evidence": F.when(found & ~contents, kind), "excerpt": F.when(found & ~contents, excerpt),
        "score": F.when(~found, F.col("score")).when(contents, 0.0).otherwise(F.col("score") + plus),
    }).drop(*[c for c in held if c.startswith("__")])


def conditional_instructions(text: Column, wording: Wording = WORDING) -> Column:
    """Lines that name an emergency and what to do, each with the next line when it ends inside a sentence; null without one."""

    def instructions(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            after = F.get(lines, i + 1)
            open_ended = after.isNotNull() & ~line.rlike(r"[.!?。]\s*$")
            whole = F.when(open_ended, F.concat(line, F.lit(" "), after)).otherwise(line)
            return F.when(_has(line, f"(?:{wording.condition})") & _has(line, f"(?:{wording.action})"), whole)

        return F.filter(F.transform(lines, one), lambda x: x.isNotNull())

    return _bound(_lines(text), lambda lines: _bound(instructions(lines), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n"))))


def general_incident(
    passages: DataFrame, queries: DataFrame, key: str = "id", wording: Wording = WORDING, terms: Callable[[Column], Column] = word_terms
) -> DataFrame:
    """(qid, key, score, excerpt): conditional operating instructions by TF-IDF likeness to a general query; other passages have none.

    ``passages``: key, text, kind; only the kind "passage" counts. ``queries``: qid, qtext. Term statistics are those of all passages.
    """
    blocks = passages.where("kind = 'passage'").select(key, conditional_instructions(F.col("text"), wording).alias("block")).where("block is not null")
    scores = tfidf_scores(queries, "qid", "qtext", blocks, key, "block", terms, statistics=passages.select("text"))
    excerpts = blocks.select(F.col(key).alias("id"), F.substring("block", 1, EXCERPT).alias("excerpt"))
    return scores.join(excerpts, "id").select("qid", F.col("id").alias(key), "score", "excerpt")
