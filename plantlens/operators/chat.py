"""Conversation tables: turns, context windows, answers, search, questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_key
from .intervals import previous_user_message
from .ordered import carry_last, first_per_key, global_positions, neighbour, topk

TURN_BUCKET = 512


def _bucket(order: str) -> Column:
    return F.floor(F.col(order) / TURN_BUCKET)


def completed_turns(messages: DataFrame) -> DataFrame:
    """Adjacent question and answer pairs; empty, failed and unfinished answers drop out.

    ``messages``: session, pos, role, text, status (null means completed), failed.
    """
    answer = {"a_role": F.col("role"), "a_pos": F.col("pos"), "answer": F.col("text"), "a_status": F.col("status"), "a_failed": F.col("failed")}
    d = neighbour(messages, ["session"], ["pos"], _bucket("pos"), answer, step=1)
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    good = (
        (F.col("role") == "user") & (F.col("a_role") == "assistant") & full("text") & full("answer")
        & (F.coalesce("a_status", F.lit("completed")) == "completed") & ~F.coalesce("a_failed", F.lit(False))
    )
    return d.filter(good).select("session", "pos", F.col("text").alias("question"), "a_pos", "answer")


def last_slots(messages: DataFrame, k: int, summary_prefix: str = "[SUMMARY]") -> DataFrame:
    """Messages of the last k slots per session: a summary, a question with its answer, or a lone message is one slot.

    Only the k latest slot starts of a session are needed to find where its window begins.
    """
    order, bucket = ["pos"], _bucket("pos")
    is_summary = F.col("text").startswith(summary_prefix)
    d = messages.withColumn("__sum", is_summary)
    d = neighbour(d, ["session"], order, bucket, {"__p_role": F.col("role"), "__p_sum": F.col("__sum")})
    # an answer right after a plain question belongs to the question's slot
    joined = (F.col("role") == "assistant") & ~F.col("__sum") & (F.col("__p_role") == "user") & ~F.col("__p_sum")
    starts = d.filter(~F.coalesce(joined, F.lit(False))).select("session", "pos")
    first = topk(starts, ["session"], [F.col("pos").desc()], k, "__r").groupBy("session").agg(F.min("pos").alias("__from"))
    return messages.join(first, "session").filter(F.col("pos") >= F.col("__from")).drop("__from")


def session_list(sessions: DataFrame, prompts: DataFrame, machines: DataFrame, factory: str, machine: str) -> DataFrame:
    """Sessions of a factory (and machine unless ALL) with prompt and machine names.

    ``sessions``: session, factory, machine_code, prompt_no, updated_at, pinned, ...; ``prompts``: prompt_no, prompt_name;
    ``machines``: machine_code, machine_name.
    """
    own = sessions.filter(F.col("factory") == factory)
    own = own if machine == "ALL" else own.filter(F.col("machine_code") == machine)
    return own.join(prompts, "prompt_no", "left").join(machines, "machine_code", "left")


def answer_list(messages: DataFrame, feedback: DataFrame | None = None, value=None, preview: int = 300) -> DataFrame:
    """Answers with their question and the start of both texts; optionally only those with a feedback value.

    ``messages``: session, pos, role, text; ``feedback``: session, pos, feedback, reason.
    """
    d = previous_user_message(messages, "session", "pos", "role", "text")
    if feedback is not None:
        d = d.join(feedback, ["session", "pos"], "left")
        if value is not None:
            d = d.filter(F.col("feedback") == F.lit(value))
    return d.withColumn("question_preview", F.substring("question", 1, preview)).withColumn("answer_preview", F.substring("text", 1, preview))


def latest_reason(answers: DataFrame) -> DataFrame:
    """The newest non-empty reason of each session among the given answers."""
    reason = F.trim("reason")
    return answers.groupBy("session").agg(F.max_by(reason, F.when(F.coalesce(reason, F.lit("")) != "", F.col("pos"))).alias("reason"))


def history_search(sessions: DataFrame, answers: DataFrame, mode: str, text: str = "") -> DataFrame:
    """Sessions that hold a matching answer (with its latest reason), or the answers themselves; the text must occur
    in the title or the questioner's name."""
    hit = F.lower("title").contains(text.lower()) | F.lower(F.coalesce("questioner", F.lit(""))).contains(text.lower())
    found = sessions.filter(hit)
    if mode == "sessions":
        return found.join(answers.select("session").distinct(), "session", "left_semi").join(latest_reason(answers), "session", "left")
    return answers.join(found.select("session", "title", "questioner"), "session")


def questioner_name() -> Column:
    """Name as shown: trimmed, a dash when there is none."""
    return F.coalesce(F.when(F.trim("questioner") != "", F.trim("questioner")), F.lit("-"))


def questioner_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(questioner_name().alias("questioner")).agg(F.count("*").alias("n_sessions"))


def questioner_sessions(sessions: DataFrame, questioner: str, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of the sessions of one questioner, clamped to the pages that exist; a blank name asks for those without one."""
    return page_of(sessions.filter(questioner_name() == (questioner.strip() or "-")), order, page, size)


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered list with the page actually shown, the total and the number of pages.

    The page number is clamped to the existing pages. A page is cut out of the globally sorted positions, so the rows
    before it never meet in one task.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    shown = min(max(page, 1), pages)
    first = (shown - 1) * size
    at = F.col("__position")
    rows = global_positions(df, order, "__position").filter((at > first) & (at <= first + size)).drop("__position")
    return (
        rows.withColumn("page", F.lit(shown))
        .withColumn("total", F.lit(total).cast("bigint"))
        .withColumn("pages", F.lit(pages))
    )


def recent_plus(messages: DataFrame, selected: DataFrame, k: int = 20) -> DataFrame:
    """Last k messages of each session plus the selected ones. ``selected``: session, pos."""
    recent = topk(messages, ["session"], [F.col("pos").desc()], k, "__r").drop("__r")
    chosen = messages.join(selected, ["session", "pos"], "left_semi")
    return recent.unionByName(chosen).distinct()


def used_chunks(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks an answer really cites, labelled by first mention, one per asset path.

    ``cited``: session, pos, chunk_index, label; ``chunks``: session, pos, chunk_index, asset_path.
    """
    keys = ["session", "pos"]
    held = cited.join(chunks, [*keys, "chunk_index"])
    per_asset = F.coalesce(F.when(F.col("asset_path") != "", F.col("asset_path")), F.concat(F.lit("chunk:"), F.col("chunk_index").cast("string")))
    return first_per_key(held.withColumn("__a", per_asset), [*keys, "__a"], [F.col("label")]).drop("__a")


def answer_status(answers: DataFrame) -> DataFrame:
    """Latency, status and whether a retry makes sense. ``answers``: started_ms, finished_ms, status, text."""
    elapsed = F.col("finished_ms") - F.col("started_ms")
    status = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "failed").otherwise(F.coalesce("status", F.lit("completed")))
    return answers.withColumn("elapsed_ms", elapsed).withColumn("answer_status", status).withColumn("retry", F.col("answer_status") != "completed")


def answer_figures(messages: DataFrame, metadata: str) -> DataFrame:
    """Figures an answer may show: the asset of a picture chunk, its related pictures, scanned page images, listed images.

    The JSON metadata is read as VARIANT, so chunks of different shape can share a column.
    """
    at = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    meta = messages.withColumn("__m", F.try_parse_json(F.col(metadata)))
    chunk_list = F.coalesce(at(F.col("__m"), "$.chunks", "array<variant>"), at(F.col("__m"), "$.used_chunks", "array<variant>"))
    chunks = meta.select("session", "pos", F.explode(chunk_list).alias("c"))
    asset = F.when(at(F.col("c"), "$.metadata.container_type") == "pictures", at(F.col("c"), "$.metadata.asset_path"))
    related = F.transform(
        F.coalesce(at(F.col("c"), "$.metadata.related_assets", "array<variant>"), F.array().cast("array<variant>")),
        lambda r: F.when(at(r, "$.container_type") == "pictures", at(r, "$.asset_path")),
    )
    scanned = F.when(at(F.col("c"), "$.metadata.source_kind") == "paddleocr", at(F.col("c"), "$.metadata.page_image_paths", "array<string>"))
    empty = F.array().cast("array<string>")
    paths = F.array_compact(F.concat(F.array(asset), related, F.coalesce(scanned, empty)))
    listed = at(F.col("__m"), "$.images", "array<string>")
    return (
        chunks.select("session", "pos", F.explode(paths).alias("path"))
        .unionByName(meta.select("session", "pos", F.explode(listed).alias("path")))
        .distinct()
    )


def filter_questions(candidates: DataFrame, asked: DataFrame, sources: DataFrame, limit: int = 3, longest: int = 200) -> DataFrame:
    """Recommended questions: distinct, not asked before, short enough, with a known source; first ``limit`` per session.

    ``candidates``: session, pos, text, source; ``asked``: session, text; ``sources``: session, source.
    """
    keyed = candidates.withColumn("key", content_key(F.col("text"))).filter((F.col("key") != "") & (F.length(F.trim("text")) <= longest))
    known = keyed.join(sources.distinct(), ["session", "source"], "left_semi")
    fresh = known.join(asked.select("session", content_key(F.col("text")).alias("key")).distinct(), ["session", "key"], "left_anti")
    return topk(first_per_key(fresh, ["session", "key"], [F.col("pos")]), ["session"], [F.col("pos")], limit, "question_no")


def collapse_progress(log: DataFrame) -> DataFrame:
    """Runs of equal consecutive messages reduced to their last entry. ``log``: job, pos, message."""
    d = neighbour(log, ["job"], ["pos"], _bucket("pos"), {"__next": F.col("message")}, step=1)
    return d.filter(~F.col("message").eqNullSafe(F.col("__next"))).drop("__next")


def run_bounds(log: DataFrame) -> DataFrame:
    """Start of the run each kept entry ends. ``log``: job, pos, message."""
    d = neighbour(log, ["job"], ["pos"], _bucket("pos"), {"__prev": F.col("message")})
    first = F.when(~F.col("message").eqNullSafe(F.col("__prev")), F.col("pos"))
    d = carry_last(d.withColumn("__f", first), ["job"], ["pos"], _bucket("pos"), {"run_start": F.col("__f")})
    return collapse_progress(d.drop("__f", "__prev"))
