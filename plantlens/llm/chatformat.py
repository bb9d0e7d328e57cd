r"""Chat formatting with a grammar round trip, in column expressions alone.

    document := turn*          turn := "### " role mark LF text "</turn>"        mark := ":" (plain) | "!" (escaped)

The parser splits at every end mark, so a text that holds a control string ("###" or "</turn>"), or a role that also holds a line end, does not
come back. Each turn is rendered plainly, parsed and compared with its source; a turn that differs is rendered escaped:
"\" as "\\", "#" as "\h", "<" as "\l" and, in roles, LF as "\n", which leaves no control string and is undone exactly. The whole
document is parsed again and must equal its source.

Defined results: null role or text is empty; turns are ordered by turn (nulls first), role and text, so repeated and tied rows are kept; a
null conv_id is one conversation; an empty table gives no rows. A conversation is one output string, so its turns meet in one row.
Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END, MASKED = "### ", "</turn>", "assistant"


def escape(value: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def escape_role(value: Column) -> Column:
    return F.replace(escape(value), F.lit("\n"), F.lit("\\n"))


def unescape(value: Column) -> Column:
    """Pairs of backslashes part the string; between them every other code stands alone."""

    def codes(part: Column) -> Column:
        for plain, coded in (("#", "\\h"), ("<", "\\l"), ("\n", "\\n")):
            part = F.replace(part, F.lit(coded), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(value, r"\\\\"), codes), "\\")


def render(role: Column, text: Column, escaped: bool) -> Column:
    parts = (escape_role(role), F.lit("!\n"), escape(text)) if escaped else (role, F.lit(":\n"), text)
    return F.concat(F.lit(START), *parts, F.lit(END))


def parse(document: Column) -> Column:
    """Turns (role, text) of a document; null fields where it breaks the grammar."""
    pieces = F.split(document, END)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        mark, role = F.right(head, F.lit(1)), F.substr(head, F.lit(len(START) + 1), F.length(head) - len(START) - 1)
        text = F.substr(piece, F.length(head) + 2)
        good = piece.startswith(START) & mark.isin(":", "!") & ~F.contains(role, F.lit("###")) & ~F.contains(text, F.lit("###"))
        plain = F.struct(role.alias("role"), text.alias("text"))
        coded = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        none = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        return F.when(~good, none).when(mark == "!", coded).otherwise(plain)

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (start and length of each masked text in ``formatted``) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role, text)
    source = F.array(F.struct("role", "text"))
    plain = render(F.col("role"), F.col("text"), escaped=False)
    rows = rows.withColumn("same", parse(plain).eqNullSafe(source))
    rows = rows.withColumn("segment", F.when(F.col("same"), plain).otherwise(render(F.col("role"), F.col("text"), escaped=True)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("segment")).over(order), F.lit(0))
    body = F.length("segment") - F.length(F.substring_index("segment", "\n", 1)) - 1 - len(END)
    rows = rows.withColumn("start", before + F.length(F.substring_index("segment", "\n", 1)) + 1).withColumn("body", body)
    turns_ = F.sort_array(F.collect_list(F.struct("start", "turn", "role", "text", "segment", "body")))
    chats = rows.groupBy("conv_id").agg(turns_.alias("t"))
    formatted = F.array_join(F.transform("t", lambda t: t["segment"]), "")
    wanted = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    loss = F.transform(F.filter("t", lambda t: t["role"] == MASKED), lambda t: F.struct(t["start"].alias("start"), t["body"].alias("length")))
    chats = chats.select("conv_id", formatted.alias("formatted"), wanted.alias("wanted"), loss.alias("loss"))
    broken = F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string")
    return chats.select("conv_id", F.when(parse(F.col("formatted")).eqNullSafe(F.col("wanted")), F.col("formatted")).otherwise(broken).alias("formatted"), "loss")


def masked_texts(formatted: Column, loss: Column) -> Column:
    """The source texts of the spans of a loss mask: each is cut out of the document and undone if the mark before it says so."""

    def text(span: Column) -> Column:
        cut = F.substr(formatted, span["start"] + 1, span["length"])
        return F.when(F.substr(formatted, span["start"] - 1, F.lit(1)) == "!", unescape(cut)).otherwise(cut)

    return F.transform(loss, text)


def read_back(chats: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted documents say; the loss is read by the mask."""
    read = chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
