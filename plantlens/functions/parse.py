"""Markup, tables, nested metadata, model output and citations."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .rules import WARNING_TITLE, is_warning_icon

TAG = r"""</?[a-zA-Z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
ENTITY = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]{0,31};?)"
TOKEN = rf"(?s)<!--.*?-->|(?i:<(script|style)\b[^>]*+>.*?</\1\s*+>)|<[!?][^>]*+>|{TAG}|{ENTITY}|[^<&]++|[<&]"
OPENS_LINE, CLOSES_LINE, CLOSES_CELL = ("tr", "div", "p", "br", "table"), ("tr", "div", "p", "table"), ("td", "th")  # fixed values
PICTURE = "[그림 설명] "


def _character(code: Column) -> Column:
    """The character of a numeric reference: bytes 128 to 159 as Windows text, none for codes that are no text, the replacement mark for no character."""
    windows = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
    old = F.element_at(F.create_map(*[F.lit(x) for pair in windows.items() for x in pair]), code.cast("int"))
    control = (code < 9) | ((code > 13) & (code < 32)) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    wrong = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(wrong, "\ufffd").when(code == 13, "\r").when(control, "").when(code.between(0x80, 0x9F), old).otherwise(plain)


def _entity(token: Column) -> Column:
    """Text of one character reference; a name without its semicolon is read by its longest known beginning."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    number = F.regexp_extract(token, r"^&#([0-9]+)", 1)
    hexed = F.regexp_extract(token, r"^&#[xX]([0-9a-fA-F]+)", 1)
    code = F.when(number != "", number.try_cast("bigint")).otherwise(F.conv(F.when(F.length(hexed) <= 8, hexed).otherwise("ffffffff"), 16, 10).try_cast("bigint"))
    name = F.substring(token, F.lit(2), F.length(token))
    begun = [F.concat(F.element_at(names, F.substring(name, 1, n)), F.substring(name, F.lit(n + 1), F.length(name))) for n in range(6, 1, -1)]
    named = F.coalesce(F.element_at(names, name), *begun, token)
    common = F.when(token == "&amp;", "&").when(token == "&lt;", "<").when(token == "&gt;", ">").when(token == "&quot;", '"')
    return common.when(token.startswith("&#"), _character(code)).otherwise(named)


def unescape(text: Column) -> Column:
    """Character references of a text replaced by what they stand for."""
    parts = F.regexp_extract_all(text, F.lit(rf"{ENTITY}|[^&]++|&"), F.lit(0))
    read = lambda p: F.when(F.startswith(p, F.lit("&")) & (F.length(p) > 1), _entity(p)).otherwise(p)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, read), "")).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    value = lambda i: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i)
    return unescape(F.concat(value(1), value(2), value(3)))


def _token_text(token: Column) -> Column:
    """What one token of the markup adds to the text."""
    name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    label = _attribute(token, "alt")
    image = F.when((label == "") | is_warning_icon(label), "").otherwise(F.concat(F.lit("\n" + PICTURE), label, F.lit("\n")))
    ends = F.startswith(token, F.lit("</")) | F.endswith(token, F.lit("/>"))
    opened = F.when(~F.startswith(token, F.lit("</")) & name.isin(*OPENS_LINE), "\n").otherwise("")
    closed = F.when(ends & name.isin(*CLOSES_CELL), " | ").when(ends & name.isin(*CLOSES_LINE), "\n").otherwise("")
    tag = F.when(name == "img", F.when(F.startswith(token, F.lit("</")), "").otherwise(image)).otherwise(F.concat(opened, closed))
    markup = F.startswith(token, F.lit("<")) & (F.length(token) > 1)
    dropped = token.rlike(r"(?i)^<(?:[!?]|(?:script|style)\b)")
    entity = F.startswith(token, F.lit("&")) & (F.length(token) > 1)
    return F.when(markup, F.when(dropped, "").otherwise(tag)).when(entity, _entity(token)).otherwise(token)


def page_text(html: Column) -> Column:
    """Readable text of a page of markup and Markdown.

    The page is read once as tokens: cells end with a bar, blocks break lines, comments, scripts and styles go, character references are read and
    images leave their label. Warning icons leave nothing, be they images of the markup, Markdown images or annotations in bold with their list.
    """
    icon = rf"\s*(?i:{WARNING_TITLE})\s*"
    steps = (
        (rf"(?m)^\*\*\[그림\]{icon}(?:[:：](?:(?!\*\*)[^\n])*+)?\*\*[^\n]*+(?:\n[ \t]++-[^\n]*+)*+", ""),
        (rf"!\[{icon}(?:[:：][^\]]*+)?\]\([^)]++\)", ""),
        (r"!\[([^\]]*+)\]\([^)]++\)", r"\[그림 설명\] $1"),
        (r"\n[ \t]*+\n(?:[ \t]*+\n)++", "\n\n"),
        (r"^\s+|\s+$", ""),
    )
    out = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), _token_text), "")
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per table cell: table, row and cell position (from 0), text, row span, column span."""
    tables = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    rows = F.regexp_extract_all(F.col("__t"), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("__r"), F.lit(r"(?is)<t[dh][^>]*>.*?</t[dh]>"), F.lit(0))
    span = lambda name: F.coalesce(
        F.regexp_extract(F.col("__c"), rf'(?i)^<t[dh][^>]*\b{name}="?(\d+)', 1).try_cast("int"), F.lit(1)
    )
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("__c"), "<[^>]*>", " "), r"\s+", " "))
    return (
        df.select(key, F.posexplode(tables).alias("table_no", "__t"))
        .select(key, "table_no", F.posexplode(rows).alias("row_no", "__r"))
        .select(key, "table_no", "row_no", F.posexplode(cells).alias("cell_no", "__c"))
        .select(
            key, "table_no", "row_no", "cell_no", text.alias("text"),
            span("rowspan").alias("rowspan"), span("colspan").alias("colspan"),
        )
    )


def coordinate_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of the ``Rn | Cn: value`` text form; a text with any other line gives no cells."""
    lines = F.split(F.trim(F.col(text)), r"\n")
    form = r"^R\d+\s*\|\s*C\d+:\s*.*$"
    good = df.filter(F.forall(lines, lambda line: F.trim(line).rlike(form)))
    pairs = F.regexp_extract_all(F.trim(F.col("__l")), F.lit(r"C\d+:\s*(?:(?!\s*\|\s*C\d+:).)*"), F.lit(0))
    return (
        good.select(key, F.posexplode(lines).alias("row_no", "__l"))
        .select(key, "row_no", F.explode(pairs).alias("__p"))
        .select(
            key,
            "row_no",
            F.regexp_extract("__p", r"^C(\d+):", 1).cast("int").alias("col_no"),
            F.trim(F.regexp_replace("__p", r"^C\d+:\s*", "")).alias("text"),
        )
    )


def spread_cells(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """Grid positions covered by each placed cell (row_no, col_no, rowspan, colspan)."""
    rows = F.sequence(F.col("row_no"), F.col("row_no") + F.col("rowspan") - 1)
    cols = F.sequence(F.col("col_no"), F.col("col_no") + F.col("colspan") - 1)
    return cells.select(*key, "text", "colspan", "col_no", F.explode(rows).alias("grid_row")).select(
        *key, "grid_row", F.explode(cols).alias("grid_col"), "text"
    )


def _flattener():
    """Scalars of nested JSON with type, length and null markers so that nothing is lost."""

    def scalars(text: str, prefix: str) -> list[dict]:
        found, level = [], {prefix: json.loads(text)}
        while level:  # one level of nesting at a time
            deeper = {}
            for path, value in level.items():
                named = value if isinstance(value, dict) else {f"{i:03d}": v for i, v in enumerate(value)} if isinstance(value, list) else None
                if named is None:
                    found.append((path, value) if isinstance(value, str) else (path, json.dumps(value)) if value is not None else (f"{path}__is_null", "true"))
                    continue
                found.append((f"{path}__type", type(value).__name__))
                if isinstance(value, list):
                    found.append((f"{path}__length", str(len(value))))
                deeper |= {f"{path}__{name}": child for name, child in named.items()}
            level = deeper
        return [{"path": p, "value": v} for p, v in found]

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def flatten_json(docs: pd.Series, prefixes: pd.Series) -> pd.Series:
        return pd.Series([scalars(d, prefix) if d else [] for d, prefix in zip(docs, prefixes)])

    return flatten_json


def flatten_meta(df: DataFrame, key: str, doc: str, prefix: str) -> DataFrame:
    flat = _flattener()(F.col(doc), F.lit(prefix))
    return df.select(key, F.explode(flat).alias("__f")).select(key, "__f.path", "__f.value")


def parse_triples(text: Column) -> Column:
    """Subject, predicate, object arrays in model output: the whole text as JSON, else its bracketed part."""
    bracketed = F.regexp_extract(text, r"(?s)\[\s*\[.*\]\s*\]", 0)
    whole = F.from_json(text, "array<array<string>>")
    rows = F.coalesce(whole, F.from_json(bracketed, "array<array<string>>"))
    trimmed = F.transform(rows, lambda r: F.transform(r, lambda x: F.trim(x)))
    good = F.filter(
        trimmed,
        lambda r: (F.size(r) == 3)
        & F.forall(r, lambda x: F.coalesce(x, F.lit("")) != "")
        & (F.length(r[0]) <= 120)
        & (F.length(r[1]) <= 80)
        & (F.length(r[2]) <= 200),
    )
    return F.coalesce(F.array_distinct(good), F.array().cast("array<array<string>>"))


def parse_items(text: Column, fields: Sequence[str]) -> Column:
    """Objects of a JSON list in model output, fenced or not: their trimmed ``fields`` as structs; an item that lacks one or is no
    object is left out, and text that is no list gives none."""
    body = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    fenced = body.startswith("```") & body.endswith("```") & (F.length(body) > 6)
    inner = F.when(fenced, F.regexp_extract(body, r"(?s)^[^\n]*\n?(.*)```$", 1)).otherwise(body)
    items = F.try_variant_get(F.try_parse_json(inner), "$", "array<variant>")
    value = lambda item, f: F.trim(F.coalesce(F.try_variant_get(item, f"$.{f}", "string"), F.lit("")))
    found = F.transform(items, lambda item: F.struct(*[value(item, f).alias(f) for f in fields]))
    full = F.filter(found, lambda item: F.array_min(F.array(*[F.length(item[f]) for f in fields])) > 0)
    return F.coalesce(full, F.filter(F.array(F.struct(*[F.lit("").alias(f) for f in fields])), lambda _: F.lit(False)))


def parse_paren_triples(text: Column) -> Column:
    """The ``(s, p, o); (s, p, o)`` form."""
    form = r"\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*,\s*([^()]+?)\s*\)"
    bare = lambda m, i: F.regexp_replace(F.regexp_extract(m, form, i), "^['\"]+|['\"]+$", "")
    found = F.transform(
        F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda m: F.array(bare(m, 1), bare(m, 2), bare(m, 3))
    )
    return F.filter(found, lambda r: F.forall(r, lambda x: x != ""))


def citation_numbers(text: Column) -> Column:
    """Distinct source numbers of ``[chunk:N]`` and ``[1, 2]`` in order of first mention."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(?:chunk:)?(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("bigint")))


def citation_labels(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per cited number with its 1-based label by first mention."""
    cited = F.posexplode(citation_numbers(F.col(text))).alias("__p", "chunk_index")
    return df.select(*keys, cited).select(*keys, "chunk_index", (F.col("__p") + 1).alias("label"))


def claim_lines(text: Column, number: int) -> Column:
    """Lines citing one source, without the marks, before the list of reviewed sheets."""
    body = F.split(text, r"\n\s*검토한 도면 페이지\s*:")[0]
    lines = F.filter(F.split(body, r"\r?\n"), lambda line: F.lower(line).contains(f"[chunk:{number}]"))
    clean = F.transform(
        lines,
        lambda line: F.trim(
            F.regexp_replace(
                F.regexp_replace(F.regexp_replace(line, r"^>\s?", ""), r"\*\*([^*\n]+)\*\*", "$1"), r"(?i)\[chunk:\d+\]", ""
            )
        ),
    )
    return F.array_join(clean, "\n")


def project_spec(df: DataFrame, spec: Mapping[str, Mapping]) -> DataFrame:
    """Report fields by specification: first present source column, tolerant cast, default.

    An empty specification passes the rows through.
    """
    if not spec:
        return df
    out = []
    for name, field in spec.items():
        sources = field["source"] if isinstance(field["source"], (list, tuple)) else [field["source"]]
        present = [F.col(s).cast("string") for s in sources if s in df.columns]
        raw = F.coalesce(*present) if present else F.lit(None).cast("string")
        kind, default = field.get("type", "str"), field.get("default")
        plain = F.trim(F.replace(raw, F.lit(","), F.lit("")))
        if kind == "int":
            value = F.coalesce(plain.try_cast("double").cast("bigint"), F.lit(default).cast("bigint"))
        elif kind == "float":
            value = F.coalesce(plain.try_cast("double"), F.lit(default).cast("double"))
        else:
            value = F.coalesce(F.trim(raw), F.lit(default).cast("string"))
        out.append(value.alias(name))
    return df.select(*out)
