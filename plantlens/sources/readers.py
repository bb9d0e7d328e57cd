"""Readers: chunk files, page extracts, registries, sheets, notes, symbol tables, views, stores, assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import address, doc_key, name_key
from ..operators.ordered import carry_last, number_rows

# Fixed values
TITLE_LABELS = ("doc_title", "paragraph_title")
PICTURE_LABELS = ("image", "chart")
SHEET_FIELDS = (
    ("발생일자(원본)", "발생일자"),
    ("결함개소", "결함개소"),
    ("발생내용", "발생내용"),
    ("조치내용", "조치내용"),
    ("조치일(원본)", "조치일"),
    ("미가동시간", "미가동시간h"),
    ("수리비용", "수리비용"),
)
NOTE_HEADER = r"^업체명:\s*(.*?), 기계명:\s*(.*?), CNC:"
DOCUMENT_KINDS = ("manual", "controller", "electrical", "ladder", "etc")
# Each view with its fixed order.
VIEWS: Mapping[str, tuple[str, Sequence[str]]] = {
    "daily-planned-rate": ("V_CMS_DAILY_PLANNED_RATE", ("WORK_DATE",)),
    "hourly-rate": ("V_CMS_HOURLY_RATE", ("WORK_DATE", "HOUR_SEQ")),
    "daily-alarm-summary": ("V_CMS_DAILY_ALARM_SUMMARY", ("ALARM_RANK",)),
    "alarm-machine-top3": ("V_CMS_ALARM_MACHINE_TOP3", ("ALARM_RANK",)),
    "longest-alarm-top3": ("V_CMS_LONGEST_ALARM_TOP3", ("ALARM_RANK",)),
}


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Standard chunks from JSON lines (UTF-8, byte order mark allowed); blank lines are skipped.

    Metadata stays a VARIANT because its keys and types differ per extractor.
    """
    line = F.regexp_replace("value", "^﻿", "")
    lines = spark.read.text(path).select(line.alias("line")).filter(F.trim("line") != "")
    row = F.from_json("line", "id string, page_content string, metadata variant")
    return lines.select(row.alias("r")).select("r.*")


def ocr_blocks(pages: DataFrame, doc: str, file: str, data: str) -> DataFrame:
    """Blocks of per-page extracts. The page number is the number in the file name plus 1, the section title runs
    on inside a page, and the kind and asset name follow from label and box.

    ``data``: struct(parsing_res_list array<struct(block_label, block_content, block_bbox)>, width, height).
    """
    page = F.regexp_extract(file, r"_(\d+)_res\.json$", 1).cast("bigint") + 1
    b = pages.select(F.col(doc).alias("doc"), page.alias("page"), f"{data}.width", f"{data}.height", F.posexplode(f"{data}.parsing_res_list").alias("position", "b"))
    b = b.select("doc", "page", "position", F.col("b.block_label").alias("label"), F.trim("b.block_content").alias("text"), F.col("b.block_bbox").alias("bbox"), "width", "height")
    title = F.when(F.col("label").isin(*TITLE_LABELS), F.col("text"))
    b = carry_last(b, ["doc", "page"], ["position"], F.floor(F.col("position") / 4096), {"section_title": title})
    kind = F.when(F.col("label") == "table", "tables").when(F.col("label").isin(*PICTURE_LABELS), "pictures").otherwise("texts")
    name = F.concat(F.lit("p"), F.lpad(F.col("page").cast("string"), 4, "0"), F.lit("-b"), F.lpad(F.col("position").cast("string"), 4, "0"))
    asset = F.when(kind == "pictures", F.concat(name, F.lit(".jpg"))).when((kind == "tables") & (F.col("text") != ""), F.concat(name, F.lit(".md"))).otherwise("")
    return b.withColumn("container_type", kind).withColumn("asset", asset).withColumn("section_title", F.coalesce("section_title", F.lit("")))


def struct_rows(rows: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extract rows renumbered by their position in the document, and the rows that break a rule.

    ``rows``: doc, pos, chunk_id, sha, first, last, ...; ``manifest``: doc, source_sha, pages. The original id is
    kept; repeated ids are flagged.
    """
    d = rows.join(manifest, "doc")
    wrong = F.when(F.col("sha") != F.col("source_sha"), "hash").when(
        ~((F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= F.col("pages"))), "pages"
    )
    numbered = number_rows(d, ["doc"], ["pos"], F.floor(F.col("pos") / 65536), "__n")
    seen = d.groupBy("doc", "chunk_id").agg(F.min("pos").alias("__first"))
    new_id = F.concat_ws(":", F.lit("docling"), "doc", F.concat(F.lit("b"), F.lpad((F.col("__n") - 1).cast("string"), 6, "0")))
    good = numbered.join(seen, ["doc", "chunk_id"]).filter(wrong.isNull()).select(
        "doc", "pos", F.col("chunk_id").alias("original_chunk_id"), new_id.alias("chunk_id"), (F.col("pos") != F.col("__first")).alias("repeated")
    )
    return good, d.filter(wrong.isNotNull()).select("doc", "pos", wrong.alias("problem"))


def registry_machines(texts: DataFrame, json: str) -> DataFrame:
    """Machines of registry JSON: code and their entry as VARIANT."""
    held = F.from_json(F.col(json), "map<string, variant>")
    return texts.select(F.explode(held).alias("machine_code", "info"))


def registry_names(machines: DataFrame) -> DataFrame:
    """Names of each machine; the entry holds one name or a list of them."""
    info = F.col("info")
    names = F.coalesce(
        F.try_variant_get(info, "$.machine_name", "array<string>"), F.array_compact(F.array(F.try_variant_get(info, "$.machine_name", "string")))
    )
    return machines.select("machine_code", F.posexplode(names).alias("name_no", "machine_name"))


def registry_documents(machines: DataFrame) -> DataFrame:
    """Linked documents: kind, file name, key and manual type; an entry is a name or an object."""
    groups = F.map_filter(
        F.try_variant_get(F.col("info"), "$.document", "map<string, array<variant>>"), lambda kind, _: kind.isin(*DOCUMENT_KINDS)
    )
    d = machines.select("machine_code", F.explode(groups).alias("document_type", "entries")).select("machine_code", "document_type", F.explode("entries").alias("e"))
    name = F.coalesce(F.try_variant_get(F.col("e"), "$.filename", "string"), F.try_variant_get(F.col("e"), "$", "string"))
    return d.select(
        "machine_code", "document_type", name.alias("filename"), doc_key(name).alias("doc_key"), F.try_variant_get(F.col("e"), "$.manual_type", "string").alias("manual_type")
    )


def repair_cases(cells: DataFrame, company: str, workbook: str) -> DataFrame:
    """Repair cases of sheet cells: header in row 2 (from 0), merged cells filled, rows with a symptom or an action.

    ``cells``: sheet, row, col, value, merged_row, merged_col (origin of the merged range, null outside one).
    """
    head = cells.filter("row = 2").select("sheet", "col", name_key(F.col("value")).alias("field")).filter("field <> ''")
    body = cells.filter("row > 2").join(head, ["sheet", "col"])
    origin = cells.select("sheet", F.col("row").alias("merged_row"), F.col("col").alias("merged_col"), F.trim("value").alias("__o"))
    filled = body.join(origin, ["sheet", "merged_row", "merged_col"], "left").withColumn("filled", F.coalesce("__o", F.trim("value"), F.lit("")))
    pick = lambda key, col="filled": F.coalesce(F.max(F.when(F.col("field") == key, F.col(col))), F.lit(""))
    own = lambda key: F.coalesce(F.max(F.when(F.col("field") == key, F.trim("value"))), F.lit(""))
    fields = [pick(key).alias(f"f{i}") for i, (_, key) in enumerate(SHEET_FIELDS)]
    rows = filled.groupBy("sheet", "row").agg(*fields, pick("순번").alias("no"), own("발생내용").alias("own_s"), own("조치내용").alias("own_a"))
    symptom, action = F.col("f2"), F.col("f3")
    kept = rows.filter(
        ((F.col("own_s") != "") | (F.col("own_a") != "")) & (F.col("no") != "계") & ~F.col("no").contains("G0900")
        & ~((name_key(symptom) == "발생내용") & (name_key(action) == "조치내용"))
    )
    number = (F.col("row") + 1).cast("string")
    lines = [
        F.concat(F.lit(f"{label}: "), F.when(F.col(f"f{i}") != "", F.col(f"f{i}")).otherwise("기록 없음")) for i, (label, _) in enumerate(SHEET_FIELDS)
    ]
    top = F.concat(F.lit(f"출처: {company} 공장 수리 이력 / "), F.col("sheet"), F.lit(" 시트 / "), number, F.lit("행"))
    return kept.select(
        F.concat_ws(":", F.lit("xls"), F.lit(workbook), "sheet", number).alias("id"),
        F.concat_ws("\n", top, F.concat(F.lit("장비: "), "sheet"), *lines).alias("document"),
        F.lit("factory_history").alias("case_type"),
        F.col("sheet").alias("machine_name"),
        (F.col("row") + 1).alias("source_row"),
    )


def field_notes(lines: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """One case per line, and the lines whose header cannot be read. ``lines``: line_no, line."""
    kept = lines.filter(F.trim("line") != "")
    good = F.col("line").rlike(NOTE_HEADER)
    number = F.col("line_no").cast("string")
    cases = kept.filter(good).select(
        F.concat_ws(":", F.lit("txt"), F.lit(file), number).alias("id"),
        F.concat(F.lit("출처: 업체별 수리 암묵지 / "), number, F.lit("줄\n"), "line").alias("document"),
        F.lit("company_knowledge").alias("case_type"),
        F.regexp_extract("line", NOTE_HEADER, 1).alias("company"),
        F.regexp_extract("line", NOTE_HEADER, 2).alias("machine_name"),
        F.col("line_no").alias("source_row"),
    )
    return cases, kept.filter(~good).select("line_no", "line")


def _recode(source: str, target: str):
    """Text held byte for byte in one encoding, read as another. Spark itself decodes only the common encodings."""

    @F.pandas_udf("string")
    def recode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: "" if s is None else s.encode(source).decode(target, errors="replace"))

    return recode


def read_symbols(spark: SparkSession, path: str, encoding: str = "cp949") -> DataFrame:
    """Tab-separated symbol table: address, symbol, short and long comment; rows without an address are skipped.

    The file is split as single bytes; only the text columns of rows with an address are decoded.
    """
    raw = spark.read.csv(path, sep="\t", encoding="iso-8859-1", quote="", schema="a string, symbol string, short string, comment string")
    text = _recode("iso-8859-1", encoding)
    rows = raw.withColumn("address", address(F.col("a"))).filter("address is not null")
    return rows.select("address", *[text(F.col(c)).alias(c) for c in ("symbol", "short", "comment")])


def read_view(spark: SparkSession, key: str, jdbc: Mapping[str, str] | None = None, path: str | None = None, views=VIEWS) -> DataFrame:
    """A report view in its fixed order, over JDBC or from its Parquet copy."""
    table, order = views[key]
    df = spark.read.format("jdbc").options(dbtable=table, **jdbc).load() if jdbc else spark.read.parquet(f"{path}/{table}.parquet")
    return df.orderBy(*order)


def read_graph(adjacency: DataFrame, nodes: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between node ids from an adjacency by position, and everything that does not align.

    ``adjacency``: row, col; ``nodes``: position, node; ``contents``: node.
    """
    src = nodes.select(F.col("position").alias("row"), F.col("node").alias("src"))
    dst = nodes.select(F.col("position").alias("col"), F.col("node").alias("dst"))
    edges = adjacency.join(src, "row", "left").join(dst, "col", "left")
    outside = edges.filter("src is null or dst is null").select(F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string")).alias("item"), F.lit("position").alias("problem"))
    empty = nodes.join(contents.select("node").distinct(), "node", "left_anti").select(F.col("node").alias("item"), F.lit("content").alias("problem"))
    twice = nodes.groupBy("position").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("position").cast("string").alias("item"), F.lit("twice").alias("problem"))
    return edges.filter("src is not null and dst is not null").select("src", "dst"), outside.unionByName(empty).unionByName(twice)


def page_evidence(titles: DataFrame, words: DataFrame, texts: DataFrame, references: DataFrame) -> DataFrame:
    """Evidence per page: titles, distinct words in first-seen order and the page text; pages are those with a title
    or a reference; coverage says whether words and text are both present.

    ``titles``: page, title; ``words``: page, pos, word; ``texts``: page, text; ``references``: page.
    """
    pages = titles.select("page").unionByName(references.select("page")).distinct()
    named = titles.groupBy("page").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    first = words.groupBy("page", "word").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select(
        "page", F.array_join(F.transform("w", lambda x: x.word), " ").alias("words")
    )
    d = pages.join(named, "page", "left").join(listed, "page", "left").join(texts, "page", "left")
    coverage = F.when(F.col("words").isNotNull() & F.col("text").isNotNull(), "full").otherwise("partial")
    evidence = F.concat_ws("\n", F.array_join("titles", " · "), "words", "text")
    return d.select("page", evidence.alias("evidence"), coverage.alias("coverage"))


def list_assets(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """File registry; the bytes are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "length", "modificationTime")


def file_hashes(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha"))


def hash_mismatch(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries whose file is missing or differs. Both: name, sha."""
    held = files.select("name", F.col("sha").alias("found"))
    return manifest.join(held, "name", "left").filter(~F.col("sha").eqNullSafe(F.col("found")))

