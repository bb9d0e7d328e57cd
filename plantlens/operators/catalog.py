"""Catalog, registry and membership operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules


def for_machine(df: DataFrame, codes: str, machine: str) -> DataFrame:
    """Rows of one machine; ``ALL`` keeps every row. Codes are an array, so M1 never matches M10."""
    if machine == "ALL":
        return df
    return df.filter(F.array_contains(F.transform(codes, lambda c: F.trim(c)), machine.strip()))


def _field_condition(df: DataFrame, key: str, expected) -> Column:
    if not isinstance(expected, Mapping):
        return F.col(key) == F.lit(expected)
    if len(expected) != 1:
        raise ValueError(f"one operator per field: {expected}")
    (op, value), = expected.items()
    if op == "$contains":
        is_array = df.schema[key].dataType.typeName() == "array"
        return F.array_contains(key, value) if is_array else F.col(key) == value
    if op == "$ne":
        return ~F.col(key).eqNullSafe(F.lit(value))
    if op == "$in":
        return F.col(key).isin(list(value))
    raise ValueError(f"unsupported metadata filter: {op}")


def _where(df: DataFrame, where: Mapping) -> Column:
    out = F.lit(True)
    for key, expected in where.items():
        if key == "$and":
            for part in expected:
                out = out & _where(df, part)
        else:
            out = out & _field_condition(df, key, expected)
    return out


def _where_text(text: str, where: Mapping) -> Column:
    if set(where) == {"$or"}:
        out = F.lit(False)
        for part in where["$or"]:
            out = out | _where_text(text, part)
        return out
    if set(where) == {"$contains"}:
        return F.col(text).contains(where["$contains"])
    raise ValueError(f"unsupported document filter: {where}")


def where_filter(df: DataFrame, where: Mapping | None, text: str | None = None, where_text: Mapping | None = None) -> DataFrame:
    """Metadata and text predicates as one column expression, so simple parts reach the Parquet scan."""
    if where:
        df = df.filter(_where(df, where))
    return df.filter(_where_text(text, where_text)) if where_text else df


def route_manual(questions: DataFrame, text: str, catalog: DataFrame) -> DataFrame:
    """Allowed files per question; a question whose route has no file keeps a null (search is unfiltered)."""
    routed = questions.withColumn("__r", rules.manual_route(F.col(text))).select("*", "__r.*").drop("__r")
    c = catalog.select(F.col("doc_group").alias("__g"), "manual_type", "filename")
    allowed = (F.col("doc_group") == F.col("__g")) & (
        (F.col("purpose") == "any") | (F.col("purpose") == F.col("manual_type"))
    )
    return routed.join(c, allowed, "left").drop("__g")


def anonymise(df: DataFrame, document: str, fields: Sequence[str], marker: str = "작업내용:") -> DataFrame:
    """Only the text after the marker, without the identifying values of the same row."""
    at = F.instr(F.col(document), marker)
    work = F.when(at > 0, F.substring(F.col(document), at + F.lit(len(marker)), F.length(document))).otherwise("")
    for field in fields:
        work = F.when(F.coalesce(F.col(field), F.lit("")) == "", work).otherwise(F.replace(work, F.col(field), F.lit("")))
    return df.withColumn(document, F.trim(work)).drop(*fields)


def document_catalog(links: DataFrame) -> DataFrame:
    """One row per document: type and the sorted machine codes (bounded by the registered machines)."""
    return links.groupBy("doc_key").agg(
        F.min("document_type").alias("document_type"), F.array_sort(F.collect_set("machine_code")).alias("machine_code")
    )


def link_catalog(chunks: DataFrame, catalog: DataFrame, skip_types: Sequence[str] = ("electrical",)) -> DataFrame:
    """Chunks of registered documents; unregistered and skipped types drop out."""
    return chunks.join(catalog.filter(~F.col("document_type").isin(list(skip_types))), "doc_key")


def skip_prepared(chunks: DataFrame, preferred: DataFrame, source_type: str) -> DataFrame:
    """Drop one extractor's chunks for documents the preferred extractor has prepared."""
    keys = preferred.select("doc_key").distinct()
    other = chunks.filter(F.col("source_type") == source_type).join(keys, "doc_key", "left_anti")
    return chunks.filter(F.col("source_type") != source_type).unionByName(other)


def missing_documents(linked: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Linked documents without any extract."""
    return linked.join(extracted.select(key).distinct(), key, "left_anti")


def keep_identified(items: DataFrame, query: str, text: str, kind: str, wanted: DataFrame) -> DataFrame:
    """Keep the pictures that name an identifier asked for; when none does, keep all of the query's items."""
    def named(identifier: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)(^|[^\w.-])"), F.replace(identifier, F.lit("."), F.lit(r"\.")), F.lit(r"($|[^\w.-])"))
        return F.coalesce(F.regexp_like(F.col(text), pattern), F.lit(False))

    asked = wanted.groupBy(query).agg(F.collect_set("identifier").alias("__asked"))  # the few a question names
    flagged = items.join(asked, query, "left").withColumn(
        "__hit", (F.col(kind) == "pictures") & F.coalesce(F.exists("__asked", named), F.lit(False))
    )
    any_hit = flagged.groupBy(query).agg(F.max("__hit").alias("__any"))
    return (
        flagged.join(any_hit, query)
        .filter(~F.col("__any") | (F.col(kind) != "pictures") | F.col("__hit"))
        .select(*items.columns)
    )


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) with inner contained in outer, as an equi join on substrings.

    Only the distinct lengths of the inner names are cut out; names are file names, so there are few.
    """
    lengths = [r[0] for r in inner.select(F.length("inner")).distinct().collect()]

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("outer") - n + 1)
        cut = F.transform(starts, lambda i: F.substring(F.col("outer"), i, F.lit(n)))
        return F.when(F.length("outer") >= n, cut).otherwise(F.array().cast("array<string>"))

    parts = [pieces(n) for n in lengths if n]
    cut = outer.select("outer", F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("inner"))
    return cut.join(inner, "inner").select("inner", "outer")


def resolve_documents(documents: DataFrame, registry: DataFrame, key: str, machine: str) -> DataFrame:
    """Machines of a document: the exact name first, else every registered name contained in it or containing it."""
    names = documents.select(F.col(key).alias("d")).distinct()
    known = registry.select(F.col(key).alias("r")).distinct()
    exact = names.join(known, F.col("d") == F.col("r")).select("d", "r")
    rest = names.join(known, F.col("d") == F.col("r"), "left_anti")
    down = _inside(known.select(F.col("r").alias("inner")), rest.select(F.col("d").alias("outer")))
    up = _inside(rest.select(F.col("d").alias("inner")), known.select(F.col("r").alias("outer")))
    links = (
        exact.unionByName(down.select(F.col("outer").alias("d"), F.col("inner").alias("r")))
        .unionByName(up.select(F.col("inner").alias("d"), F.col("outer").alias("r")))
        .distinct()
    )
    machines = registry.select(F.col(key).alias("r"), machine).distinct()
    found = links.join(machines, "r").select(F.col("d").alias(key), machine).distinct()
    return documents.join(found, key)


def explode_machines(df: DataFrame, codes: str, out: str = "machine") -> DataFrame:
    """One row per distinct machine code of a row."""
    return df.select("*", F.explode(F.array_distinct(codes)).alias(out))


def readiness(documents: DataFrame, searchable: DataFrame) -> DataFrame:
    """State per machine from registered documents and documents found in the search index.

    ``documents``: machine, doc_key (null when none is registered); ``searchable``: machine, doc_key.
    """
    found = searchable.select("machine", "doc_key", F.lit(1).alias("found")).distinct()
    per = (
        documents.distinct()
        .join(found, ["machine", "doc_key"], "left")
        .groupBy("machine")
        .agg(F.count("doc_key").alias("document_count"), F.count("found").alias("searchable_count"))
    )
    state = (
        F.when(F.col("document_count") == 0, "no_documents")
        .when(F.col("searchable_count") == 0, "no_search_data")
        .when(F.col("searchable_count") < F.col("document_count"), "partial")
        .otherwise("ready")
    )
    return per.withColumn("state", state)


def machine_document_links(df: DataFrame, machine: str, document: str) -> DataFrame:
    """Distinct links with the number of machines of each document and documents of each machine.

    Rows, not nested lists: a machine may own a large share of the documents.
    """
    links = df.select(machine, document).distinct()
    machines = links.groupBy(document).agg(F.count("*").alias("n_machines"))
    documents = links.groupBy(machine).agg(F.count("*").alias("n_documents"))
    return links.join(machines, document).join(documents, machine)


def merge_manifests(df: DataFrame, key: str, fields: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """One row per document with the first non-null value of each field, and the conflicting fields."""
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    differ = [(F.min(f) != F.max(f)).alias(f"__{f}") for f in fields]
    g = df.groupBy(key).agg(*first, *differ)
    clash = F.array_compact(F.array(*[F.when(F.col(f"__{f}"), F.lit(f)) for f in fields]))
    merged = g.select(key, *fields)
    conflicts = g.select(key, F.explode(clash).alias("field"))
    return merged, conflicts


def symbol_addresses(texts: DataFrame, key: str, text: str, dictionary: DataFrame, pattern: str) -> DataFrame:
    """Addresses whose symbol or alarm code a text names. ``dictionary``: label (upper case), address."""
    words = F.array_distinct(F.regexp_extract_all(F.upper(F.col(text)), F.lit(pattern), F.lit(0)))
    named = texts.select(key, F.explode(words).alias("label"))
    return named.join(dictionary.distinct(), "label").select(key, "address").distinct()
