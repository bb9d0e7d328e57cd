"""Page ranges and their labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def page_matches(page_range: Column, page: Column) -> Column:
    """``N``, ``a-b``, ``a,b`` or exact text; an unknown page matches everything."""
    raw = F.trim(F.coalesce(page_range, F.lit("")))
    left = F.trim(F.substring_index(raw, "-", 1))
    right = F.trim(F.regexp_extract(raw, r"^[^-]*-(.*)$", 1))
    spans = raw.contains("-") & left.rlike(r"^\d+$") & right.rlike(r"^\d+$")
    listed = F.transform(F.split(raw, ","), lambda p: F.trim(p))
    target = page.cast("bigint").cast("string")
    stripped = F.transform(listed, lambda p: F.regexp_replace(p, r"^0+(\d)", "$1"))
    return (
        F.when(page.isNull(), True)
        .when(raw == "", False)
        .when(raw.rlike(r"^\d+$"), raw.try_cast("bigint") == page)
        .when(spans, page.between(left.try_cast("bigint"), right.try_cast("bigint")))
        .when(raw.contains(","), F.array_contains(stripped, target))
        .otherwise(raw == target)
    )


def first_page(page_range: Column) -> Column:
    found = F.regexp_extract(page_range, r"(\d+)", 1)
    return F.when(found != "", found.try_cast("bigint"))


def page_label(page_range: Column) -> Column:
    """p.3, p.3~p.5; other text keeps its form with ~ for -."""
    raw = F.trim(page_range)
    a = F.regexp_extract(raw, r"^(\d+)\s*-\s*(\d+)$", 1)
    b = F.regexp_extract(raw, r"^(\d+)\s*-\s*(\d+)$", 2)
    return (
        F.when(raw == "", F.lit(None))
        .when((a != "") & (a == b), F.concat(F.lit("p."), a))
        .when(a != "", F.concat(F.lit("p."), a, F.lit("~p."), b))
        .when(raw.rlike(r"^\d+$"), F.concat(F.lit("p."), raw))
        .otherwise(F.concat(F.lit("p."), F.regexp_replace(raw, r"\s*-\s*", "~")))
    )


def single_page(page_range: Column) -> Column:
    """The page of a range that covers exactly one page, else null."""
    a = F.regexp_extract(page_range, r"^(\d+)(?:-(\d+))?$", 1)
    b = F.regexp_extract(page_range, r"^(\d+)(?:-(\d+))?$", 2)
    return F.when((a != "") & ((b == "") | (a == b)), a.try_cast("bigint"))
