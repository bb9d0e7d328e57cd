"""Name, content and identifier normalisation as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

# Results must agree with existing indexes.
TOKEN_PATTERN = r"[A-Za-z]+\.?\d*\.?\d*|[가-힣]+|\d+"
WORD_PATTERN = r"[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*"
ADDRESS_PATTERN = r"^([A-Za-z])(\d+)(?:\.(\d+))?$"
SIGNAL_TYPES = {
    "X": "input",
    "Y": "output",
    "R": "internal_relay",
    "F": "cnc_to_pmc",
    "G": "pmc_to_cnc",
    "A": "alarm",
    "T": "timer",
    "C": "counter",
    "K": "keep_relay",
    "D": "data_register/data_memory",
    "E": "shared_memory",
    "P": "program/parameter/etc",
}


def nfc(c: Column) -> Column:
    """Unicode composition; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def compose(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))

    return compose(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def doc_key(c: Column, compose: bool = False) -> Column:
    """Document name: last path part, without .pdf/.lst/.lad, single spaces, lower case."""
    name = F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    name = F.trim(nfc(name) if compose else name)
    return F.lower(collapse(F.regexp_replace(name, r"(?i)^(.+)\.(pdf|lst|lad)$", "$1")))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9가-힣#]", "")


def latin_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")


def content_key(c: Column) -> Column:
    """Two texts with the same key are duplicates."""
    return F.lower(collapse(c))


def match_text(c: Column) -> Column:
    """Text as compared by the highlighter: letters, digits and Hangul separated by one space."""
    plain = F.regexp_replace(F.lower(c), r"^passage:\s*", "")
    return F.trim(F.regexp_replace(plain, "[^0-9a-z가-힣]+", " "))


def tokens(c: Column) -> Column:
    """Technical terms keep their numbers (x8.4); Hangul runs and digit runs stand alone."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def identifiers(c: Column) -> Column:
    """Words that start with a letter and hold a digit."""
    words = F.regexp_extract_all(c, F.lit(r"\b" + WORD_PATTERN + r"\b"), F.lit(0))
    return F.filter(words, lambda w: w.rlike(r"\d"))


def address(c: Column) -> Column:
    """X008.4 -> X8.4; null when the text is not an address."""
    part = lambda i: F.regexp_extract(F.trim(c), ADDRESS_PATTERN, i)
    number = lambda i: part(i).cast("bigint").cast("string")
    plain = F.concat(F.upper(part(1)), number(2))
    full = F.when(part(3) != "", F.concat(plain, F.lit("."), number(3))).otherwise(plain)
    return F.when(F.trim(c).rlike(ADDRESS_PATTERN), full)


def drawing_code(c: Column) -> Column:
    """Form printed on drawings: word padded to three digits, bit appended (X8.4 -> X0084)."""
    part = lambda i: F.regexp_extract(F.trim(c), ADDRESS_PATTERN, i)
    word = part(2).cast("bigint").cast("string")
    word = F.when(F.length(word) < 3, F.lpad(word, 3, "0")).otherwise(word)
    code = F.concat(F.upper(part(1)), word)
    full = F.when(part(3) != "", F.concat(code, part(3).cast("bigint").cast("string"))).otherwise(code)
    return F.when(F.trim(c).rlike(ADDRESS_PATTERN), full)


def signal_type(device: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SIGNAL_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, device), F.lit("unknown"))


def term_pattern(terms: Sequence[str]) -> str:
    """One alternative for each term: Hangul with any spacing inside a line, Latin words between non-word characters."""

    def alternative(words: list[str]) -> str:
        letters = "".join(words)
        if all("가" <= c <= "힣" for c in letters):
            return r"[^\S\n]*".join(letters)
        phrase = r"\s+".join(map(re.escape, words))
        return rf"(?<![a-z0-9]){phrase}(?![a-z0-9])" if letters.isascii() else phrase

    return "|".join(alternative(term.split()) for term in terms if term.strip())


def term_rlike(c: Column, terms: Sequence[str]) -> Column:
    pattern = term_pattern(terms)
    return F.lower(c).rlike(pattern.lower()) if pattern else F.lit(False)


def excerpt(c: Column, limit: int, marker: str) -> Column:
    """At most ``limit`` characters, back to the last line end when that lies past the middle."""
    head = F.substring(c, 1, limit)
    back = F.locate("\n", F.reverse(head))
    line_end = F.length(head) - back
    cut = F.when((back > 0) & (line_end >= limit // 2), F.substring(head, F.lit(1), line_end)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit(marker))
    )


def passage(section: Column, body: Column) -> Column:
    """Text handed to the embedding function."""
    with_title = F.concat(F.lit("passage: "), section, F.lit("\n"), body)
    return F.when(F.coalesce(F.trim(section), F.lit("")) != "", with_title).otherwise(
        F.concat(F.lit("passage: "), body)
    )


def drop_contents_lines(c: Column) -> Column:
    """Remove dot-leader lines of a table of contents."""
    return F.regexp_replace(c, r"(?m)^.*\.{3,}\s*[\d-]+[ \t]*$", "")


def readable_title(titles: Column, lines: Column, fallback: Column) -> Column:
    """Readable titles joined; else, when there were titles, the first readable line; else the fallback."""
    bad = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\ufffd]"
    good = F.filter(titles, lambda t: (F.trim(t) != "") & ~t.rlike(bad))
    line = F.filter(lines, lambda t: (F.trim(t) != "") & ~t.rlike(bad))
    any_title = F.exists(titles, lambda t: t != "")
    first_line = F.substring(F.trim(F.get(line, F.lit(0))), 1, 120)
    return (
        F.when(F.size(good) > 0, F.array_join(good, " · "))
        .when(any_title & (F.size(line) > 0), first_line)
        .otherwise(fallback)
    )
