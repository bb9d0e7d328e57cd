"""Personal data: base patterns, and identifiers of other spellings found by bootstrapped contexts.

Base spans of four kinds (email, ip, card, phone) are the seeds. A slot is a base span or a text of looser shape that no base span touches:
an address with a masked @ or dot or without a dot, a dotted or colon-separated number that is no ip, a group of digits that is no card or phone. Lexical
patterns of a slot are its two words on the left, and its word on either side, in lower case with digits as 0. Patterns and
instances (kind and spelling of a slot) form a graph. Each round Spark scores a pattern for a kind by the summed reliability of its instances of that kind over
all its different instances, and keeps those with a sum of SUPPORT and a score of RELIABLE; an unseen instance takes the best score
of its patterns, a seed has 1. Found instances count in the next round, until a round changes nothing, ROUNDS at most. The slots of found instances are added to
the base spans.

Only slots travel, never texts; a pattern sees each spelling once, so copies of a document and frequent identifiers add nothing. Frequent
patterns are summed by partial aggregates and met by equi joins that adaptive execution splits.

Defined results: null or empty text has no spans; rows are kept apart by a running number, so repeated rows and null ids are
answered one by one; an empty table gives no rows. Only doc_id and text are read, so other columns may have any name. A context looks at most
CONTEXT characters far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SUPPORT = 5.0
RELIABLE = 0.6
ROUNDS = 10
CONTEXT = 64

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A digit run is entered at its first digit only and never given back, so long runs take linear time; the matches are those of the plain patterns.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MASKED = re.compile(
    r"(?:@|\s?[(\[{]\s?at\s?[)\]}]\s?)[A-Za-z0-9-]++(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[A-Za-z0-9-]++)*", re.IGNORECASE)
_ADDRESS = re.compile(r"(?<![\w.:])(?:[0-9]++(?:\.[0-9]++){3,7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])")
_NUMBER = re.compile(r"(?<![\w.+/-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}+(?!\w)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _after_local(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Matches with the run of LOCAL characters before them; none overlap, and each character is looked at once."""
    free = 0
    for m in pattern.finditer(text):
        before = text[free : m.start()]
        start = free + len(before.rstrip(LOCAL))
        if start < m.start():
            yield start, m.end()
            free = m.end()
        else:
            free = m.start() + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = []
    if "@" in text:
        found += [(a, EMAIL, b) for a, b in _after_local(text, _HOST)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of texts of looser shape that touch no base span and no loose span before them."""
    found = []
    if "@" in text or _MASKED.search(text):
        found += [(a, EMAIL, b) for a, b in _after_local(text, _MASKED)]
    found += [(m.start(), IP, m.end()) for m in _ADDRESS.finditer(text)]
    found += [(m.start(), CARD if len(digits_of(m.group())) >= 14 else PHONE, m.end()) for m in _NUMBER.finditer(text)]
    merged, free = [], 0
    for start, kind, end, known in sorted([(a, k, b, 0) for a, k, b in base] + [(a, k, b, 1) for a, k, b in found], key=lambda s: (s[0], s[3], s[1])):
        if known == 0:
            while merged and merged[-1][2] > start:
                merged.pop()
            free = max(free, end)
        elif start >= free:
            merged.append((start, kind, end))
            free = end
    return merged


def patterns(text: str, start: int, end: int) -> list[str]:
    """Contexts of a slot that hold a letter."""
    plain = lambda word: re.sub("[0-9]+", "0", word.lower())
    left = [plain(w) for w in text[max(0, start - CONTEXT) : start].split()[-2:]]
    right = [plain(w) for w in text[end : end + CONTEXT].split()[:1]]
    found = [f"{left[0]} {left[1]} _"] if len(left) == 2 else []
    found.append(" ".join([*left[-1:], "_", *right]))
    return [p for p in found if any(c.isalpha() for c in p)]


SLOT = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(SLOT)), ("loose", pa.list_(SLOT))])
SLOT_DDL = "array<struct<start:bigint, kind:bigint, end:bigint, value:string, patterns:array<string>>>"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            base = base_spans(text or "")
            sides = [
                [{"start": a, "kind": k, "end": b, "value": text[a:b].lower(), "patterns": patterns(text, a, b)} for a, k, b in spans]
                for spans in (base, loose_spans(text or "", base))
            ]
            rows.append({"doc_id": doc, "base": sides[0], "loose": sides[1]})
        yield pa.RecordBatch.from_pylist(rows, FOUND)


def slots(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose, row) of every document; ``row`` tells rows apart."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_slots, f"doc_id bigint, base {SLOT_DDL}, loose {SLOT_DDL}")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "slots")


def _edges(rows: DataFrame) -> DataFrame:
    """(pattern, kind, value, seed), each once."""
    def side(name: str, seed: bool) -> DataFrame:
        slot = rows.select(F.explode(name).alias("s"))
        return slot.select(F.explode("s.patterns").alias("pattern"), "s.kind", "s.value", F.lit(seed).alias("seed"))

    return side("base", True).unionByName(side("loose", False)).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))


def learn(rows: DataFrame, support: float = SUPPORT, reliable: float = RELIABLE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Patterns (pattern, kind, reliability) and unseen instances (kind, value, reliability) that the slots teach."""
    edges = stored(_edges(rows), "edges")
    totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("total"), F.max(~F.col("seed")).alias("open")).where("open").drop("open")
    seeds = edges.where("seed").groupBy("pattern", "kind").agg(F.count(F.lit(1)).cast("double").alias("known"))
    unseen = stored(edges.where(~F.col("seed")).drop("seed"), "unseen")
    # per pattern and kind that an unseen instance asks for: seeds of the kind and all different spellings
    asked = unseen.select("pattern", "kind").distinct().join(totals, "pattern").join(seeds, ["pattern", "kind"], "left")
    asked = stored(asked.fillna(0.0, ["known"]), "asked")
    found, last = None, None
    for _ in range(rounds):
        held = asked.withColumn("sum", F.col("known"))
        if found is not None:
            more = unseen.join(found, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("reliability").alias("more"))
            held = asked.join(more, ["pattern", "kind"], "left").withColumn("sum", F.col("known") + F.coalesce("more", F.lit(0.0)))
        good = held.where((F.col("sum") >= support) & (F.col("sum") >= reliable * F.col("total")))
        good = stored(good.select("pattern", "kind", (F.col("sum") / F.col("total")).alias("reliability")), "patterns")
        found = stored(unseen.join(good, ["pattern", "kind"]).groupBy("kind", "value").agg(F.max("reliability").alias("reliability")), "instances")
        now = found.agg(F.count(F.lit(1)), F.round(F.sum("reliability"), 3)).first()
        if now == last:
            break
        last = now
    return good, found


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base and found spans (start, kind number, end) of every document."""
    rows = slots(docs)
    _, instances = learn(rows)
    loose = rows.select("row", F.explode("loose").alias("s")).select("row", "s.start", "s.kind", "s.end", "s.value")
    found = loose.join(instances, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    none = F.array().cast("array<struct<start:bigint, kind:bigint, end:bigint>>")
    return rows.select("row", "doc_id", plain.alias("base")).join(found, "row", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def spelled(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(name, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
