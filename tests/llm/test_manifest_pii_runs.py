"""Manifest, personal data and periodic runs on hand-made rows, against brute force."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from brute import plain_words
from plantlens.llm import merkle, pii, runs
from plantlens.llm.components import stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, `row` string, kind string, pos int, `start` int"


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["a b " * 9, "", None, "one", "x y z " * 5 + "x", "é ß " * 30, "p q r s t u v w x y z", " ".join(f"w{i % 7}" for i in range(200)), "long " * 3000]
    rows = [(None if i == 30 else i // 2 if i < 6 else i, texts[i % len(texts)], [None, "en", "de", "en", "é", ""][i % 6], None if i == 3 else "s", None if i % 4 == 0 else i) for i in range(61)]
    rows += [rows[0]] * 3
    return stored(spark.createDataFrame([(*r, None, "r", "k", 1, 2) for r in rows], SCHEMA).repartition(5), "fixture")


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return stored(docs.limit(0), "nothing")


# manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, n_chars):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return H(*(field(v) for v in (r.doc_id, r.source, r.lang, n_chars, r.text)))


def brute_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_siblings(levels, at):
    found = []
    for level in levels[:-1]:
        found.append((at ^ 1 < at, level[at ^ 1]) if at ^ 1 < len(level) else (False, ""))
        at >>= 1
    return found


def brute_manifest(rows, hit):
    trees, low = {}, -(1 << 63)
    for r in rows:
        trees.setdefault(r.lang, []).append((low if r.doc_id is None else r.doc_id, brute_leaf(r, r.n_chars), r))
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: brute_tree([leaf for _, leaf, _ in sorted(trees[g], key=lambda x: x[:2])]) for g in langs}
    top = brute_tree([built[g][-1][0] for g in langs])
    found = []
    for k, g in enumerate(langs):
        for i, (_, leaf, r) in enumerate(sorted(trees[g], key=lambda x: x[:2])):
            steps = brute_siblings(built[g], i) + brute_siblings(top, k)
            node = brute_leaf(r, r.n_chars + 1) if hit(r) and r.n_chars is not None else leaf
            for left, sibling in steps:
                node = H(sibling, node) if left else H(node, sibling)
            found.append((r.doc_id, leaf, built[g][-1][0], top[-1][0], H(*(s for _, s in steps)), node, node == top[-1][0]))
    return found


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest(docs, levels):
    rows = docs.collect()
    want = brute_manifest(rows, lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = F.when(hit & F.col("n_chars").isNotNull(), merkle.leaf_of(n_chars=F.col("n_chars") + 1))
    found = merkle.manifest(docs, changed, levels).collect()
    key = lambda t: str(t)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found), key=key) == sorted(want, key=key)
    tampered = [r for r in found if r.copied]
    assert tampered and not any(r.verified for r in tampered) and all(r.verified for r in found if not r.copied)
    assert all(len(r.copied) == 1 + len(r.proof) and r.copied[-1] == r.folded_root for r in tampered)


def test_versions_share_what_they_do_not_copy():
    block = merkle.Block([H(str(i)) for i in range(11)], 4)
    before = [list(level) for level in block.levels]
    for at in range(11):
        leaves = list(before[0])
        leaves[at] = "new"
        whole = merkle.Block(leaves, 4)
        assert block.version(at, "new") == [level[at >> k] for k, level in enumerate(whole.levels)]
        assert sum(a != b for x, y in zip(block.levels, whole.levels) for a, b in zip(x, y)) == 5
    assert block.levels == before


def test_manifest_of_nothing_and_of_one_row(docs, nothing):
    assert merkle.manifest(nothing).collect() == []
    (row,) = merkle.manifest(docs.where("doc_id = 20")).collect()
    assert row.root == H(row.leaf) or row.root == row.leaf
    assert row.verified and row.proof == []


# personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and brute_luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def brute_luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute_base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in re.finditer(p, text) if good(m.group())]
    return sorted(found)


TOKENS = st.sampled_from(["a", "é", "x.y", "@", "@@", ".", "-", " ", "  ", "+", "+1", "(309) ", "555-7741", "10.0.0.1", "256.1.1.1", ".1.2.3.4", "0", "00255", "4111 1111 1111 1111", "4242424242424242",
                          "m@h.example.com", "b@c", "\n", "%", "_", "١", "9" * 15, "|"])


@given(st.lists(TOKENS, max_size=12).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_the_plain_patterns(text):
    base = pii.base_spans(text)
    assert base == brute_base(text)
    spans = sorted(pii.loose_spans(text, base) + base)
    loose = set(pii.loose_spans(text, base))
    for (_, _, end), (start, kind, stop) in zip(spans, spans[1:]):
        assert end <= start or ((start, kind, stop) not in loose and end > start)


def test_long_texts_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000, "a." * 200_000 + "@", "1." * 200_000, "+1" * 100_000, "1 " * 200_000, "@a" * 200_000, "((((" * 90_000, "f:" * 200_000):
        base = pii.base_spans(text)
        pii.loose_spans(text, base)


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"word{i} please call me at +1 (309) 555-{7000 + i} today or never" for i in range(8)]
    texts += ["please call me at (309) 555-0199 today", "please call me at 309.555.0142 now", "the part 555-0142-77 is here", "build 20240101 of 2024"]
    texts += [f"n{i} write to u{i}@mail{i}.example.com for help" for i in range(7)] + ["write to john (at) corp (dot) org for help", "write to jane@intranet for help", "look at jane2@intranet there"]
    texts += ["see (309) 555-0199 elsewhere", None, "", "x 10.0.0.7 y"]
    rows = [(None if i % 5 == 0 else i, t, "k") for i, t in enumerate(texts)]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string, kind string").repartition(3), "contexts")
    found = pii.extract(docs).withColumn("spans", pii.spelled(F.concat("base", "found"))).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    text_of = {i: t for i, t, _ in rows if i is not None}
    extra = {i: [text_of[i][s.start : s.end] for s in r.found] for i, r in by_id.items() if r.found}
    nulls = sum(len(r.found) for r in found if r.doc_id is None)
    want = {i: [m] for i, m in ((8, "(309) 555-0199"), (9, "309.555.0142"), (19, "john (at) corp (dot) org"), (20, "jane@intranet"), (22, "(309) 555-0199")) if i % 5}
    assert {i: sorted(x) for i, x in extra.items()} == want and nulls == 1
    for i, r in by_id.items():
        assert [tuple(s) for s in sorted(r.base)] == brute_base(text_of[i] or "")


def test_found_instances_teach_further_patterns(spark):
    texts = [f"a{i} ring me on +1 (309) 555-{7000 + i} please b{i}" for i in range(9)]
    texts += [f"c{i} ring me on 309-555-{1000 + i} please d{i}" for i in range(6)] + [f"e{i} dial us under 309-555-{1000 + i} there" for i in range(6)] + ["f dial us under 309-555-2222 there"]
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "rounds")
    slots = pii.slots(docs)
    _, once = pii.learn(slots, support=3.0, rounds=1)
    _, more = pii.learn(slots, support=3.0)
    assert {r.value for r in once.collect()} == {f"309-555-{1000 + i}" for i in range(6)}
    assert {r.value for r in more.collect()} == {f"309-555-{1000 + i}" for i in range(6)} | {"309-555-2222"}


def test_personal_data_of_nothing(nothing):
    assert pii.extract(nothing).collect() == []


# periodic runs


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((l, r - l, q) for (l, r), q in found.items())


def listed(found):
    return sorted((int(l), int(r - l), int(q)) for l, r, q in zip(*found))


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@given(st.lists(st.integers(0, 2), max_size=120), st.integers(0, 40), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_runs_match_brute_force(tail, copies, width):
    words = tail[:width] * copies + tail
    assert listed(runs.find_runs(np.array(words, np.int64), len(words))) == brute_runs(words)


@pytest.mark.parametrize("words", [thue_morse(4096), fibonacci(1500), [0] * 700, ([0] * 40 + [1]) * 12, list(range(300)) * 3 + [1, 2, 3], ([0] * 30 + [1] + [0] * 30 + [2]) * 5])
def test_runs_of_hard_sequences(words):
    assert listed(runs.find_runs(np.array(words, np.int64), len(words))) == brute_runs(words)


def test_wrong_hashes_change_nothing(monkeypatch):
    words = np.array(fibonacci(400) + thue_morse(300), np.int64)
    right = listed(runs.find_runs(words, len(words)))
    monkeypatch.setattr(runs, "PRIMES", runs.PRIMES)
    reach = runs.Matcher._reach
    monkeypatch.setattr(runs.Matcher, "_reach", lambda self, most, test: np.minimum(most, reach(self, most, test) + 3))
    assert listed(runs.find_runs(words, len(words))) == right


def test_transform_needs_several_primes():
    windows = np.random.default_rng(5).permutation(1 << 18)[: 40 * 18].reshape(40, 18)
    windows[3, 5:9] = windows[3, :4]
    zero = runs.zero_distances(windows * 7919, 4)
    assert np.argwhere(zero[:, 1:]).tolist() == [[3, 4]]


def brute_plant(doc, words):
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_documents(docs, nothing):
    many = docs.withColumn("doc_id", F.col("doc_id") * 3 + F.length(F.coalesce("text", F.lit("")))).unionByName(docs)
    found = runs.periodic(runs.plant(many)).collect()
    rows = many.select("doc_id", "text").collect()
    want = []
    for r in rows:
        words = brute_plant(r.doc_id, plain_words(r.text))
        all_runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {i for l, n, q in all_runs for i in range(l + q, l + n)}
        top = min(all_runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((r.doc_id, len(words), len(all_runs), *top, 1000 * top[1] // top[2] if all_runs else None,
                     H("".join(f"{a},{b},{c}\n" for a, b, c in all_runs)), kept, H(kept)))
    got = [(r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed, r.collapsed_sha256) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert runs.periodic(nothing).collect() == []
