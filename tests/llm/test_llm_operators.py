"""The numbered operators on hand-made rows, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import alnum_words, brute_components, folded, plain_words, shingles
from plantlens.llm import chatformat, cuckoo, jaccard, langid, licenses, packing, sharding, simple8b, superkmer, tokens, winnow
from plantlens.llm.components import components, stored
from plantlens.llm.queries import tokenizer_file
from plantlens.llm.words import ALNUM, FOLDED, PLAIN, Words, flat, gather

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
COMMON = "the quick brown fox jumps over the lazy dog while seven small cats watch from a warm roof in spring".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(0, 5000)}" if rng.random() < 0.7 else COMMON[rng.integers(0, len(COMMON))] for _ in range(n))


def near(text: str, places: list[int]) -> str:
    words = text.split()
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


BASE = prose(1, 300)
TEXTS = [
    BASE, BASE, near(BASE, [10, 150]), near(BASE, [40, 200, 250]), BASE.replace(" ", " \t\n"), BASE.upper(), "", None, "one", "one two three",
    "one two three", " ".join(COMMON) + " " + prose(2, 40), prose(3, 60) + " " + " ".join(COMMON), "a b c d " * 40, "éÉ ß x " * 20,
    prose(4, 6000), "12 !! ?", "\x00\x1c nul and \x85 more", prose(5, 14), prose(5, 12), "Released under the MIT License. " * 3,
    "Licensed under the Apache Licence, Version 2.0.", prose(6, 2100), "日本語のテキスト 日本語", BASE + " tail",
]
IDS = [7, 3, 9, 11, 4, 5, 6, 8, 1, 2, 2, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, None]
SCHEMA = "doc_id bigint, text string, lang string, `row` string, `key` string, digest string, n_words int, place string, region string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en"][i is not None and i % 2], "x", None, "", 1, None, "r", None) for i, t in zip(IDS, TEXTS)]
    return stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "fixture")


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return stored(docs.limit(0), "nothing")


# words


@given(st.lists(st.text(alphabet="aB é\t\x00\n9_ß", max_size=30) | st.none(), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_match_regular_expressions(texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    for kind, split in ((PLAIN, plain_words), (ALNUM, alnum_words)):
        words = Words(data, offsets, kind)
        raw = data.tobytes()
        got = [[raw[words.start[i] : words.end[i]].decode() for i in range(words.first[d], words.first[d + 1])] for d in range(len(texts))]
        want = [split(t) for t in texts]
        assert [[folded(w) for w in d] for d in got] == [[folded(w) for w in d] for d in want]
    words = Words(data, offsets, FOLDED)
    seen = {}
    for d, text in enumerate(texts):
        for word, value in zip(plain_words(text), words.hash[words.first[d] : words.first[d + 1]].tolist()):
            assert seen.setdefault(folded(word), value) == value
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_do_not_depend_on_the_parts(monkeypatch):
    data, offsets = flat(pa.array([BASE, "one two", "", BASE[::-1]]))
    whole = Words(data, offsets, FOLDED).hash
    monkeypatch.setattr("plantlens.llm.words.HASH_BYTES", 7)
    assert (Words(data, offsets, FOLDED).hash == whole).all()


def test_gather_in_parts(monkeypatch):
    monkeypatch.setattr("plantlens.llm.words.SLICE_BYTES", 5)
    data = np.arange(100, dtype=np.uint8)
    start, end = np.array([3, 0, 50, 7, 7]), np.array([9, 1, 70, 7, 8])
    got, offsets = gather(data, start, end)
    assert got.tolist() == [x for a, b in zip(start, end) for x in range(a, b)] and offsets.tolist() == [0, 6, 7, 27, 27, 28]


# tokens


@pytest.mark.parametrize("path, style", [(BYTE, tokens.LEADING), (WORD, tokens.BARE)])
def test_cached_ids_are_the_tokenizers(path, style):
    whole = Tokenizer.from_file(path)
    alphabet = ["a", "b ", "  ", "\n", " \n", "\t", "é", "é", " ", "　", "\x1c", "'s", "'S", " 12", "!?", " _", "<|endoftext|>", "ß", "Σ",
                "İ", " ́", "​", "ſ", "漢字", "🙂", "\r\n", "\x85", "Word", " word,", "½", "ª"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(alphabet, size=rng.integers(0, 30))) for _ in range(3000)] + [t for t in TEXTS if t]
    for text, ids in zip(texts, tokens.encoder(path, style).texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def token_ids(path):
    whole = Tokenizer.from_file(path)
    return [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1 packing


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        sizes = rng.integers(1, 101, n).tolist()
        free, want = [], {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            leaf = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            free += [100] * (leaf == len(free))
            want[i] = (leaf, 100 - free[leaf])
            free[leaf] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(n)]


def test_packing_holds_every_token_once(docs, nothing, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 5)
    rows = packing.pack(docs, BYTE, carry=True).collect()
    want = sorted((IDS[i] or 0, crc(ids), len(ids)) for i, ids in enumerate(token_ids(BYTE)))
    starts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    whole = []
    for (doc, n), parts in starts.items():
        same = sum(s == 0 for s, _ in parts)
        joined = b"".join(p for _, p in sorted(parts)) if same == 1 else None
        whole += [(doc or 0, zlib.crc32(joined), n)] if joined is not None else [(doc or 0, zlib.crc32(p), n) for _, p in parts]
    assert sorted(whole) == want
    for places in sequences.values():
        ends = [0, *itertools.accumulate(length for _, length in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack(nothing, BYTE).count() == 0
    ids = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack(docs, BYTE, carry=True)).collect()}
    assert sum(map(len, ids.values())) == 4 * sum(n for *_, n in want)


# 2 chat formatting

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</turn>### x"), (1, 2, None, None), (2, 1, "assistant", "\\h \\\\l </turn"), (2, 1, "assistant", "\\h \\\\l </turn"),
    (None, 0, "a\n:###", "\n\n"), (3, None, "assistant", "#\\<" * 5), (3, 5, "user", "### user:\nno"), (4, 0, "assistant", ""), (5, 1, "user", "x" * 200_000),
]


def test_chats_survive(spark):
    turns = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id bigint, turn bigint, role string, text string, formatted int")
    formatted = chatformat.format_chats(turns)
    out = {r.conv_id: r for r in formatted.collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want[conv].append((role or "", text or ""))
    read = {r.conv_id: r for r in chatformat.read_back(formatted).collect()}
    for conv, rows in want.items():
        masked = "".join(t for r, t in rows if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        assert (read[conv].n_turns, read[conv].turns_sha256) == (len(rows), digest)
        assert (read[conv].loss_chars, read[conv].loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
        text = out[conv].formatted
        spans = [(text[s.start - 2], text[s.start : s.start + s.length], text[s.start + s.length :]) for s in out[conv].loss]
        codes = {"\\\\": "\\", "\\h": "#", "\\l": "<"}
        undone = [re.sub(r"\\[\\hl]", lambda m: codes[m[0]], s) if mark == "!" else s for mark, s, _ in spans]
        assert undone == [t for r, t in rows if r == "assistant"] and all(rest.startswith("</turn>") for *_, rest in spans)
        assert out[conv].formatted.count("</turn>") == len(rows)
    assert chatformat.format_chats(turns.limit(0)).count() == 0
    moved = formatted.withColumn("loss", F.transform("loss", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"])))
    assert all(r.loss_sha256 != read[r.conv_id].loss_sha256 for r in chatformat.read_back(moved).collect() if read[r.conv_id].loss_chars)


# 3 Simple-8b


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300) | st.integers(0, 60000), max_size=200), st.lists(st.integers(0, 200), max_size=4))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(values, cuts):
    ends = np.array(sorted({min(c, len(values)) for c in cuts} | {len(values)}))
    words, escapes, stops = simple8b.encode(np.array(values, np.uint64), ends)
    assert simple8b.decode(words, escapes).tolist() == values
    at = 0
    for a, b, stop in zip([0, *ends[:-1]], ends, stops):
        assert simple8b.decode(words[at:stop], escapes).tolist() == values[a:b]
        at = stop


def test_block_round_trip():
    values = [[5], [2**63, 7, 2**61], [], [1] * 100]
    docs = []
    for doc, v in zip([None, -4, -4, 9], values):
        words, escapes, _ = simple8b.encode(np.array(v, np.uint64))
        docs.append((doc, len(v), words.tobytes(), escapes.tobytes()))
    ids, sizes, got = simple8b.read_block(simple8b.block_payload(docs))
    assert ids == [None, -4, -4, 9] and sizes.tolist() == [len(v) for v in values] and got.tolist() == sum(values, [])


def test_token_files(docs, nothing, monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_IDS", 500)
    rows = simple8b.round_trip(docs, WORD).collect()
    ids = sorted(((IDS[i] is not None, IDS[i] or 0), x) for i, x in enumerate(token_ids(WORD)))
    got = sorted(rows, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in ids]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((k[1], len(x), crc(x)) for k, x in ids)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert simple8b.round_trip(nothing, WORD).count() == 0


# 4 substring dedup


def test_repeated_windows(docs, nothing, monkeypatch):
    monkeypatch.setattr(superkmer, "CHUNK_BYTES", 4000)
    big, split = 1 << 62, [plain_words(t) for t in TEXTS]
    ids = [big if i is None else i for i in IDS]
    least = {}
    for i, words in zip(ids, split):
        for a in range(len(words) - 12):
            key = tuple(words[a : a + 13])
            least[key] = min(i, least.get(key, big))
    want = []
    for i, words in zip(ids, split):
        gone = {k for a in range(len(words) - 12) if least[tuple(words[a : a + 13])] < i for k in range(a, a + 13)}
        want.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = superkmer.remove_repeats(docs).select("row.*", "n_words", "n_removed", "kept").toDF(*docs.columns, "w", "r", "k").collect()
    assert sorted((big if r.doc_id is None else r.doc_id, r.w, r.r, r.k) for r in got) == sorted(want)
    assert superkmer.remove_repeats(nothing).count() == 0


# 5 licenses


def test_rising_is_longest():
    rng = np.random.default_rng(5)
    for _ in range(50):
        values = rng.integers(0, 30, rng.integers(0, 9)).tolist()
        best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        picked = [values[i] for i in licenses.rising(values)]
        assert len(picked) == best and all(a < b for a, b in zip(picked, picked[1:]))


def test_patience_pairs_rise_and_match():
    text, template = "x released y under the mit license z".split(), "released under the mit license".split()
    pairs = licenses.patience(text, template)
    assert [text[i] for i, _ in pairs] == template and pairs == sorted(pairs)
    assert licenses.patience(list("aabb"), list("bbaa")) == []


def test_license_scan(docs, nothing, spark):
    found = {r.doc_id: [f.license for f in r.found] for r in licenses.scan(docs).collect()}
    assert found[29] == ["MIT-notice"] and found[30] == ["Apache-2.0-notice"] and not found[7] and not found[8]
    noisy = licenses.TEMPLATES["MIT"].replace("copies", "copys").replace("Software", "SOFTWARE\n *")
    rows = [(1, BASE + "\n" + noisy + "\n" + BASE), (2, licenses.TEMPLATES["MIT"][:300]), (3, prose(8, 900) + " " + licenses.TEMPLATES["GPL-3.0-header"])]
    got = {r.doc_id: r.found for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [f.license for f in got[1]] == ["MIT"] and got[1][0].coverage > 0.95 and got[1][0].start >= 300 and not got[2]
    assert [f.license for f in got[3]] == ["GPL-3.0-header"] and got[3][0].coverage == 1 and got[3][0].start == 900
    assert licenses.scan(nothing).count() == 0


def test_licenses_beyond_the_given_tables(spark):
    notices = {
        "Released under the BSD License.": ["BSD-notice"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-notice"],
        "Licensed under the Mozilla Public License, Version 2.0.": ["MPL-2.0-notice"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0-notice"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0-notice"],
        "This work is licensed under the GNU General Public License, version 3.1.": ["GPL-notice"],
        "Licensed under the Apache License, Version 1.1.": ["Apache-1.1-notice"],
        "Licensed under the Foo License, Version 2.0.": [],
        "Released under the MIT Press License.": [],
        "The MIT License is short.": [],
        "SPDX-License-Identifier: MIT-0": ["MIT-0-notice"],
        "SPDX-License-Identifier: AGPL-3.0-or-later": ["AGPL-3.0-notice"],
    }
    rows = [(i, f"{prose(i, 30)} {text}\n{prose(i + 50, 30)}") for i, text in enumerate(notices)]
    rows.append((100, "foo Released under the MIT License. Released under the MIT License. " + prose(9, 20) + " Released under the MIT License."))
    names = sorted(licenses.TEMPLATES)
    rows += [(200 + i, prose(i, 100) + "\n" + licenses.TEMPLATES[n] + "\n" + prose(i + 60, 90) + "\n" + licenses.TEMPLATES[n]) for i, n in enumerate(names)]
    got = {r.doc_id: r.found for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [[f.license for f in got[i]] for i in range(len(notices))] == list(notices.values())
    assert [(f.license, [(p.start, p.end) for p in f.places]) for f in got[100]] == [("MIT-notice", [(1, 6), (6, 11), (31, 36)])]
    assert [[f.license for f in got[200 + i]] for i in range(len(names))] == [[n] for n in names]
    assert all(len(got[200 + i][0].places) == 2 and got[200 + i][0].places[0].start == 100 for i in range(len(names)))


# 6 language


def test_presence_is_the_set_of_grams():
    data, offsets = flat(pa.array(["ÉTÉ  été", "", "a b"]))
    got = langid.presence(data, offsets)
    one = langid.presence(*flat(pa.array(["été été"])))
    assert (got[0] == one[0]).all() and not got[1].any() and got[2].sum() == len({"a", " ", "b", "a ", " b", "a b"})


def test_language(docs, nothing, spark):
    words = {"xa": "lo mi ra tu ven sol".split(), "xb": "krag dorn oft wex ulm bin".split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[l], 30)), l) for i, l in enumerate(["xa", "xb"] * 60)] + [(900, None, "xa"), (901, "12 3!", "xb"), (902, "", None), (None, "krag dorn", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = langid.predict(table, langid.train(table)).select("row.*", "held_out", "lang_pred", "score").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == (r.lang or "xb")
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.lang_pred for r in langid.predict(docs.drop("lang"), langid.train(nothing)).collect()} == {"und"}
    assert langid.keep_known(docs).columns == docs.columns and langid.keep_known(nothing).count() == 0


# 7 sharding


@pytest.mark.parametrize("ranges", [1, 40])
def test_shards(docs, nothing, spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "OVERFULL", 3 / ranges)
    out = sharding.place(docs, 4).collect()
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in out) == sorted(
        (i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(IDS, TEXTS))
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots))) and 0 <= shard < 4
    assert sharding.place(nothing).count() == 0


def test_shards_are_even_with_a_hot_text(spark):
    rows = [(i, "the same text again" * 3 if i % 3 == 0 else prose(i, 12)) for i in range(3000)]
    out = sharding.place(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)


def test_written_shards(spark, tmp_path):
    table = spark.createDataFrame([(i, prose(i, 5)) for i in range(100)], "doc_id bigint, text string")
    sharding.write_shards(table, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


# 8 Jaccard join


def jaccard_of(table, **more):
    big = 1 << 62
    value = lambda x: big if x is None else x
    return sorted((value(r.doc_id), r.n_shingles, value(r.component_id)) for r in jaccard.near_duplicates(table, **more).collect())


def test_jaccard_join(docs, nothing, monkeypatch):
    monkeypatch.setattr(superkmer, "CHUNK_BYTES", 5000)
    rows = list(zip(IDS, TEXTS))
    for n, percent in ((4, 85), (5, 80)):
        assert jaccard_of(docs, shingle=n, threshold=percent) == brute_components(rows, n, percent)
    assert jaccard.near_duplicates(nothing).count() == 0
    assert jaccard.one_of_each(docs).columns == docs.columns


def variants():
    """Groups of copies with 0 to 6 changed words each, chains of them, and a passage that all share."""
    rng = np.random.default_rng(11)
    rows = []
    for group in range(6):
        text = prose(100 + group, 90) + " " + " ".join(COMMON)
        for k in range(12):
            text = near(text, rng.integers(0, 100, rng.integers(0, 3)).tolist()) if k % 2 else near(prose(100 + group, 90) + " " + " ".join(COMMON), rng.integers(0, 100, rng.integers(0, 7)).tolist())
            rows.append((group * 100 + k, text))
    return rows


@pytest.mark.parametrize("most", [4_000_000, 900])
def test_jaccard_regions_are_exact_at_any_size(spark, most):
    rows = variants()
    table = stored(spark.createDataFrame(rows, "doc_id bigint, text string"), "variants")
    assert jaccard_of(table, most=most) == brute_components(rows, 4, 85)


def test_region_that_does_not_shrink(spark):
    rows = variants()[:12]
    sets = {i: np.sort(np.array([zlib.crc32(" ".join(s).encode()) for s in shingles(t, 4)], np.uint64)) for i, t in rows}
    table = spark.createDataFrame([("r", str(i).encode(), v.tobytes()) for i, v in sets.items()], "region string, key binary, members binary")
    sizes = spark.createDataFrame([("r", sum(map(len, sets.values())), 12)], "region string, tokens bigint, sets bigint")
    links = jaccard.region_links(table, sizes, 85, most=600, parent=12).collect()
    root = {i: i for i in sets}
    for a, b in ((int(r.a), int(r.b)) for r in links):
        root = {k: root[b] if v == root[a] else v for k, v in root.items()}
    least = {r: min(i for i in root if root[i] == r) for r in set(root.values())}
    assert sorted((i, len(sets[i]), least[root[i]]) for i in sets) == brute_components(rows, 4, 85)


def test_crowded_region_goes_to_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rows = variants()
    table = stored(spark.createDataFrame(rows, "doc_id bigint, text string"), "variants")
    assert jaccard_of(table, most=900) == brute_components(rows, 4, 85)


def test_crowded_region_of_few_blocks_is_not_copied_to_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_cells", None)
    rows = variants()
    table = stored(spark.createDataFrame(rows, "doc_id bigint, text string"), "variants")
    assert jaccard_of(table, most=900) == brute_components(rows, 4, 85)


def test_cells_are_sent_in_small_batches(monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_BYTES", 1000)
    whole = [np.arange(k, k + 100, dtype=np.uint64).tobytes() for k in range(50)]
    sent = type("Sent", (), {"value": {"r": [(b"0", whole[0]), (b"9", whole[9])]}})
    keys = [str(k).encode() for k in range(50)]
    out = list(jaccard._cells(sent, 85)(iter([pa.record_batch([["r"] * 50, keys, whole], names=["region", "key", "members"])])))
    assert max(b.num_rows for b in out) <= 3
    got = {(r["region"], r["key"]) for b in out for r in b.to_pylist()}
    assert {k for _, k in got} == set(keys) and ("r.1", b"0") not in got


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 9), (20, 20), (30, 31), (31, 32), (40, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 40: 2, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30, 32: 30}


# 9 exact dedup


def test_cuckoo_filter_grows_and_forgets():
    bucket, digests = cuckoo.Bucket(), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, d in enumerate(digests):
        bucket.add(d, i, 1)
        bucket.add(d, i + 5, 1)
    assert bucket.resizes and all(bucket.find(d) == [i, 2] for i, d in enumerate(digests))
    for d in digests[:2500]:
        bucket.remove(d, 2)
    assert not any(bucket.find(d) for d in digests[:2500]) and all(bucket.find(d) for d in digests[2500:])
    assert bucket.filter.size == 2500


def test_exact_dedup(docs, nothing):
    groups = defaultdict(list)
    for i, t in zip(IDS, TEXTS):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i or 0, keep or 0, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = [(r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, bytes(r.digest).hex()) for r in cuckoo.dedup(docs, 3).collect()]
    assert sorted(got) == sorted(want)
    assert cuckoo.dedup(nothing).count() == 0
    kept = cuckoo.first_of_equal(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in want)


def test_filter_stages_keep_one_row_of_each_group(spark):
    near_base, other = near(BASE, [10]), prose(70, 200)
    rows = [
        (1, BASE, "a"), (1, BASE, "b"), (2, BASE, "c"), (None, BASE, "d"), (1, other, "e"), (None, near_base, "f"), (None, near_base, "g"),
        (5, prose(71, 100), "h"), (5, prose(72, 100), "i"), (5, near(prose(72, 100), [50]), "j"), (None, prose(73, 80), "k"), (None, prose(73, 80), "l"),
        (3, near(BASE, [20]), "m"), (3, prose(74, 120), "n"), (None, "", "o"), (None, " ", "p"),
    ]
    table = stored(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "repeats")
    kept = [r.source for r in cuckoo.one_of_equal(table).collect()]
    texts = {s: re.sub(r"\s+", " ", t) for _, t, s in rows}
    assert sorted(texts[s] for s in kept) == sorted(set(texts.values()))
    assert {"a", "e", "f", "h", "i", "j", "k", "m", "n"} <= set(kept)
    left = [r.source for r in jaccard.one_of_each(table, 5, 80).collect()]
    assert {s for s in left if s not in "op" and s not in "ij"} == {"a", "e", "h", "k", "n"} and len({"i", "j"} & set(left)) == 1
    assert len(left) == len(set(left)) and {"o", "p"} <= set(left)
    assert cuckoo.one_of_equal(table).columns == jaccard.one_of_each(table).columns == table.columns


def test_index_changes(spark):
    rows = lambda pairs: cuckoo.digests(spark.createDataFrame(pairs, "doc_id bigint, text string"))
    first = stored(cuckoo.build(rows([(1, "a"), (2, "b"), (3, "a")]), 2), "index")
    second = cuckoo.build(rows([(0, "c"), (9, "b")]), 2, first, rows([(2, "b"), (1, "a"), (3, "a")]))
    name = {hashlib.sha256(t.encode()).digest(): t for t in "abc"}
    assert sorted((name[bytes(r.digest)], r.keep_id, r.group_size) for r in second.collect()) == [("b", 2, 1), ("c", 0, 1)]


# 10 decontamination


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_decontamination(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(winnow, "BLOCK_WORDS", block)
    items = [(1, " ".join(COMMON)), (2, " ".join(BASE.split()[100:113])), (3, "one two three"), (4, None), (5, "..."), (None, "one"), (1, "日本語"), (7, " ".join(BASE.split()[105:140]))]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, doc_id int")
    windows = defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        for a in range(max(1, len(words) - 12) if words else 0):
            windows[tuple(words[a : a + 13])].add("null" if item is None else str(item))
    want = []
    for i, text in zip(IDS, TEXTS):
        words, hit, found = alnum_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                if names := windows.get(tuple(words[a : a + size])):
                    found |= names
                    hit |= set(range(a, a + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i or 0, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    got = [(r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in winnow.contamination(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    cleaned = winnow.clean(docs, bench)
    assert cleaned.columns == docs.columns and cleaned.count() == sum(not w[-1] for w in want)
    assert winnow.contamination(nothing, bench).count() == 0
    assert not any(r.contaminated for r in winnow.contamination(docs, bench.limit(0)).collect())


def test_piece_table_finds_what_it_holds():
    known, rng = tokens.Known(), np.random.default_rng(11)
    hashes = np.unique(rng.integers(1, 1 << 63, 70_000).astype(np.uint64) >> np.uint64(20) << np.uint64(20))  # crowded slots
    held = {}
    for part in np.array_split(rng.permutation(hashes), 7):
        assert (known.find(part) == -1).all()
        ids = [int(h).to_bytes(8, "little") * (int(h) % 3) for h in part]
        for h, ref, x in zip(part.tolist(), known.add(part, np.ones(len(part), np.int64), part, ids).tolist(), ids):
            held[h] = (ref, x)
    for h, ref in zip(hashes.tolist(), known.find(hashes).tolist()):
        assert held[h] == (ref, known.ids[known.place[ref] : known.place[ref + 1]].tobytes())


@pytest.mark.parametrize("path, style", [(BYTE, tokens.LEADING), (WORD, tokens.BARE)])
def test_ids_do_not_depend_on_the_cache(path, style, monkeypatch):
    texts = [*TEXTS, " a  b ", "\n\n", " \t x", "tail \n", "<|endoftext|> x", "a" * 5000, "don't can't", "x" * 8 + "y", "x" * 8 + "z"]
    tokenizer = Tokenizer.from_file(path)
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = tokens.Encoder(path, style)
    assert encoder.texts(texts) == want == encoder.texts(texts)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    assert [encoder.texts([t])[0] for t in texts] == want
    monkeypatch.setattr(Words, "hashes", lambda self, start, end: (end - start).astype(np.uint64) % np.uint64(5))  # nearly all agree
    assert tokens.Encoder(path, style).texts(texts) == want


def test_training_sample_is_bounded_with_null_and_repeated_ids(spark):
    rows = [(None, "the same text of many copies", "en")] * 400 + [(7, f"texte {i} de la ville", "fr") for i in range(300)] + [(None, f"der Text {i} und mehr", "de") for i in range(300)]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4), "copies")
    held = {r.lang: r["count"] for r in langid.drawn(docs, langid.different(docs), 50).groupBy("lang").count().collect()}
    assert held == {"en": 50, "fr": 50, "de": 50}
    found = langid.predict(docs, langid.train(docs, 100, 20)).groupBy("row.lang", "lang_pred").count().collect()
    right = sum(r["count"] for r in found if r["lang"] == r["lang_pred"])
    assert right >= 600


def test_language_filter_wants_languages_and_a_score(docs, spark):
    many = spark.createDataFrame([(i, t, l) for i in range(40) for t, l in ((f"the text of number {i} and more", "en"), (f"le texte {i} de la ville", "fr"))], "doc_id bigint, text string, lang string")
    english = langid.keep_known(many, ["en"])
    assert {r.lang for r in english.collect()} == {"en"} and english.count() == 40
    assert langid.keep_known(many, least=0.0).count() == 80 and langid.keep_known(many, least=1.1).count() == 0


def test_dropped_rows_take_one_plan(docs, spark):
    plan = cuckoo.one_of_equal(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    plan = jaccard.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
