"""The registered queries over the smallest tables: SQL twins, and brute force where there is none."""

import zlib
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from brute import alnum_words, brute_components, plain_words
from check import compare
from tokenizers import Tokenizer

import corpus_pipeline
from plantlens.llm import langid, queries, registry
from plantlens.session import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, coalesce(text, ''), lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, con, name):
    line, good = compare(spark, con, name, SimpleNamespace(run=registry.QUERIES[name], sql=registry.SQL[name]), SF_DIR)
    assert good, line


def ids_of(docs, name):
    tokenizer = Tokenizer.from_file(queries.tokenizer_file(name))
    return {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t, *_ in docs}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(rows, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for doc, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[doc]), crc(ids[doc][at : at + r.length]))
            at += r.length
        assert at == len(ids[doc])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, ids.values())) > 0.97 * 2048 * (len(sequences) - 1)


def test_op1(spark, docs):
    check_pieces(registry.QUERIES["op1_pack"](spark, SF_DIR).collect(), ids_of(docs, "byte_bpe_50k.json"))


def test_op3(spark, docs):
    start, want = 0, []
    for doc, ids in sorted(ids_of(docs, "word_bpe_49k.json").items()):
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, registry.QUERIES["op3_token_files"](spark, SF_DIR).collect())) == want


def test_op5(spark, docs):
    found = {r.doc_id: r.licenses for r in registry.QUERIES["op5_license_scan"](spark, SF_DIR).collect()}
    marks = {"MIT-notice": "the mit license", "GPL-3.0-notice": "gnu general public license", "CC-BY-NC-4.0-notice": "cc by-nc", "Apache-2.0-notice": "apache license"}
    assert found == {d: ",".join(n for n in sorted(marks) if marks[n] in t.lower()) for d, t, _ in docs}


def test_op6(spark, docs):
    rows = registry.QUERIES["op6_language_id"](spark, SF_DIR).collect()
    lang = {d: l for d, _, l in docs}
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op7(spark, docs):
    rows = registry.QUERIES["op7_shard"](spark, SF_DIR).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == [(d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, _ in docs]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r["size"]
    mean, largest = sum(sizes.values()) / 16, max(r["size"] for r in rows)
    assert sizes.keys() == set(range(16)) and all(abs(s - mean) <= largest for s in sizes.values())


def test_pipeline(spark, con, docs):
    """Every stage by brute force; what the classifier says is read from its own query."""
    said = {r.doc_id: r for r in registry.QUERIES["op6_language_id"](spark, SF_DIR).collect()}
    kept = [(d, t) for d, t, _ in docs if said[d].lang_pred != "und" and said[d].score >= langid.LEAST]
    first = {}
    for d, t in kept:
        key = " ".join(plain_words("x" + t + "x"))
        first.setdefault(key, (d, t))
    kept = sorted(first.values())
    kept = [row for row, (d, _, least) in zip(kept, brute_components(kept, 5, 80)) if d == least]
    windows = set()
    for (text,) in con.execute("SELECT text FROM benchmark").fetchall():
        words = alnum_words(text)
        windows |= {tuple(words[a : a + 13]) for a in range(max(1, len(words) - 12) if words else 0)}
    sizes, clean = {len(w) for w in windows}, []
    for d, t in kept:
        words, hit = alnum_words(t), set()
        for size in sizes:
            hit |= {k for a in range(len(words) - size + 1) if tuple(words[a : a + size]) in windows for k in range(a, a + size)}
        if not hit or 20 * len(hit) < len(words):
            clean.append((d, t))
    assert len(clean) < len(kept) < len(docs)
    check_pieces(corpus_pipeline.run(spark, SF_DIR).collect(), ids_of(clean, "byte_bpe_50k.json"))
