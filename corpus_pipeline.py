"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

A stage works on every row that its predecessor kept. All but the last return the columns of ``documents``:
language identification drops texts without a language, exact dedup keeps the first of equal texts, the Jaccard join keeps
one document of each group of near copies, decontamination drops documents with benchmark passages, and packing returns one row for each
piece of a document in a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantlens.llm import cuckoo, jaccard, langid, packing, winnow
from plantlens.llm.components import stored
from plantlens.llm.queries import tokenizer_file

ORACLE_SQL = None  # tokenizers and the trained classifier are beyond SQL; tests/llm compares run() with a brute-force version


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled rows teach."""
    return langid.keep_known(docs)


def first_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each text; of repeated rows one."""
    return cuckoo.one_of_equal(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of five-word shingle sets with a Jaccard similarity of 0.8 or more, the document with the smallest id of each linked group."""
    return jaccard.one_of_each(docs, shingle=5, threshold=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a passage of the benchmark."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", first_of_equal),
    ("near_dedup", one_of_near),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between them lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir.rstrip("/")), f"pipeline-{name}")
    return docs
