"""Table functions for SQL users, and caller-supplied batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.chunking import cut_windows


def register_table_functions(spark: SparkSession) -> None:
    """``SELECT * FROM docs, LATERAL split_windows(docs.text, 1600, 200)``."""

    class SplitWindows:
        def eval(self, text: str, size: int, overlap: int):
            for part, chunk in enumerate(cut_windows(text or "", size, overlap)):
                yield part, chunk

    spark.udtf.register("split_windows", F.udtf(SplitWindows, returnType="part int, chunk string"))


def embed(df: DataFrame, embed_fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str, passage: str, out: str = "vec") -> DataFrame:
    """Vectors from an outside model: batches of (key, passage) in, batches of (key, vector) out."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, passage).mapInPandas(embed_fn, f"{key} {kind}, {out} array<float>")


def extract(df: DataFrame, extract_fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str, passage: str) -> DataFrame:
    """Raw model text per passage, to be read by ``parse.parse_triples``."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, passage).mapInPandas(extract_fn, f"{key} {kind}, raw string")
