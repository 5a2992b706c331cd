"""Embedding of texts by any encoder, with a cache; and the vector table with its manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engine.operators.index import misses

BATCH = 16


def hashing_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """A deterministic encoder without a model: words hashed into `size` numbers."""
    import xxhash

    out = np.zeros((len(texts), size), np.float32)
    for i, x in enumerate(texts):
        for w in x.lower().split():
            h = xxhash.xxh64_intdigest(w)
            out[i, h % size] += 1 if h >> 63 else -1
    return out


def matrix_of(value: object, n: int) -> np.ndarray:
    """What an encoder gave as n rows of finite float32 numbers."""
    m = np.asarray(value, np.float32)
    if m.ndim != 2 or len(m) != n or not np.isfinite(m).all():
        raise ValueError(f"an encoder must give {n} rows of finite numbers")
    return m


def embed(texts: DataFrame, encoder: Callable[[list[str]], object] = hashing_encoder, cache: DataFrame | None = None, normalize: bool = True, batch: int = BATCH) -> DataFrame:
    """text_sha, vector of texts (text), each text once and none that the cache (text_sha) holds; blank texts are an error. Zero vectors stay zero."""
    checked = F.when(F.trim("text") == "", F.raise_error(F.lit("a text to embed is blank"))).otherwise(F.col("text"))
    wanted = texts.where("text is not null").select(checked.alias("text")).withColumn("text_sha", F.sha2("text", 256))
    todo = misses(wanted, cache) if cache is not None else wanted.dropDuplicates(["text_sha"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                m = matrix_of(encoder(part["text"].tolist()), len(part))
                if normalize:
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
                yield pd.DataFrame({"text_sha": part["text_sha"], "vector": list(m)})

    return todo.select("text", "text_sha").mapInPandas(run, "text_sha string, vector array<float>")


def attach(chunks: DataFrame, vectors: DataFrame, text: str = "content") -> DataFrame:
    """Chunks with the vector of their text."""
    return chunks.withColumn("text_sha", F.sha2(text, 256)).join(vectors, "text_sha").drop("text_sha")


def manifest(vectors: DataFrame, model: str) -> DataFrame:
    """records, dimensions and model of a vector table."""
    return vectors.agg(F.count("*").alias("records"), F.sort_array(F.collect_set(F.size("vector"))).alias("dimensions")).withColumn("model", F.lit(model))
