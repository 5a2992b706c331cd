"""An index built from chunks, and one function for all modes of retrieval over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.text import index_tokens, query_tokens
from engine.operators import retrieval as r
from engine.operators.embedding import attach, embed, hashing_encoder
from engine.sources.files import write_staged

FIELDS = ["id", "document_id", "content", "title", "engine_version", "source_scope", "source_type", "module", "plugin", "file_path", "symbol", "class_name", "function_name"]


@dataclass
class Index:
    """Tables below a folder: chunks and vectors."""

    spark: SparkSession
    folder: str
    encoder: Callable[[list[str]], object] = hashing_encoder

    def build(self, chunks: DataFrame) -> None:
        """Replaces the index; an id that comes twice is an error."""
        from engine.sources.files import unique_across

        rows = unique_across(chunks.select(*FIELDS), "id").where("trim(content) <> ''")
        write_staged(rows, f"{self.folder}/chunks")
        rows = self.chunks()
        write_staged(attach(rows.select("id", "content"), embed(rows.select(F.col("content").alias("text")), self.encoder)).select("id", "vector"), f"{self.folder}/vectors")

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/chunks")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")

    def search(self, queries: DataFrame, mode: str = "lexical", limit: int = 10, filters: dict[str, str] | None = None) -> DataFrame:
        """query_id, chunk_id, place and the chunk's fields for queries (query_id BIGINT, text), by `symbol`, `lexical`, `dense`, `hybrid` or `rerank`."""
        if mode not in ("symbol", "lexical", "dense", "hybrid", "rerank"):
            raise ValueError(f"unknown mode: {mode}")
        if limit < 1:
            raise ValueError("the limit must be 1 or more")
        whole = self.chunks()
        chunks = r.where_equal(whole, filters, r.LEXICAL_FILTERS if mode in ("symbol", "lexical") else r.DENSE_FILTERS)
        if mode == "symbol":
            found = r.by_alias(queries, chunks, limit)
        elif mode == "lexical":
            found = r.exact_then_lexical(r.by_alias(queries, chunks, limit), self._bm25(queries, whole, chunks, 2 * limit), limit)
        elif mode == "dense":
            found = self._dense(queries, chunks, limit)
        else:
            side = lambda df: df.select("query_id", F.col("chunk_id").alias("key"), F.col("place").alias("rank"))
            sparse = r.exact_then_lexical(r.by_alias(queries, chunks, r.SPARSE_K), self._bm25(queries, whole, chunks, 2 * r.SPARSE_K), r.SPARSE_K)
            fused = r.fuse(side(self._dense(queries, chunks, r.DENSE_K)), side(sparse))
            if mode == "rerank":
                texts = fused.join(chunks.select(F.col("id").alias("key"), "content"), "key").join(queries.select("query_id", "text"), "query_id")
                words = F.array_distinct(index_tokens("text"))
                fused = r.rerank(texts, F.size(F.array_intersect(words, index_tokens("content"))) / F.greatest(F.size(words), F.lit(1)), limit)
            found = fused.where(F.col("place") <= limit).withColumnRenamed("key", "chunk_id")
        return found.select("query_id", "chunk_id", "place").join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")

    def _bm25(self, queries: DataFrame, whole: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
        terms = queries.select("query_id", F.explode(F.flatten(F.transform(query_tokens("text"), index_tokens))).alias("term"))
        found = r.bm25(terms, whole.select("id", F.col("content").alias("text")), limit, keep=chunks.select("id"))
        return found.withColumnRenamed("id", "chunk_id")

    def _dense(self, queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
        numbers = self.vectors().join(chunks.select("id"), "id").select(F.xxhash64("id").alias("n"), "id", "vector")
        size = numbers.select(F.size("vector")).first()
        asked = attach(queries.select("query_id", F.col("text").alias("content")), embed(queries.select("text"), self.encoder))
        # ids of vectors are numbers: those of chunks are a hash of their id
        found = r.dense(asked.select("query_id", "vector"), numbers.select(F.col("n").alias("id"), "vector"), size[0] if size else 1, limit)
        return found.join(numbers.select(F.col("n").alias("id"), F.col("id").alias("chunk_id")), "id").select("query_id", "chunk_id", "place")
