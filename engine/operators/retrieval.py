"""Retrieval of batches of queries: by alias, by BM25, by phrase, by vectors, fused and reranked. Queries and results are DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engine.functions.text import index_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, DENSE_K, SPARSE_K, FUSION_K, RERANK_K = 60, 30, 30, 30, 8
#: Queries held against a partition at a time.
QUERY_BLOCK = 4096
LEXICAL_FILTERS = {"engine_version", "source_type", "module", "plugin", "class_name", "symbol", "source_scope"}
DENSE_FILTERS = LEXICAL_FILTERS - {"class_name"}


def where_equal(rows: DataFrame, filters: dict[str, str] | None, allowed: set[str]) -> DataFrame:
    """Rows that equal all filters; `class` means class_name; null filters don't count; unknown fields are an error."""
    filters = {("class_name" if k == "class" else k): v for k, v in (filters or {}).items() if v is not None}
    if unknown := filters.keys() - allowed:
        raise ValueError(f"unknown filter fields: {sorted(unknown)}")
    return reduce(lambda df, x: df.where(F.col(x[0]) == F.lit(x[1])), filters.items(), rows)


def check_query(query: str, limit: int) -> None:
    if not query.strip() or limit < 1:
        raise ValueError("a query needs text and a limit of 1 or more")


def top(rows: DataFrame, limit: int, *order: Column | str, key: str = "query_id", name: str = "place") -> DataFrame:
    """The first rows of each query with their place."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= limit)


def aliases(chunks: DataFrame) -> DataFrame:
    """alias, chunk_id: names of a chunk in lower case, each once."""
    names = F.array_compact(F.array("symbol", "class_name", "function_name"))
    return chunks.select(F.explode(F.transform(names, F.lower)).alias("alias"), F.col("id").alias("chunk_id")).distinct()


def by_alias(queries: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, chunk_id, match, place, score: queries (query_id, text) that equal a name; symbols before classes before others, then by id."""
    names = chunks.select(F.col("id").alias("chunk_id"), "symbol", "class_name")
    asked = queries.select("query_id", F.lower("text").alias("alias")).distinct()
    found = asked.join(aliases(chunks), "alias").join(names, "chunk_id")
    match = F.when(F.lower("symbol") == F.col("alias"), 0).when(F.lower("class_name") == F.col("alias"), 1).otherwise(2)
    best = found.withColumn("match", match).groupBy("query_id", "chunk_id").agg(F.min("match").alias("match"))
    return top(best, limit, "match", "chunk_id").withColumn("score", 101 - F.col("place"))


def postings(documents: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """id, term, tf, of documents (id, text); only of `terms` (term) if given, so that other words are never shuffled."""
    words = documents.select("id", F.explode(index_tokens("text")).alias("term"))
    if terms is not None:
        words = words.join(terms.select("term").distinct(), "term", "left_semi")
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, documents: DataFrame, limit: int = 10, keep: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, place: documents (id, text) that hold every term of a query (query_id, term).

    Counts and lengths are of all documents; `keep` (id) is applied after matching. The score is negated, so less is better; equal ones go by id.
    """
    asked = queries.select("query_id", "term").distinct()
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    sizes = documents.select("id", F.size(index_tokens("text")).alias("length"))
    whole = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = postings(documents, asked)
    counts = hits.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one row of totals
    weights = counts.crossJoin(F.broadcast(whole)).select("term", "mean", F.when(raw <= 0, LEAST_IDF).otherwise(raw).alias("idf"))
    scored = hits.join(sizes, "id").join(weights, "term").join(asked, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = scored.withColumn("part", part).groupBy("query_id", "id").agg(F.count("*").alias("have"), (-F.sum("part")).alias("score"))
    found = found.join(need, "query_id").where("have = need")
    if keep is not None:
        found = found.join(keep.select("id"), "id", "left_semi")
    return top(found.select("query_id", "id", F.round("score", 10).alias("score")), limit, "score", "id")


def phrases(queries: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """query_id, id: documents that hold the phrase (query_id, phrase: an array of `size` tokens) word for word, by a join on runs of words."""
    words = documents.select("id", index_tokens("text").alias("w")).where(F.size("w") >= size)
    runs = words.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("phrase"))
    asked = queries.select("query_id", F.array_join("phrase", " ").alias("phrase"))
    return runs.join(asked, "phrase").select("query_id", "id").distinct()


def exact_then_lexical(exact: DataFrame, lexical: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, chunk_id, origin, place: exact results first, then lexical ones (up to twice the limit) that aren't among them."""
    first = exact.select("query_id", "chunk_id", F.lit("exact").alias("origin"), F.col("place").alias("n"))
    rest = lexical.where(F.col("place") <= 2 * limit).select("query_id", "chunk_id", F.lit("lexical").alias("origin"), (F.col("place") + limit).alias("n"))
    both = first.unionByName(rest.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
    return top(both, limit, "n").drop("n")


def dense(queries: DataFrame, corpus: DataFrame, size: int, limit: int = 10, metric: str = "cosine") -> DataFrame:
    """query_id, id, value, place of corpus (id, vector) for queries (query_id, vector), all of `size` finite numbers; a row isn't its own neighbour.

    Queries go to the partitions in blocks of QUERY_BLOCK; each batch keeps the best of each query before anything is shuffled.
    """
    if metric not in ("cosine", "dot", "euclid"):
        raise ValueError(metric)
    spark = corpus.sparkSession
    out = []
    block: list = []

    def against(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        vectors = np.array([r[1] for r in rows], np.float64).reshape(-1, size)
        shared = spark.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            qn = np.sqrt((q * q).sum(axis=1))
            for batch in batches:
                own = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                s = q @ v.T
                vn = np.sqrt((v * v).sum(axis=1))
                if metric == "cosine":
                    n = qn[:, None] * vn[None]
                    s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
                elif metric == "euclid":
                    s = -np.sqrt(np.maximum(qn[:, None] ** 2 + vn[None] ** 2 - 2 * s, 0))
                s = np.where(ids[:, None] == own[None], -np.inf, s.round(9))
                k = min(limit, s.shape[1])
                least = np.partition(s, -k, axis=1)[:, -k] if k else np.zeros(len(s))
                r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))  # all equal to the last one stay
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(own[c]), pa.array(s[r, c])], names=["query_id", "id", "value"])

        return corpus.select("id", "vector").mapInArrow(run, "query_id long, id long, value double")

    for row in queries.select("query_id", "vector").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out.append(against(block))
            block = []
    if block or not out:
        out.append(against(block))
    return top(reduce(DataFrame.unionByName, out), limit, F.desc("value"), "id")


def fuse(dense_list: DataFrame, sparse_list: DataFrame, limit: int = FUSION_K, k: int = RRF_K) -> DataFrame:
    """query_id, key, fusion, dense_rank, sparse_rank, place of two lists (query_id, key, rank): reciprocal ranks add up for each occurrence; a key that comes twice keeps its last rank."""
    both = dense_list.select("query_id", "key", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")).unionByName(
        sparse_list.select("query_id", "key", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"))
    )
    term = 1 / (k + F.coalesce("dense_rank", "sparse_rank"))
    one = both.groupBy("query_id", "key").agg(F.round(F.sum(term), 12).alias("fusion"), F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"))
    return top(one, limit, F.desc("fusion"), "key")


def rerank(candidates: DataFrame, score: Column, limit: int = RERANK_K) -> DataFrame:
    """query_id, key, rerank, place: candidates (query_id, key, place) by any score, equal ones by key and former place."""
    return top(candidates.withColumn("rerank", score).withColumnRenamed("place", "before"), limit, F.desc("rerank"), "key", "before")


def metrics(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Of each case (case_id, category, expected) the figures of its results (case_id, place, names).

    A result counts for nDCG only if it matches something expected that no earlier one did; the ideal list has as many hits as are expected, ten at most.
    """
    wanted = cases.select("case_id", F.explode("expected").alias("name"))
    named = results.where("place <= 10").select("case_id", "place", F.explode("names").alias("name")).distinct()
    first = wanted.join(named, ["case_id", "name"]).groupBy("case_id", "name").agg(F.min("place").alias("at"))
    gains = first.groupBy("case_id").agg(F.sort_array(F.collect_set("at")).alias("new"), F.sort_array(F.collect_list("at")).alias("at"))
    rows = cases.select("case_id", "category", F.size("expected").alias("n")).join(gains, "case_id", "left")
    at = F.coalesce("at", F.array().cast("array<int>"))
    seen = lambda k: F.size(F.filter(at, lambda x: x <= k))
    hit = lambda k: (seen(k) > 0).cast("double")
    gain = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1.0))
    new = F.coalesce("new", F.array().cast("array<int>"))
    ideal = gain(F.sequence(F.lit(1), F.least("n", F.lit(10))))
    return rows.select(
        "case_id", "category", *[hit(k).alias(f"hit_{k}") for k in (1, 3, 5, 10)], *[(seen(k) / F.col("n")).alias(f"recall_{k}") for k in (5, 10)],
        F.when(F.size(at) > 0, 1 / F.element_at(at, 1)).otherwise(0.0).alias("mrr"), (gain(new) / ideal).alias("ndcg"),
    )


FIGURES = ["hit_1", "hit_3", "hit_5", "hit_10", "recall_5", "recall_10", "mrr", "ndcg"]


def averages(figures: DataFrame) -> DataFrame:
    """The mean of each figure over all cases (category `all`) and over those of each category."""
    sets = figures.rollup("category").agg(F.grouping("category").alias("_all"), *[F.round(F.avg(c), 9).alias(c) for c in FIGURES])
    return sets.withColumn("category", F.when(F.col("_all") == 1, "all").otherwise(F.col("category"))).drop("_all")


def baseline(averaged: DataFrame, least: dict[str, float]) -> DataFrame:
    """metric, value, least, passed of the figures over all cases; a metric that isn't known is an error."""
    if unknown := least.keys() - set(FIGURES):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    long = averaged.where("category = 'all'").unpivot([], FIGURES, "metric", "value")
    limits = averaged.sparkSession.createDataFrame(list(least.items()), "metric string, least double")
    return long.join(F.broadcast(limits), "metric").select("metric", "value", "least", (F.col("value") >= F.col("least")).alias("passed"))
