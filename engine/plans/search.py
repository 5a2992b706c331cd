"""Queries of retrieval and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.partitions import spread
from engine.functions.text import index_tokens
from engine.functions.vectors import finite, l2_normalize, norm
from engine.operators import retrieval as r
from engine.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each chunk."""
    rows = table(spark, d, "chunks").select("id", "run_id", "delivered_at", "content", "symbol", "class_name", "function_name", "source_type")
    return rows.groupBy("id").agg(F.max(F.struct("run_id", "delivered_at", "content", "symbol", "class_name", "function_name", "source_type")).alias("x")).select("id", "x.content", "x.symbol", "x.class_name", "x.function_name", "x.source_type")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The names that the held-out items expect."""
    return table(spark, d, "benchmark_cases").select(F.col("item_id").alias("query_id"), F.explode("expected_symbols").alias("text")).where("text <> ''")


def terms(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("query_id", F.explode(index_tokens("text")).alias("term"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text"))


PLAIN = "translate(regexp_replace(lower({}), '[\\x{{300}}-\\x{{36f}}]', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
WORDS = "list_filter(string_split_regex(" + PLAIN + ", '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
CHUNKS = """
one AS (SELECT id, x.content AS content, x.symbol AS symbol, x.class_name AS class_name, x.function_name AS function_name, x.source_type AS source_type FROM (
  SELECT id, arg_max(struct_pack(content := content, symbol := symbol, class_name := class_name, function_name := function_name, source_type := source_type),
    (run_id, delivered_at, coalesce(content, ''), coalesce(symbol, ''), coalesce(class_name, ''), coalesce(function_name, ''), coalesce(source_type, ''))) AS x FROM chunks GROUP BY id)),
asked AS (SELECT item_id AS query_id, s AS text FROM (SELECT item_id, unnest(expected_symbols) AS s FROM benchmark_cases) WHERE s <> '')
"""
ALIAS = """,
alias AS (SELECT id AS chunk_id, lower(n) AS alias, symbol, class_name FROM (SELECT id, symbol, class_name, unnest([symbol, class_name, function_name]) AS n FROM one) WHERE n IS NOT NULL),
exact AS (SELECT query_id, chunk_id, min(CASE WHEN lower(symbol) = alias THEN 0 WHEN lower(class_name) = alias THEN 1 ELSE 2 END) AS match FROM asked JOIN alias ON lower(text) = alias GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match, chunk_id) AS place FROM exact QUALIFY place <= 10)
"""


def bm25_sql(source: str, terms_sql: str, keep: str = "", limit: int = 10, prefix: str = "") -> str:
    """CTEs whose last is {prefix}found: query_id, id, score, place; source: id, text."""
    p = prefix
    return f"""
{p}docs AS (SELECT id, {WORDS.format("text")} AS w FROM ({source})),
{p}totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {p}docs),
{p}terms AS (SELECT DISTINCT query_id, term FROM ({terms_sql})),
{p}hits AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM {p}docs) WHERE term IN (SELECT term FROM {p}terms) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}hits GROUP BY term),
{p}idf AS (SELECT term, mean, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM {p}df, {p}totals),
{p}scored AS (SELECT query_id, id, count(*) AS have, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 10) AS score FROM {p}hits JOIN {p}idf USING (term) JOIN {p}terms USING (term) GROUP BY ALL),
{p}found AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS place FROM {p}scored JOIN (SELECT query_id, count(*) AS need FROM {p}terms GROUP BY query_id) USING (query_id)
  WHERE have = need {keep} QUALIFY place <= {limit})"""


DOCS = "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"
TERMS = f"SELECT query_id, unnest({WORDS.format('text')}) AS term FROM (SELECT item_id AS query_id, unnest(expected_symbols) AS text FROM benchmark_cases) WHERE text <> ''"
FIRST = f"SELECT query_id, min(term) AS term FROM ({TERMS}) GROUP BY query_id"


@query("WITH " + CHUNKS + ALIAS + "SELECT query_id, chunk_id, match FROM exact")
def alias_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    return r.by_alias(asked(spark, d), chunks(spark, d), 2**31 - 1).select("query_id", "chunk_id", "match")


@query("WITH " + CHUNKS + ALIAS + "SELECT query_id, chunk_id, place::INT AS place, (101 - place)::INT AS score FROM ranked")
def symbol_priority_rank(spark: SparkSession, d: str) -> DataFrame:
    return r.by_alias(asked(spark, d), chunks(spark, d)).select("query_id", "chunk_id", "place", "score")


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY term")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return r.postings(documents(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query("WITH " + bm25_sql(DOCS, FIRST) + " SELECT query_id, id AS doc_id, score, place::INT AS place FROM found")
def bm25_single_term(spark: SparkSession, d: str) -> DataFrame:
    one = terms(spark, d).groupBy("query_id").agg(F.min("term").alias("term"))
    return r.bm25(one, documents(spark, d)).withColumnRenamed("id", "doc_id")


@query("WITH " + bm25_sql(DOCS, TERMS) + " SELECT query_id, id AS doc_id, score, place::INT AS place FROM found")
def bm25_and_terms(spark: SparkSession, d: str) -> DataFrame:
    return r.bm25(terms(spark, d), documents(spark, d)).withColumnRenamed("id", "doc_id")


@query("WITH " + bm25_sql(DOCS, FIRST, "AND id IN (SELECT doc_id FROM documents WHERE lang = 'en')") + " SELECT query_id, id AS doc_id, score, place::INT AS place FROM found")
def filtered_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The filter holds after matching; counts are of all documents."""
    one = terms(spark, d).groupBy("query_id").agg(F.min("term").alias("term"))
    keep = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return r.bm25(one, documents(spark, d), keep=keep).withColumnRenamed("id", "doc_id")


@query(f"""
WITH q AS (SELECT item_id AS query_id, ' ' || array_to_string({WORDS.format("reference_text")}[1:6], ' ') || ' ' AS phrase FROM benchmark_cases WHERE len({WORDS.format("reference_text")}) >= 6),
t AS (SELECT doc_id, ' ' || array_to_string({WORDS.format("text")}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT query_id, doc_id FROM q JOIN t ON contains(t, phrase)
""")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the first six words of an item's reference."""
    words = index_tokens("reference_text")
    asked = table(spark, d, "benchmark_cases").where(F.size(words) >= 6).select(F.col("item_id").alias("query_id"), F.slice(words, 1, 6).alias("phrase"))
    return r.phrases(asked, documents(spark, d), 6).withColumnRenamed("id", "doc_id")


FILL = "WITH " + CHUNKS + ALIAS + "," + bm25_sql("SELECT id, content AS text FROM one WHERE content IS NOT NULL", TERMS, limit=20) + """,
filled AS (SELECT query_id, chunk_id, origin, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM (
  SELECT query_id, chunk_id, 'exact' AS origin, place AS n FROM ranked UNION ALL
  SELECT query_id, id, 'lexical', place + 10 FROM found WHERE (query_id, id) NOT IN (SELECT (query_id, chunk_id) FROM ranked)) QUALIFY place <= 10)
"""


def filled(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d)
    texts = rows.where("content is not null").select("id", F.col("content").alias("text"))
    return r.exact_then_lexical(r.by_alias(asked(spark, d), rows), r.bm25(terms(spark, d), texts, 20).withColumnRenamed("id", "chunk_id"))


@query(FILL + "SELECT query_id, chunk_id, origin, place::INT AS place FROM filled")
def exact_then_lexical_fill(spark: SparkSession, d: str) -> DataFrame:
    return filled(spark, d)


USABLE = "len(vector) = 128 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0"


def dense_sql(value: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, vector::DOUBLE[] AS x FROM chunk_vectors WHERE {USABLE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round({value}, 9) AS value FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, round(value, 6) AS value, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, vec_id)::INT AS place FROM s QUALIFY place <= 10
"""


def dense(spark: SparkSession, d: str, metric: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query against all."""
    corpus = table(spark, d, "chunk_vectors").where(finite("vector", 128)).select(F.col("vec_id").alias("id"), "vector")
    found = r.dense(corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id"), corpus, 128, metric=metric)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("value", 6).alias("value"), "place")


@query(dense_sql("coalesce(list_dot_product(q.x, v.x) / nullif(sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x)), 0), 0)"))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d, "cosine")


@query(dense_sql("list_dot_product(q.x, v.x)"))
def dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d, "dot")


@query(dense_sql("-list_distance(q.x, v.x)"))
def euclid_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d, "euclid")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.x, v.x), 9) AS value FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.label = 3 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, round(value, 6) AS value, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, vec_id)::INT AS place FROM s QUALIFY place <= 10
""")
def filtered_dense(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = r.dense(rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rows.where("label = 3"), 64)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("value", 6).alias("value"), "place")


@query(f"""
SELECT vec_id, round(n, 5) AS norm, round(CASE WHEN n > 0 THEN x[1] / n ELSE 0 END, 6) AS first, round(CASE WHEN n > 0 THEN list_sum(list_transform(x, lambda e: abs(e))) / n ELSE 0 END, 5) AS total
FROM (SELECT vec_id, vector::DOUBLE[] AS x, sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS n FROM chunk_vectors WHERE {USABLE})
""")
def l2_normalize_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_vectors").where(finite("vector", 128)).select("vec_id", norm("vector").alias("n"), l2_normalize("vector").alias("u"))
    return rows.select("vec_id", F.round("n", 5).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("total"))


RESULTS = "rows AS (SELECT DISTINCT query_id, chunk_id, dense_rank, sparse_rank FROM retrieval_results)"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retrieval_results").select("query_id", "chunk_id", "dense_rank", "sparse_rank").distinct()


def fused(spark: SparkSession, d: str, dense_k: int, sparse_k: int) -> DataFrame:
    rows = ranked(spark, d)
    side = lambda c, k: rows.where(F.col(c) <= k).select("query_id", F.col("chunk_id").alias("key"), F.col(c).alias("rank"))
    return r.fuse(side("dense_rank", dense_k), side("sparse_rank", sparse_k))


def fuse_sql(dense_k: int, sparse_k: int) -> str:
    return f"""WITH {RESULTS}, two AS (SELECT query_id, chunk_id, dense_rank AS d, NULL AS s FROM rows WHERE dense_rank <= {dense_k} UNION ALL SELECT query_id, chunk_id, NULL, sparse_rank FROM rows WHERE sparse_rank <= {sparse_k}),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + coalesce(d, s))), 12) AS fusion, max(d)::INT AS dense_rank, max(s)::INT AS sparse_rank FROM two GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, chunk_id)::INT AS place FROM fused QUALIFY place <= 30)"""


@query(fuse_sql(2**31 - 1, 2**31 - 1) + "SELECT * FROM top")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, 2**31 - 1, 2**31 - 1).withColumnRenamed("key", "chunk_id")


@query(fuse_sql(30, 30) + "SELECT * FROM top")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 of either list, fused."""
    return fused(spark, d, r.DENSE_K, r.SPARSE_K).withColumnRenamed("key", "chunk_id")


@query(fuse_sql(30, 30) + f""", c AS (SELECT query_id, chunk_id, list_distinct({WORDS.format("content")}) AS w FROM (SELECT query_id, chunk_id, max(content) AS content FROM retrieval_results WHERE content IS NOT NULL GROUP BY ALL)),
p AS (SELECT query_id, list_distinct({WORDS.format("content")}) AS probe FROM (SELECT query_id, arg_min(content, (place, content)) AS content FROM top JOIN (SELECT query_id, chunk_id, max(content) AS content FROM retrieval_results WHERE content IS NOT NULL GROUP BY ALL) USING (query_id, chunk_id) GROUP BY query_id))
SELECT query_id, chunk_id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id, top.place)::INT AS place FROM (
  SELECT query_id, chunk_id, place, round(len(list_intersect(w, probe)) / greatest(len(w), 1), 9) AS rerank FROM top JOIN c USING (query_id, chunk_id) JOIN p USING (query_id)) AS top QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id, top.place) <= 8
""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates by the share of their words that the first one has too."""
    texts = table(spark, d, "retrieval_results").where("content is not null").groupBy("query_id", F.col("chunk_id").alias("key")).agg(F.max("content").alias("content"))
    rows = fused(spark, d, r.DENSE_K, r.SPARSE_K).join(texts, ["query_id", "key"]).withColumn("w", F.array_distinct(index_tokens("content")))
    probe = F.first("w").over(Window.partitionBy("query_id").orderBy("place"))
    rows = rows.withColumn("probe", probe)
    share = F.round(F.size(F.array_intersect("w", "probe")) / F.greatest(F.size("w"), F.lit(1)), 9)
    return r.rerank(rows, share).select("query_id", F.col("key").alias("chunk_id"), "rerank", "place")


CASES = FILL + """, cases AS (SELECT item_id AS case_id, category, list_distinct(list_filter(expected_symbols, lambda x: x <> '')) AS expected FROM benchmark_cases),
named AS (SELECT query_id AS case_id, place, unnest([symbol, class_name, function_name]) AS name FROM filled JOIN one ON one.id = filled.chunk_id),
first AS (SELECT w.case_id, w.name, min(place) AS pos FROM (SELECT case_id, unnest(expected) AS name FROM cases) w JOIN named USING (case_id, name) GROUP BY ALL),
figures AS (SELECT case_id, category, CASE WHEN coalesce(min(pos), 99) <= 1 THEN 1.0 ELSE 0 END AS hit_1, CASE WHEN coalesce(min(pos), 99) <= 3 THEN 1.0 ELSE 0 END AS hit_3,
  CASE WHEN coalesce(min(pos), 99) <= 5 THEN 1.0 ELSE 0 END AS hit_5, CASE WHEN coalesce(min(pos), 99) <= 10 THEN 1.0 ELSE 0 END AS hit_10,
  count(*) FILTER (pos <= 5) / any_value(len(expected)) AS recall_5, count(*) FILTER (pos <= 10) / any_value(len(expected)) AS recall_10, coalesce(1.0 / min(pos), 0) AS mrr,
  coalesce(list_sum(list_transform(list_distinct(list(pos) FILTER (pos IS NOT NULL)), lambda x: 1 / log2(x + 1))), 0) / list_sum(list_transform(range(1, least(any_value(len(expected)), 10) + 1), lambda x: 1 / log2(x + 1))) AS ndcg
  FROM cases LEFT JOIN first USING (case_id) WHERE len(expected) > 0 GROUP BY ALL)
"""
MEANS = ", ".join(f"round(avg({c}), 9) AS {c}" for c in r.FIGURES)


def figures(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "benchmark_cases").select(F.col("item_id").alias("case_id"), "category", F.array_distinct(F.filter("expected_symbols", lambda x: x != "")).alias("expected")).where(F.size("expected") > 0)
    names = chunks(spark, d).select(F.col("id").alias("chunk_id"), F.array_compact(F.array("symbol", "class_name", "function_name")).alias("names"))
    results = filled(spark, d).join(names, "chunk_id").withColumnRenamed("query_id", "case_id")
    return r.metrics(results, cases)


@query(CASES + "SELECT case_id, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg, round(recall_10, 9) AS recall_10 FROM figures")
def ndcg_newly_matched(spark: SparkSession, d: str) -> DataFrame:
    return figures(spark, d).select("case_id", *[F.round(c, 9).alias(c) for c in ("mrr", "ndcg", "recall_10")])


@query(CASES + f"SELECT 'all' AS category, {MEANS} FROM figures")
def metrics_overall(spark: SparkSession, d: str) -> DataFrame:
    return r.averages(figures(spark, d)).where("category = 'all'")


@query(CASES + f"SELECT category, {MEANS} FROM figures WHERE category IS NOT NULL GROUP BY category")
def metrics_by_category(spark: SparkSession, d: str) -> DataFrame:
    return r.averages(figures(spark, d)).where("category <> 'all'")


LEAST = {"hit_1": 0.5, "mrr": 0.1, "ndcg": 0.99}


@query(CASES + "SELECT metric, value, least, value >= least AS passed FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, round(avg({k}), 9) AS value, {v}::DOUBLE AS least FROM figures" for k, v in LEAST.items()) + ")")
def baseline_check(spark: SparkSession, d: str) -> DataFrame:
    return r.baseline(r.averages(figures(spark, d)), LEAST)
