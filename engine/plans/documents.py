"""Queries of parsers, chunkers and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.text import token_count
from engine.operators import chunking, cpp, index, pages
from engine.operators.chunking import Limits, each_text
from engine.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    rows = table(spark, d, "source_records").where("content is not null")
    return (rows.where(F.col("source_type") == kind) if kind else rows).select("id", "content", F.coalesce("title", F.lit("")).alias("title")).distinct()


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    html = records(spark, d).where(F.col("content").rlike(r"(?i)</?(p|div|h[1-6]|ul|ol|li|table|pre|b|a|code|br)\b[^>]*>"))
    return each_text(html, "id", "content", lambda x: [(pages.title_of(pages.parse(x)), pages.markdown(x))], "page_title string, markdown string")


@query()
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return each_text(records(spark, d), "id", "content", lambda x: [(p,) for p in pages.heading_paths(x)], "headings array<string>")


@query()
def docs_sections(spark: SparkSession, d: str) -> DataFrame:
    return each_text(records(spark, d), "id", "content", lambda x: [(p, t) for p, t in chunking.sections(x, "")], "section_path array<string>, content string")


@query()
def docs_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections of at most 600 tokens, longer ones in parts with overlap."""
    return each_text(records(spark, d, "docs"), "id", "content", lambda x: [(i, *c) for i, c in enumerate(chunking.markdown_chunks(x, "", Limits()))], "chunk_index int, section_path array<string>, part int, parts int, content string")


TOKEN_SQL = r"'[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z_][A-Za-z_0-9]*|\p{Nd}+(?:\.\p{Nd}+)?|[^\p{Z}\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}]'"


@query(f"SELECT doc_id, i::INT AS part, least(200, n - i * 200)::INT AS tokens FROM (SELECT doc_id, n, unnest(range((n + 199) // 200)) AS i FROM (SELECT doc_id, len(regexp_extract_all(text, {TOKEN_SQL})) AS n FROM documents WHERE text IS NOT NULL))")
def chunk_token_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text")
    return each_text(rows, "doc_id", "text", lambda x: [(i, chunking.count(w)) for i, w in enumerate(chunking.windows(x, 200))], "part int, tokens int")


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, k, len(regexp_extract_all(line, {TOKEN_SQL})) AS n FROM l),
w AS (SELECT doc_id, k, n, 1 AS part, n AS have FROM c WHERE k = 1
  UNION ALL SELECT c.doc_id, c.k, c.n, CASE WHEN w.have + c.n > 100 THEN w.part + 1 ELSE w.part END, CASE WHEN w.have + c.n > 100 THEN c.n ELSE w.have + c.n END FROM w JOIN c ON c.doc_id = w.doc_id AND c.k = w.k + 1)
SELECT doc_id, part::INT AS part, count(*)::INT AS lines, sum(n)::INT AS tokens FROM w GROUP BY ALL
""")
def chunk_lines_packed(spark: SparkSession, d: str) -> DataFrame:
    """Whole lines packed to at most 100 tokens by a fold of built-in functions."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    counts = rows.select("doc_id", F.transform("lines", token_count).alias("n"))
    empty = "struct(cast(array() as array<struct<lines:int,tokens:int>>) as done, 0 as lines, 0 as tokens)"
    step = """(a, n) -> if(a.lines > 0 and a.tokens + n > 100,
        struct(array_append(a.done, struct(a.lines as lines, a.tokens as tokens)) as done, 1 as lines, n as tokens),
        struct(a.done as done, a.lines + 1 as lines, a.tokens + n as tokens))"""
    parts = F.expr(f"aggregate(n, {empty}, {step}, a -> array_append(a.done, struct(a.lines as lines, a.tokens as tokens)))")
    return counts.select("doc_id", F.posexplode(parts).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("part"), "p.lines", "p.tokens")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("content is not null and source_type like '%source'").select("id", "content").distinct()


@query()
def cpp_symbols(spark: SparkSession, d: str) -> DataFrame:
    return each_text(sources(spark, d), "id", "content", cpp.symbol_rows, cpp.SYMBOL_FIELDS)


@query()
def cpp_chunks(spark: SparkSession, d: str) -> DataFrame:
    return each_text(sources(spark, d), "id", "content", cpp.symbol_chunks, cpp.CHUNK_FIELDS)


def version(spark: SparkSession, d: str, least: int, most: int) -> DataFrame:
    rows = table(spark, d, "chunks").where(F.col("run_id").between(least, most))
    last = F.max(F.struct("run_id", "delivered_at", F.lower(F.coalesce("content_sha256", F.sha2("content", 256))).alias("sha"), "file_path", "module")).alias("x")
    return rows.groupBy("id").agg(last).select("id", "x.sha", "x.file_path", "x.module")


VERSIONS = """
WITH last AS (SELECT id, run_id > 5 AS late, arg_max(struct_pack(sha := sha, file_path := file_path, module := module), (run_id, delivered_at, coalesce(sha, ''), coalesce(file_path, ''), coalesce(module, ''))) AS x
  FROM (SELECT *, lower(coalesce(content_sha256, sha256(content))) AS sha FROM chunks) GROUP BY ALL),
a AS (SELECT id, x.sha AS sha, x.file_path AS file_path, x.module AS module FROM last WHERE NOT late), b AS (SELECT id, x.sha AS sha, x.file_path AS file_path, x.module AS module FROM last WHERE late)
"""


@query(VERSIONS + """
SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL OR a.sha IS NOT DISTINCT FROM b.sha AND a.id IS NOT NULL THEN a.sha ELSE b.sha END AS sha,
  CASE WHEN b.id IS NULL THEN 'kept' WHEN a.id IS NULL THEN 'added' WHEN a.sha IS NOT DISTINCT FROM b.sha THEN 'skipped' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.id = b.id
""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of later runs merged into those of earlier ones."""
    merged, actions = index.upsert(version(spark, d, 1, 5), version(spark, d, 6, 10**6), "id", "sha")
    return merged.join(actions, "id", "left").select("id", "sha", F.coalesce("action", F.lit("kept")).alias("action"))


@query(VERSIONS + "SELECT id, sha, file_path FROM a WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM b WHERE file_path IS NOT NULL) UNION ALL SELECT id, sha, file_path FROM b WHERE file_path IS NOT NULL")
def replace_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Files of later runs take the place of all their earlier chunks."""
    new = version(spark, d, 6, 10**6).where("file_path is not null")
    return index.replace_by_path(version(spark, d, 1, 5), new, new.select("file_path"))[0].select("id", "sha", "file_path")


@query(VERSIONS + "SELECT id, sha, module FROM a WHERE (module = (SELECT min(module) FROM chunks)) IS NOT TRUE")
def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    module = table(spark, d, "chunks").agg(F.min("module")).first()[0]
    return index.delete(version(spark, d, 1, 5), filters={"module": module}).select("id", "sha", "module")


@query(r"""
WITH p AS (SELECT DISTINCT metadata::JSON ->> '$.url' AS url, metadata::JSON ->> '$.topic' AS topic FROM source_records WHERE metadata::JSON ->> '$.url' IS NOT NULL)
SELECT url, min(topic) AS topic, 1 AS depth FROM p WHERE url NOT IN (SELECT regexp_replace(url, '([?#].*|/)$', '') FROM parse_issues WHERE url IS NOT NULL) GROUP BY url
""")
def frontier_expand(spark: SparkSession, d: str) -> DataFrame:
    """Pages that no issue names, each once, as the next step of a crawl."""
    links = table(spark, d, "source_records").select(F.get_json_object("metadata", "$.url").alias("url"), F.get_json_object("metadata", "$.topic").alias("topic")).where("url is not null").distinct()
    seen = table(spark, d, "parse_issues").where("url is not null").select(F.regexp_replace("url", r"([?#].*|/)$", "").alias("url"))
    return pages.frontier(links, seen, 0)
