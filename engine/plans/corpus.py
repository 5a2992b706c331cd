"""Queries over texts, statistics, sets and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.text import allowed_url, canonical_url, clean_markdown, file_type, normalize_inline, token_count, uuid5
from engine.operators import statistics as stats
from engine.operators.incremental import diff_inventories, latest_inventory
from engine.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TOKEN_SQL = r"'[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z_][A-Za-z_0-9]*|\p{Nd}+(?:\.\p{Nd}+)?|[^\p{Z}\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}]'"


@query(f"SELECT doc_id, len(regexp_extract_all(text, {TOKEN_SQL}))::INT AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_count_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", token_count("text").alias("n_tokens"))


@query("SELECT doc_id, 'doc-' || sha256(text) AS content_id FROM documents WHERE text IS NOT NULL")
def content_sha256_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("doc-"), F.sha2("text", 256)).alias("content_id"))


@query(r"""
WITH h AS (SELECT vec_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunk_vectors WHERE chunk_id IS NOT NULL)
SELECT vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h
""")
def point_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").where("chunk_id is not null").select("vec_id", uuid5("chunk_id").alias("point_id"))


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '[\p{Z}\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}]+', ' ', 'g'))) AS inline_sha,
  sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A[ \t\n\x{0b}\f\r]+|[ \t\n\x{0b}\f\r]+\z', '', 'g')) AS block_sha
FROM documents WHERE text IS NOT NULL
""")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2(normalize_inline("text"), 256).alias("inline_sha"), F.sha2(clean_markdown("text"), 256).alias("block_sha"))


URLS = """SELECT DISTINCT url FROM (SELECT url FROM parse_issues WHERE url IS NOT NULL
  UNION ALL SELECT metadata::JSON ->> '$.url' FROM source_records WHERE metadata::JSON ->> '$.url' IS NOT NULL)"""


def urls(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "source_records").select(F.get_json_object("metadata", "$.url").alias("url"))
    return pages.unionByName(table(spark, d, "parse_issues").select("url")).where("url is not null").distinct()


@query(rf"""
WITH u AS (SELECT url, regexp_replace(replace(url, '\', '/'), '[?#].*$', '') AS b FROM ({URLS})),
p AS (SELECT url, lower(regexp_extract(b, '^[A-Za-z]+://([^/]*)', 1)) AS h, regexp_replace(regexp_replace(regexp_extract(b, '^[A-Za-z]+://[^/]*(.*)$', 1), '/{{2,}}', '/', 'g'), '/$', '') AS p FROM u)
SELECT url, 'https://' || h || CASE WHEN p = '' THEN '/' ELSE regexp_replace(p, '^/[a-z]{{2}}(/|$)', '/en\1') END || '?version=5.8' AS canonical FROM p
""")
def url_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("url", canonical_url("url", "5.8", "en").alias("canonical"))


@query(rf"""
SELECT url FROM ({URLS}) WHERE url LIKE 'https://%' AND lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) IN ('docs.larkspur-foundry.example', 'wiki.quarrykit.example')
  AND starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/en/') AND regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '(?i)SETTING-up|notes')
""")
def url_allowlist_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).where(allowed_url(F.col("url"), ["docs.larkspur-foundry.example", "WIKI.quarrykit.example"], ["/en/"], "SETTING-up|notes"))


@query(r"""
SELECT DISTINCT id, h AS href FROM (SELECT id, unnest(regexp_extract_all(content, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS h FROM source_records)
WHERE NOT regexp_matches(h, '^(#|mailto:|javascript:|tel:)')
""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("content", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1)))
    return table(spark, d, "source_records").select("id", found.alias("href")).where(~F.col("href").rlike("^(#|mailto:|javascript:|tel:)")).distinct()


@query(r"""
SELECT DISTINCT id, trim(regexp_replace(regexp_replace(CASE WHEN regexp_matches(content, '(?is)<h1\b[^>]*>.*?</h1>') THEN regexp_extract(content, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)
  ELSE split_part(regexp_extract(content, '(?is)<title\b[^>]*>(.*?)</title>', 1), '|', 1) END, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS page_title
FROM source_records WHERE regexp_matches(content, '(?is)<(h1|title)\b[^>]*>.*?</')
""")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    h1, title = F.regexp_extract("content", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), F.split_part(F.regexp_extract("content", r"(?is)<title\b[^>]*>(.*?)</title>", 1), F.lit("|"), F.lit(1))
    raw = F.when(F.col("content").rlike(r"(?is)<h1\b[^>]*>.*?</h1>"), h1).otherwise(title)
    rows = table(spark, d, "source_records").where(F.col("content").rlike(r"(?is)<(h1|title)\b[^>]*>.*?</"))
    return rows.select("id", F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]*>", ""), r"[ \t\r\n]+", " ")).alias("page_title")).distinct()


@query("""
SELECT count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents, coalesce(sum(length(content)), 0)::BIGINT AS n_chars, count(*) FILTER (symbol <> '') AS n_with_symbol FROM chunks
""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(table(spark, d, "chunks"))


@query(
    " UNION ALL ".join(
        f"(SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM chunks WHERE {c} <> '' GROUP BY {c} ORDER BY n DESC, value LIMIT 10)" for c in ("source_type", "module", "plugin", "symbol_type")
    )
)
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_groups(table(spark, d, "chunks"), ["source_type", "module", "plugin", "symbol_type"], 10)


@query("""
SELECT b.bucket, b.label, count(c.content) AS n FROM (VALUES (0, '< 500', 0, 500), (1, '500–1.5K', 500, 1500), (2, '1.5–3K', 1500, 3000), (3, '3–6K', 3000, 6000), (4, '≥ 6K', 6000, 2000000000)) b(bucket, label, lo, hi)
LEFT JOIN chunks c ON length(c.content) >= b.lo AND length(c.content) < b.hi GROUP BY ALL
""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_histogram(table(spark, d, "chunks"))


@query("""
SELECT engine_version, count(*) AS n_files, count(DISTINCT module) AS n_modules, count(DISTINCT plugin) AS n_plugins, sum(size)::BIGINT AS bytes,
  count(*) FILTER (t = 'header') AS header, count(*) FILTER (t = 'cpp') AS cpp, count(*) FILTER (t = 'inl') AS inl, count(*) FILTER (t = 'build_cs') AS build_cs
FROM (SELECT DISTINCT relative_path, module, plugin, engine_version, size,
  CASE WHEN lower(relative_path) LIKE '%.build.cs' THEN 'build_cs' WHEN lower(relative_path) LIKE '%.cpp' THEN 'cpp' WHEN lower(relative_path) LIKE '%.inl' THEN 'inl' WHEN lower(relative_path) LIKE '%.h' THEN 'header' END AS t
  FROM engine_inventory) GROUP BY engine_version
""")
def inventory_summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "engine_inventory").select("relative_path", "module", "plugin", "engine_version", "size").distinct()
    return stats.inventory_summary(files.withColumn("type", file_type("relative_path")))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""
SELECT run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY recorded_at DESC, status DESC) AS n FROM index_runs) WHERE n = 1 AND status = 'succeeded'
""")
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each key by time, and only then those of one status."""
    return stats.last_rows(table(spark, d, "index_runs"), ["run_id"], ["recorded_at", "status"]).where("status = 'succeeded'").select("run_id", "status")


DIFF = """
WITH f AS (SELECT run_id, replace(relative_path, '\\', '/') AS path, arg_max(lower(sha256), (recorded_at, lower(sha256))) AS sha FROM project_inventory GROUP BY ALL),
a AS (SELECT path, sha FROM f WHERE run_id = 1), b AS (SELECT path, sha FROM f WHERE run_id = (SELECT max(run_id) FROM f)),
diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.sha IS DISTINCT FROM b.sha THEN 'modified' ELSE 'unchanged' END AS kind
  FROM a FULL JOIN b ON a.path = b.path)
"""


@query(DIFF + "SELECT path, kind FROM diff")
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "project_inventory")
    last = files.agg(F.max("run_id")).first()[0]
    return diff_inventories(latest_inventory(files.where("run_id = 1")), latest_inventory(files.where(F.col("run_id") == last)))


@query(DIFF + "SELECT k.kind, count(diff.kind) AS n FROM (VALUES ('added'), ('modified'), ('deleted'), ('unchanged')) k(kind) LEFT JOIN diff ON diff.kind = k.kind GROUP BY k.kind")
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts_with_zero(inventory_diff(spark, d), "kind", ["added", "modified", "deleted", "unchanged"])


@query("""
WITH g AS (SELECT user_id, event_type, ts, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
  SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events))
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY ALL
""")
def run_length_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal types of a user, in order of time."""
    return stats.run_lengths(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
SELECT module, class_name, count(*) AS n, string_agg(symbol, ', ' ORDER BY symbol, id) AS members FROM (SELECT DISTINCT id, module, class_name, symbol FROM chunks WHERE class_name IS NOT NULL AND symbol IS NOT NULL) GROUP BY ALL
""")
def property_group_concat(spark: SparkSession, d: str) -> DataFrame:
    """The members of each class, in order."""
    rows = table(spark, d, "chunks").where("class_name is not null and symbol is not null").select("id", "module", "class_name", "symbol").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("symbol", "id")))
    return rows.groupBy("module", "class_name").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["symbol"]), ", ").alias("members"))


@query("""
SELECT id, document_id, chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id)::INT AS part, count(*) OVER (PARTITION BY document_id) AS parts
FROM (SELECT DISTINCT id, document_id, chunk_index FROM chunks WHERE document_id IS NOT NULL)
""")
def chunk_part_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("document_id is not null").select("id", "document_id", "chunk_index").distinct()
    own = Window.partitionBy("document_id")
    return rows.withColumns({"part": F.row_number().over(own.orderBy(F.asc_nulls_last("chunk_index"), "id")), "parts": F.count("*").over(own)})


@query("""
SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def interval_attach(spark: SparkSession, d: str) -> DataFrame:
    """The latest view at or before each purchase of the user."""
    events = table(spark, d, "events")
    return stats.attach_before(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", "ts", "event_id", "view_id").select("event_id", "user_id", "view_id")


@query("""
WITH roots AS (SELECT DISTINCT regexp_extract(p, '^(.*)/[^/]*$', 1) AS root, m FROM (SELECT replace(relative_path, '\\', '/') AS p, module AS m FROM engine_inventory WHERE lower(relative_path) LIKE '%.build.cs' AND module IS NOT NULL)),
f AS (SELECT DISTINCT replace(relative_path, '\\', '/') AS path FROM engine_inventory)
SELECT path, arg_max(m, (length(root), m)) AS module FROM f JOIN roots ON starts_with(path, root || '/') GROUP BY path
""")
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """The module of the deepest folder above a file that holds a build file."""
    files = table(spark, d, "engine_inventory").select(F.translate("relative_path", "\\", "/").alias("path"), "module")
    roots = files.where(F.lower("path").endswith(".build.cs") & F.col("module").isNotNull()).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("root"), "module").distinct()
    return stats.nearest_root(files.select("path").distinct(), roots)


@query("""
WITH one AS (SELECT document_id, chunk_index, arg_max(content, (run_id, delivered_at, id, content)) AS content FROM chunks WHERE document_id IS NOT NULL AND chunk_index IS NOT NULL AND content IS NOT NULL GROUP BY ALL)
SELECT document_id, count(*) AS turns, sha256(string_agg(content, chr(10) ORDER BY chunk_index)) AS context_sha FROM one GROUP BY document_id
""")
def conversation_context(spark: SparkSession, d: str) -> DataFrame:
    """The last contents of a document's chunks, in order, as one text."""
    rows = table(spark, d, "chunks").where("document_id is not null and chunk_index is not null and content is not null")
    one = rows.groupBy("document_id", "chunk_index").agg(F.max(F.struct("run_id", "delivered_at", "id", "content")).alias("x")).select("document_id", "chunk_index", "x.content")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n")
    return one.groupBy("document_id").agg(F.count("*").alias("turns"), F.sha2(text, 256).alias("context_sha"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events WHERE props::JSON ->> '$.k' IS NOT NULL")
def json_metadata_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k is not null")


@query("""
SELECT chunk_id, CASE WHEN in_results AND in_chunks THEN 'both' WHEN in_results THEN 'results' ELSE 'chunks' END AS found_in FROM (
  SELECT chunk_id, bool_or(r) AS in_results, bool_or(NOT r) AS in_chunks FROM (SELECT chunk_id, true AS r FROM retrieval_results UNION ALL SELECT id, false FROM chunks) GROUP BY chunk_id)
""")
def set_ops_ids(spark: SparkSession, d: str) -> DataFrame:
    """Of all chunk ids of two tables, which tables hold them: intersection and both differences in one pass."""
    both = table(spark, d, "retrieval_results").select("chunk_id", F.lit(True).alias("r")).unionAll(table(spark, d, "chunks").select("id", F.lit(False)))
    one = both.groupBy("chunk_id").agg(F.bool_or("r").alias("in_results"), F.bool_or(~F.col("r")).alias("in_chunks"))
    return one.select("chunk_id", F.when(F.col("in_results") & F.col("in_chunks"), "both").when(F.col("in_results"), "results").otherwise("chunks").alias("found_in"))


@query("""
WITH one AS (SELECT min(doc_id) AS doc_id, text, source, coalesce(lang, 'none') AS lang FROM documents WHERE length(trim(text)) BETWEEN 80 AND 20000 GROUP BY text, source, coalesce(lang, 'none'))
SELECT doc_id, source || ':' || lang AS stratum FROM one QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 5
""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to five texts of each source and language, in the order of a hash."""
    rows = table(spark, d, "documents").where("length(trim(text)) between 80 and 20000")
    one = rows.groupBy("text", "source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.min("doc_id").alias("doc_id"))
    return stats.stratified(one.select("doc_id", F.concat_ws(":", "source", "lang").alias("stratum")), "stratum", "doc_id", 5)


@query(r"""
SELECT item_id, list_sort(list_distinct(regexp_extract_all(query_text || ' ' || reference_text, '\b[AFU][A-Z][a-z]+[A-Z][A-Za-z]+\b'))) AS markers FROM benchmark_cases WHERE query_text || reference_text IS NOT NULL
""")
def case_marker_extract(spark: SparkSession, d: str) -> DataFrame:
    """The class names that an item's texts mention."""
    text = F.concat("query_text", F.lit(" "), "reference_text")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[AFU][A-Z][a-z]+[A-Z][A-Za-z]+\b"), F.lit(0))))
    return table(spark, d, "benchmark_cases").where(text.isNotNull()).select("item_id", found.alias("markers"))


@query("""
SELECT n_name, extract(year FROM o_orderdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def star_join_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
