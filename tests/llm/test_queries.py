"""Every query of this folder on empty tables, on tables with nulls in every column, repeated rows and columns more, and against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from engine.llm.queries import QUERIES, SQL

FOLDER = Path("/root/testdata/sf0.001")
TABLES = ["source_records", "parse_issues", "chunks", "chunk_vectors", "retrieval_results", "engine_inventory", "documents", "benchmark_cases", "name_lexicon"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dirty")
    clash = ["n", "path", "block", "place", "walk", "reason", "host", "gram", "x", "run", "ids", "shard", "score_"]
    for t in TABLES:
        rows = spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(30)
        nulls = rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        rows = rows.unionByName(rows.limit(5)).unionByName(nulls)
        rows.withColumns({c: F.lit("clash") for c in clash if c not in rows.columns}).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_nulls_copies_and_clashing_columns(spark, dirty, name):
    assert QUERIES[name](spark, dirty).collect() is not None


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = db.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    show = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    key = lambda row: tuple(map(str, row))
    ours = QUERIES[name](spark, str(FOLDER))
    assert sorted(ours.columns) == sorted(names)
    assert sorted((tuple(map(show, r)) for r in ours.select(*names).collect()), key=key) == sorted((tuple(map(show, r)) for r in cursor.fetchall()), key=key)
