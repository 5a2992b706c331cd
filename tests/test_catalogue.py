"""Every query of the core on the smallest tables against its SQL, and on empty tables."""

import math
from pathlib import Path

import duckdb
import pytest

from engine.plans.catalogue import QUERIES, SQL

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for f in FOLDER.glob("*.parquet"):
        out.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return out


def shown(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.9g}"
    if isinstance(x, list):
        return str([shown(y) for y in x])
    return str(x.replace(tzinfo=None)) if hasattr(x, "tzinfo") else str(x)


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, db, name):
    cursor = db.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    ours = QUERIES[name](spark, str(FOLDER))
    assert sorted(ours.columns) == sorted(names)
    assert sorted(tuple(map(shown, r)) for r in ours.select(*names).collect()) == sorted(tuple(map(shown, r)) for r in cursor.fetchall())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in FOLDER.glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(f"{d}/{f.name}")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() is not None


def test_plans(spark):
    """Columns and filters reach the scan, nothing is multiplied out, and no row goes through a Python function of its own."""
    plan = lambda name: QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<content:string,document_id:string,symbol:string>" in plan("corpus_summary").replace("document_id:string,content:string", "content:string,document_id:string")
    for name in QUERIES:
        text = plan(name)
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text, name
    assert "PushedFilters: [IsNotNull" in plan("star_join_revenue")
