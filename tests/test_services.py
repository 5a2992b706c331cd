import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from engine.api import FIELDS, Index
from engine.operators import assets, crawl, embedding, retrieval
from engine.operators.chunking import Limits


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [("c1", "Door opens the wide gate", "ADoor::Open", "ADoor", "Open"), ("c2", "the gate is a class", "ADoor", "ADoor", None), ("c3", "gate gate gate and a door", None, None, None), ("c4", "nothing", None, None, None), ("c5", "  ", None, None, None)]
    full = [dict.fromkeys(FIELDS) | {"id": i, "content": c, "symbol": s, "class_name": k, "function_name": f, "module": "M" if i < "c3" else "N"} for i, c, s, k, f in rows]
    frame = spark.createDataFrame([tuple(x[f] for f in FIELDS) for x in full], ", ".join(f"{f} string" for f in FIELDS))
    own = Index(spark, f"{tmp_path_factory.mktemp('index')}")
    own.build(frame)
    own.build(frame)
    with pytest.raises(ValueError):
        own.build(frame.union(frame))
    return own


def ids(rows):
    return [r.chunk_id for r in rows.orderBy("place").collect()]


def test_modes(spark, index):
    asked = spark.createDataFrame([(1, "gate")], "query_id long, text string")
    assert index.chunks().count() == 4 and index.vectors().count() == 4
    assert set(ids(index.search(asked))) == {"c1", "c2", "c3"}
    assert ids(index.search(asked, filters={"module": "N"})) == ["c3"]
    symbol = spark.createDataFrame([(1, "adoor")], "query_id long, text string")
    assert ids(index.search(symbol, "symbol")) == ["c2", "c1"] and ids(index.search(symbol, "symbol", 1)) == ["c2"]
    assert ids(index.search(asked, "dense", 1)) == ["c3"]
    for mode in ("hybrid", "rerank"):
        assert set(ids(index.search(asked, mode, 3))) <= {"c1", "c2", "c3", "c4"} and len(ids(index.search(asked, mode, 3))) == 3
    for bad in ({"mode": "x"}, {"limit": 0}, {"filters": {"color": "red"}}, {"mode": "hybrid", "filters": {"class_name": "ADoor"}}):
        with pytest.raises(ValueError):
            index.search(asked, **bad)
    with pytest.raises(ValueError):
        retrieval.check_query("  ", 1)


def test_fusion_of_a_key_that_comes_twice(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id long, key string, rank int")
    out = {r.key: r for r in retrieval.fuse(rows((1, "a", 1), (1, "a", 4), (1, "b", 2)), rows((1, "b", 1))).collect()}
    assert out["a"].dense_rank == 4 and out["a"].sparse_rank is None and abs(out["a"].fusion - (1 / 61 + 1 / 64)) < 1e-9
    assert out["b"].place == 1 or out["b"].fusion <= out["a"].fusion


def test_metrics_by_hand(spark):
    cases = spark.createDataFrame([(1, "x", ["A", "B"]), (2, "y", ["C"])], "case_id long, category string, expected array<string>")
    results = spark.createDataFrame([(1, 1, ["Z"]), (1, 2, ["A", "A"]), (1, 3, ["A"]), (1, 4, ["B"])], "case_id long, place int, names array<string>")
    out = {r.case_id: r for r in retrieval.metrics(results, cases).collect()}
    assert (out[1].hit_1, out[1].hit_3, out[1].recall_5, out[1].mrr) == (0, 1, 1, 0.5)
    assert abs(out[1].ndcg - (1 / np.log2(3) + 1 / np.log2(5)) / (1 + 1 / np.log2(3))) < 1e-9
    assert out[2].ndcg == out[2].mrr == out[2].hit_10 == 0
    mean = retrieval.averages(retrieval.metrics(results, cases))
    assert mean.count() == 3 and {r.metric: r.passed for r in retrieval.baseline(mean, {"mrr": 0.25, "hit_1": 0.1}).collect()} == {"mrr": True, "hit_1": False}
    with pytest.raises(ValueError):
        retrieval.baseline(mean, {"other": 1.0})


def test_dense_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    v = np.random.default_rng(1).normal(size=(40, 8))
    v[5] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    for metric, value in (("cosine", lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else 0), ("dot", lambda a, b: a @ b), ("euclid", lambda a, b: -np.linalg.norm(a - b))):
        out = retrieval.dense(rows.where("id % 5 = 0").withColumnRenamed("id", "query_id"), rows, 8, 4, metric).collect()
        for q in range(0, 40, 5):
            want = sorted((-round(float(value(v[q], v[i])), 9), i) for i in range(40) if i != q)[:4]
            assert [r.id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.place)] == [i for _, i in want]
    assert retrieval.dense(rows.limit(0).withColumnRenamed("id", "query_id"), rows, 8).count() == 0


def test_embedding_and_cache(spark):
    calls = []
    texts = spark.createDataFrame([("door gate",), ("door gate",), ("c",), (None,)], "text string")
    first = embedding.embed(texts)
    assert first.count() == 2 and embedding.embed(texts, cache=first).count() == 0
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in first.collect()) and not calls
    assert embedding.manifest(first, "hash").first().dimensions == [64]
    assert embedding.attach(spark.createDataFrame([("1", "c")], "id string, content string"), first).count() == 1
    with pytest.raises(ValueError):
        embedding.matrix_of([[1.0, float("nan")]], 1)
    with pytest.raises(Exception, match="blank"):
        embedding.embed(spark.createDataFrame([(" ",)], "text string")).collect()


def test_asset_views(spark):
    graph = json.dumps({"name": "Main", "nodes": [1], "edges": ["a"]})
    rows = [("Door", "/G/Door", None, [graph], [json.dumps({"name": "Open", "b": 1, "a": 2})], ['{"z": 1, "a": 2}', "raw"], [])]
    frame = spark.createDataFrame(rows, "name string, path string, parent_class string, graphs array<string>, functions array<string>, variables array<string>, components array<string>")
    out = {r.view: r for r in assets.views(frame, "5").collect()}
    assert out.keys() == {"summary", "graph", "function", "variables"} and "Graphs: 1" in out["summary"].content
    assert out["graph"].content == '{"links": ["a"], "name": "Main", "nodes": [1]}' and out["variables"].content == 'Variables:\n{"a": 2, "z": 1}\nraw'
    assert assets.views(frame, "5", "None").where("view = 'graph'").count() == 0
    parts = assets.view_chunks("a b c\n" * 20, "graph", "H", Limits(0, 10, 12, 2))
    assert len(parts) > 1 and all(x.startswith("H\n") for *_, x in parts) and len(assets.view_chunks("a b c\n" * 20, "summary", "H", Limits(0, 10, 12, 2))) == 1


def test_crawl(spark):
    site = [("https://s.example/a", '<a href="/b">b</a><a href="#x">x</a><a href="mailto:y">y</a>'), ("https://s.example/b", '<a href="c#top">c</a><a href="/a">a</a><a href="https://other.example/">o</a>'), ("https://s.example/c", '<a href="/d">d</a>')]
    seeds = spark.createDataFrame([("https://s.example/a", "t"), ("https://s.example/a", "t")], "url string, topic string")
    keep = lambda df: df.where(F.col("url").startswith("https://s.example/"))
    out = {r.url[-1]: r.depth for r in crawl.crawl(seeds, crawl.page_table(spark, site), keep, 2).collect()}
    assert out == {"a": 0, "b": 1, "c": 2}
    rules = crawl.robots_rules("User-agent: *\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: bot\nDisallow:\n", "spider")
    assert not crawl.allowed(rules, "https://s.example/x/1") and crawl.allowed(rules, "https://s.example/x/ok/2") and crawl.allowed(rules, "https://s.example/")
    assert crawl.allowed(crawl.robots_rules("User-agent: *\nDisallow: /\nUser-agent: bot\nDisallow:", "mybot"), "https://s.example/q")
    answers, waits = [(503, {"Retry-After": "90"}, ""), (500, {}, ""), (200, {}, "page")], []
    assert crawl.fetch(lambda u: answers.pop(0), "u", sleep=waits.append) == "page" and waits == [60.0, 2.0]
    for status in (404, 500):
        with pytest.raises(OSError):
            crawl.fetch(lambda u, s=status: (s, {}, ""), "u", sleep=waits.append)
    assert crawl.page_path("u").count("/") == 1
