import numpy as np
from pyspark.sql import functions as F

from engine.llm import fusion
from engine.llm.fusion import p6_found


def test_scale_and_outliers_do_not_weigh(spark, tmp_path):
    rows = [(1, "outlier", 1e9, 30, 30, 0.01), (1, "best", 3.0, 1, 1, 0.9), (1, "second", 2.0, 2, 2, 0.8), (1, "third", 1.0, 3, 3, 0.7), (1, "fourth", 0.5, 4, 4, 0.6), (1, "unfound", 0.1, None, None, None), *((1, f"rest{i}", 0.4 - i / 100, 10 + i, 10 + i, 0.05 - i / 1000) for i in range(12)), (2, "only", -5.0, None, 1, None)]
    spark.createDataFrame(rows + rows[:1] * 5, "query_id long, chunk_id string, score double, dense_rank int, sparse_rank int, fusion_score double").write.parquet(f"{tmp_path}/retrieval_results.parquet")
    assert {tuple(r) for r in p6_found(spark, str(tmp_path)).collect()} == {(1, "best"), (1, "second"), (1, "third"), (2, "only")}


def dense(values):
    """The walk by its whole matrix."""
    n, m = values.shape
    v = np.where(np.isnan(values), -np.inf, values)
    p = np.zeros((n, n))
    for s in range(m):
        for i in range(n):
            above = v[:, s] > v[i, s]
            p[i] += (above / above.sum() if above.any() else np.full(n, 1 / n)) / m
    x = np.full(n, 1 / n)
    for _ in range(fusion.STEPS):
        x = fusion.DAMPING * x @ p + (1 - fusion.DAMPING) / n
    return x


def test_walk_is_that_of_the_matrix():
    rng = np.random.default_rng(3)
    query = np.repeat([1, 2, 5, 9], [7, 1, 30, 4])
    values = rng.integers(0, 6, (len(query), 4)).astype(float)
    values[rng.random(values.shape) < 0.2] = np.nan
    walk = fusion.stationarity(query, values)
    for q in set(query.tolist()):
        assert np.allclose(walk[query == q], dense(values[query == q]), atol=1e-11)
        assert abs(walk[query == q].sum() - 1) < 1e-9


def test_large_queries_are_walked_alike(spark, monkeypatch):
    monkeypatch.setattr(fusion, "STEPS", 2)
    monkeypatch.setattr(fusion, "BUCKETS", 3)
    rng = np.random.default_rng(4)
    rows = [(q, f"c{i}", float(rng.integers(9)), int(rng.integers(1, 9)), None if rng.random() < 0.3 else int(rng.integers(1, 9)), float("nan") if rng.random() < 0.2 else float(rng.random())) for q, n in ((1, 25), (2, 3)) for i in range(n)]
    frame = spark.createDataFrame([*rows, *rows[:9], (None, "x", 1.0, 1, 1, 1.0)], "query_id long, chunk_id string, score double, dense_rank int, sparse_rank int, fusion_score double").withColumn("walk", F.lit("clash"))
    one = frame.where("query_id is not null").drop("walk").distinct().toPandas().sort_values(["query_id", "chunk_id"])
    values = np.stack([one["score"], -one["dense_rank"], -one["sparse_rank"], one["fusion_score"]], axis=1).astype(float)
    small = dict(zip(zip(one["query_id"], one["chunk_id"], strict=True), fusion.stationarity(one["query_id"].to_numpy(), values), strict=True))
    large = {(r.query_id, r.chunk_id): r.walk for r in fusion.rank_walk(frame, large=2).collect()}
    assert small.keys() == large.keys() and len(small) == 28
    assert all(abs(small[k] - large[k]) < 1e-12 for k in small)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "query_id long, chunk_id string, score double, dense_rank int, sparse_rank int, fusion_score double")
    assert fusion.best(fusion.rank_walk(frame)).count() == 0
