from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from engine.llm import neighbours


def test_every_pair_of_blocks_counts_and_bad_vectors_do_not(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(6, 128)), 15, axis=0) + 0.4 * rng.normal(size=(90, 128))
    v[7], v[8] = v[6] * 3, v[6] * 5
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    bad = [(900, None), (901, []), (902, [0.0] * 128), (903, [float("nan")] * 128), (904, rows[0][1][:127]), (905, [None, *rows[0][1][1:]])]
    spark.createDataFrame(rows + bad, "vec_id long, vector array<float>").write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(12)
    best = {i: sorted((-s[i, j], j) for j in range(90) if j != i and s[i, j] >= 0.72)[:10] for i in range(90)}
    expected = {(min(i, j), max(i, j)) for i, near in best.items() for _, j in near}
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    assert {tuple(r) for r in neighbours.p4_found(spark, str(tmp_path)).collect()} == expected


def test_bound_holds_and_recall_is_whole():
    rng = np.random.default_rng(5)
    v = neighbours.unit(np.repeat(rng.normal(size=(4, 128)), 500, axis=0) + 0.5 * rng.normal(size=(2000, 128)))
    turn = neighbours.rotation()
    assert np.allclose(turn @ turn.T, np.eye(128), atol=1e-5)
    direction = neighbours.leaders(v, 4)[0]
    codes = neighbours.Codes.of(v, direction, turn)
    assert codes.bits.shape == (2000, 16)
    q = v[::50]
    cos, error = codes.estimate(q, direction, turn)
    assert (np.abs(cos - q @ v.T) <= error).all()
    ids = np.arange(2000)
    r, other, c = neighbours.nearest(q, ids[::50], v, ids, codes, direction, turn, np.full(len(q), 0.72))
    s = (q @ v.T).round(12)
    s[np.arange(len(q)), ids[::50]] = -2
    truth = {(i, j) for i in range(len(q)) for j in np.lexsort((ids, -s[i]))[:10].tolist() if s[i, j] >= 0.72}
    assert set(zip(r.tolist(), other.tolist(), strict=True)) == truth


def test_no_usable_vector(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, [1.0], "y")], "vec_id long, vector array<float>, cell string")
    assert neighbours.similar(frame).count() == 0


def test_one_vector_and_copies(spark):
    x = [1.0] + [0.0] * 127
    one = spark.createDataFrame([(1, x, "extra")], "vec_id long, vector array<float>, block string")
    assert neighbours.similar(one).count() == 0
    copies = spark.createDataFrame([(i, x, "extra") for i in range(15)], "vec_id long, vector array<float>, block string")
    found = {(r.vec_id, r.other) for r in neighbours.similar(copies).collect()}
    assert found == {(i, j) for i in range(15) for j in [k for k in range(15) if k != i][:10]}


def test_batches_sent_on_stay_small_however_many_blocks():
    rng = np.random.default_rng(7)
    v = neighbours.unit(np.eye(128)[:1] + 0.01 * rng.normal(size=(512, 128))).astype(np.float32)
    index = neighbours.Index(np.eye(128, dtype=np.float32)[:1], neighbours.rotation(), np.array([[0, 0, 400, 0, 0.5]]))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(513, dtype=np.int32) * 128), pa.array(v.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(512)), vectors, pa.array(np.full(512, 0.72)), pa.array(np.zeros(512, np.int32))], names=["vec_id", "vector", "reach", "block"])
    sizes = [x.num_rows for x in neighbours.route(SimpleNamespace(value=index))([batch])]
    assert sum(sizes) == 512 * 399
    assert max(sizes) <= 10_000


def test_pool_and_split_cells_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(40, 128)), 4, axis=0) + 0.4 * rng.normal(size=(160, 128))
    v = np.concatenate([v, rng.normal(size=(1, 128)) + 0.1 * rng.normal(size=(60, 128))]).astype(np.float32)
    x = neighbours.unit(v)
    s = (x @ x.T).round(12)
    expected = {(i, j) for i in range(220) for _, j in sorted((-s[i, j], j) for j in range(220) if j != i and s[i, j] >= 0.72)[:10]}
    for name, value in {"CELLS": 3, "BLOCK": 15, "QUERIES": 12, "ROWS": 8, "TILE": 64}.items():
        monkeypatch.setattr(neighbours, name, value)
    index = neighbours.Index(neighbours.leaders(x, 3), neighbours.rotation())
    cell, _, _ = index.place(x)
    assert 0 < (cell == 3).sum() < 220
    found = neighbours.similar(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vector array<float>")).collect()
    assert {(r.vec_id, r.other) for r in found} == expected
    assert len(found) == len(expected)


def test_pairs_that_codes_leave_open_are_asked_by_floats(monkeypatch):
    rng = np.random.default_rng(4)
    v = neighbours.unit(rng.normal(size=(1, 128)) + 0.2 * rng.normal(size=(700, 128)))
    ids, turn = np.arange(700)[::-1].copy(), neighbours.rotation()
    direction = neighbours.leaders(v, 1)[0]
    monkeypatch.setattr(neighbours, "TILE", 70_000)
    r, other, _ = neighbours.nearest(v, ids, v, ids, neighbours.Codes.of(v, direction, turn), direction, turn, np.full(700, 0.72))
    s = (v @ v.T).round(12)
    np.fill_diagonal(s, -2)
    assert set(zip(r.tolist(), other.tolist(), strict=True)) == {(i, int(ids[j])) for i in range(700) for j in np.lexsort((ids, -s[i]))[:10]}
