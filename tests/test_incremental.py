from datetime import datetime, timedelta

from engine.operators.incremental import p2_found

T = datetime(2025, 1, 1)
at = lambda h: T + timedelta(hours=h)


def test_only_succeeded_runs_and_last_rows_count(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    # run 2 fails at last, so run 3 is held against run 1
    write("index_runs", [(1, "succeeded", at(1)), (2, "succeeded", at(2)), (2, "failed", at(3)), (3, "started", at(4)), (3, "succeeded", at(5))], "run_id int, status string, recorded_at timestamp")
    files = [(1, "a/b.h", "AA", 0), (1, "gone.h", "01", 0), (1, "new.h", "02", 0), (1, "new.h", "03", 1), (2, "failed.h", "09", 0), (3, "a\\b.h", "aa", 0), (3, "new.h", "02", 2), (3, "fresh.h", "04", 2)]
    write("project_inventory", [(r, p, s, at(h)) for r, p, s, h in files], "run_id int, relative_path string, sha256 string, recorded_at timestamp")
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"  # of abc
    chunks = [("x", "abc", None, 1, 0), ("x", "abc", sha.upper(), 3, 0), ("y", "q", "11", 1, 0), ("y", "r", "22", 2, 5), ("z", "z", "33", 2, 5), ("z", "z", "44", 3, 0)]
    write("chunks", [(i, c, s, r, at(h)) for i, c, s, r, h in chunks], "id string, content string, content_sha256 string, run_id int, delivered_at timestamp")
    found = {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()}
    assert found == {
        *((1, "file", p, "added") for p in ("a/b.h", "gone.h", "new.h")),
        (3, "file", "gone.h", "deleted"), (3, "file", "new.h", "modified"), (3, "file", "fresh.h", "added"),
        (1, "chunk", "x", "added"), (1, "chunk", "y", "added"), (3, "chunk", "y", "modified"), (3, "chunk", "z", "added"),
    }
