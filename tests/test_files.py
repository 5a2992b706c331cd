import json

import pytest
from pyspark.sql import functions as F

from engine.sources import files
from engine.streaming import events


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n  \n{"id": "b", "n": null, "more": 2}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int", ["id"])
    assert {tuple(r) for r in rows.collect()} == {("a", 1), ("b", None)}
    for bad in ('{"id": "a"', '{"n": 1}', "[1"):
        (tmp_path / "b.jsonl").write_text('{"id": "ok"}\n' + bad + "\n")
        with pytest.raises(Exception, match="not a valid record"):
            files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string, n int", ["id"]).collect()
    (tmp_path / "c.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert files.read_documents(spark, str(tmp_path / "c.json")).count() == 2


def test_tree(spark, tmp_path):
    for name in ("Source/Runtime/Core/Core.Build.cs", "Source/Runtime/Core/Private/A.cpp", "Source/Runtime/Bare/b.H", "Source/x.txt", "Binaries/c.h", "Plugins/P/P.uplugin", "Plugins/P/Source/M/M.Build.cs", "Plugins/P/Source/M/d.inl", "Plugins/P/Other/e.h"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = {r.relative_path: (r.module, r.plugin, r.file_type, r.size) for r in files.scan_tree(spark, str(tmp_path), "5").collect()}
    assert rows == {
        "Source/Runtime/Core/Core.Build.cs": ("Core", None, "build_cs", 33), "Source/Runtime/Core/Private/A.cpp": ("Core", None, "cpp", 33), "Source/Runtime/Bare/b.H": ("Bare", None, "header", 23),
        "Plugins/P/Source/M/M.Build.cs": ("M", "P", "build_cs", 29), "Plugins/P/Source/M/d.inl": ("M", "P", "inl", 24),
    }
    assert files.check_root(tmp_path, "Source") == tmp_path.resolve()
    for bad in ("Nothing", "../.."):
        with pytest.raises(FileNotFoundError):
            files.check_root(tmp_path, bad)


def test_manifest_and_staged_writes(spark, tmp_path):
    log = [("u", 1, "DOWNLOADED"), ("u", 2, "FAILED"), ("v", 1, "FAILED"), ("v", 3, "DOWNLOADED")]
    files.write_jsonl(spark.createDataFrame(log[:2], "url string, seq int, status string"), f"{tmp_path}/m")
    files.write_jsonl(spark.createDataFrame(log[2:], "url string, seq int, status string"), f"{tmp_path}/m", append=True)
    assert [r.url for r in files.read_manifest(spark, f"{tmp_path}/m", "url", "seq", "DOWNLOADED").collect()] == ["v"]
    files.write_staged(spark.range(3), f"{tmp_path}/t")
    files.write_staged(spark.read.parquet(f"{tmp_path}/t").where("id > 0"), f"{tmp_path}/t")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2] and [x.name for x in tmp_path.iterdir() if "." in x.name] == []
    with pytest.raises(ValueError):
        files.unique_across(spark.range(2).union(spark.range(1)), "id")
    files.write_text(f"{tmp_path}/r.md", files.report_markdown(spark.createDataFrame([("all", 0.5)], "category string, mrr double")))
    assert (tmp_path / "r.md").read_text() == "| category | mrr |\n| --- | --- |\n| all | 0.5000 |"
    assert json.loads(files.script_json(json.dumps("</script>&"))) == "</script>&" and "<" not in files.script_json("<")


def test_stream_is_as_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    last = rows.agg(F.max("ts")).first()[0]
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, f in (("tumbling", events.tumbling), ("sessions", events.sessions)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        streamed = {tuple(r) for r in spark.table(name).collect()}
        assert streamed and streamed <= {tuple(r) for r in f(rows).collect()}  # windows that the watermark hasn't passed are still open
    assert events.distinct_events(rows, ["user_id"]).count() == rows.select("user_id").distinct().count() and last
